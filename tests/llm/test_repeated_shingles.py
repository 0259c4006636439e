import random

import numpy as np
import pytest

from tracelode.llm import decontam
from tracelode.llm.textnum import Words


def plain_simhash(run):
    """Each time that a shingle occurs in a run has signs of its own."""
    total, seen = np.zeros(decontam.BITS, int), {}
    for s in run.tolist():
        j = seen[s] = seen.get(s, -1) + 1
        x = np.array([s], np.uint64)
        total += decontam._signs(x if j == 0 else decontam.mix(x + np.uint64(0xD1B54A32D192ED03 * j % 2**64)))[0]
    return np.packbits(total > 0)


def test_sums_of_runs_with_repeats():
    r = np.random.default_rng(4)
    for values, n in ((3, 1), (2, 9), (5, 20), (40, 33), (1, 50)):
        shingles = r.integers(0, 2**63, values, dtype=np.uint64)[r.integers(0, values, 300)]
        starts = np.sort(r.choice(300 - n, 40, replace=False))
        got = decontam.window_simhash(shingles, starts, n)
        assert (got == np.array([plain_simhash(shingles[a : a + n]) for a in starts])).all()


@pytest.mark.parametrize("run", [10, 14, 24, 44])
def test_recall_where_one_word_is_repeated(run):
    """Items that end in a run of equal words, and windows that have another word there in its stead: at similarity 0.8 or more all but a hundredth are found."""
    r, lost, asked = random.Random(run), 0, 0
    for k in range(150):
        head = [f"w{r.randrange(10**6)}" for _ in range({10: 84, 14: 116, 24: 196, 44: 356}[run])]
        words = Words([" ".join([*head, *["same"] * run]), " ".join([*head, *["other"] * run])])
        shingles, bounds = words.shingles()
        item, window = shingles[bounds[0] : bounds[1]], shingles[bounds[1] : bounds[2]]
        if decontam.weighted_jaccard(item, window) < 0.8:
            continue
        asked += 1
        items = decontam.Items([(k, len(head) + run, item.tobytes())])
        lost += not list(items.matches(window, np.arange(len(window) + 1), 0.8, len(head) + run))
    assert asked >= 100 and lost <= asked // 100


def test_recall_where_heavy_and_light_shingles_change():
    """Runs of many lengths, with changes among single words and in runs alike, at similarities from 0.8 to 0.85."""
    r, lost, asked = random.Random(9), 0, 0
    while asked < 400:
        parts = [w for _ in range(r.randint(2, 12)) for w in [f"w{r.randrange(10**6)}" for _ in range(r.randint(1, 30))] + [f"x{r.randrange(9)}"] * r.randint(1, 25)]
        other = list(parts)
        for _ in range(r.randint(1, max(1, len(parts) // 25))):
            other[r.randrange(len(other))] = f"y{r.randrange(20)}"
        shingles, bounds = Words([" ".join(parts), " ".join(other)]).shingles()
        item, window = shingles[bounds[0] : bounds[1]], shingles[bounds[1] : bounds[2]]
        if not len(item) or not 0.8 <= decontam.weighted_jaccard(item, window) <= 0.85:
            continue
        asked += 1
        items = decontam.Items([(1, len(parts), item.tobytes())])
        lost += not list(items.matches(window, np.arange(len(window) + 1), 0.8, len(parts)))
    assert lost <= asked // 100
