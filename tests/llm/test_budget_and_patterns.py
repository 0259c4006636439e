import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tracelode.llm import chat_format, packing
from tracelode.llm.tokens import chunked, tokenizer_path

BPE = "byte_bpe_50k.json"
WORDS = "the of a one two three four five six seven".split()


def plain_tokens(role, text):
    t = chunked(tokenizer_path(BPE))
    return int(t.encode([f"<|turn|>{role}<|text|>{text}<|end|>"])[1][0])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_windows_keep_their_budget(spark, seed):
    """No window is over its budget unless its one new turn alone is; a system turn is left out only where it doesn't fit; history is there where it fits."""
    r = random.Random(seed)
    say = lambda n: " ".join(r.choices(WORDS, k=n))
    talks = {1: [("system", 75), ("user", 100), ("assistant", 400)], 2: [("system", 425), ("user", 75), ("assistant", 100)], 3: [("system", 600), ("user", 3), ("assistant", 5)], 4: [("user", 5), ("system", 20), ("assistant", 490)]}
    for c in range(5, 45):
        talks[c] = [(r.choice(["system", "user", "assistant"]), int(r.choice([0, 3, 40, 120, 250, 500, 700]) * r.random())) for _ in range(r.randint(1, 12))]
    talks = {c: [(role, say(n)) for role, n in turns] for c, turns in talks.items()}
    df = spark.createDataFrame([(c, i, role, text) for c, turns in talks.items() for i, (role, text) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    budget, history = 512, 128
    library = Tokenizer.from_file(tokenizer_path(BPE))
    frame = sum(len(library.encode(x, add_special_tokens=False).ids) for x in ("<s>", "</s>"))
    rows = chat_format.windows(df, tokenizer_path(BPE), budget, history, 3).orderBy("conv_id", "window").collect()
    done = dict.fromkeys(talks, 0)
    for w in rows:
        turns = talks[w.conv_id]
        told = chat_format.TURN.findall(w.formatted)
        new = told[w.n_repeated :]
        first = done[w.conv_id]
        assert new == turns[first : first + len(new)]
        done[w.conv_id] += len(new)
        cost = sum(plain_tokens(*t) for t in told) + frame
        assert w.n_tokens == cost and w.over_budget == (cost > budget)
        assert len(library.encode(w.formatted, add_special_tokens=False).ids) <= cost
        size = sum(plain_tokens(*t) for t in new) + frame
        if w.over_budget:
            assert len(new) == 1 and w.n_repeated == 0 and size > budget
        system = next(((i, t) for i, t in enumerate(turns) if t[0] == "system"), None)
        led = system is not None and system[0] < first
        fits = led and size + plain_tokens(*system[1]) <= budget
        assert w.system_left_out == (led and not fits) and (told[0] == system[1] if fits else True)
        back = told[int(fits) : w.n_repeated]
        assert back == [t for t in turns[first - len(back) - sum(t[0] == "system" for t in turns[first - 3 : first]) : first] if t[0] != "system"][-len(back) :] if back else True
        room = min(history, budget - size - (plain_tokens(*system[1]) if fits else 0))
        if first and turns[first - 1][0] != "system":
            assert bool(back) == (plain_tokens(*turns[first - 1]) <= room)
    assert done == {c: len(t) for c, t in talks.items()}


def exact_nnls(a, b):
    """Lawson and Hanson's active set."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    while True:
        w = a.T @ (b - a @ x)
        w[active] = -1
        if w.max() <= 1e-9:
            return x
        active[w.argmax()] = True
        while True:
            s = np.zeros_like(x)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if (s[active] > 0).all():
                x = s
                break
            bad = active & (s <= 0)
            x = x + (x[bad] / (x[bad] - s[bad])).min() * (s - x)
            active &= x > 1e-12


def test_repeats_fit_as_exact_least_squares():
    r = np.random.default_rng(2)
    counts = np.bincount(r.integers(3, 41, 900), minlength=41)
    patterns = packing.candidate_patterns(counts, 40, 0, r, 150)
    a = np.zeros((41, len(patterns)))
    for j, p in enumerate(patterns):
        np.add.at(a[:, j], p[p > 0], 1)
    off = lambda x: float(np.linalg.norm(a @ x - counts))
    best = off(exact_nnls(a, counts.astype(float)))
    assert best <= off(packing.fit_repeats(patterns, counts)) <= best + 0.03 * np.linalg.norm(counts)
    assert off(packing.fit_repeats(patterns, counts, 5000)) <= best + 0.003 * np.linalg.norm(counts)


@pytest.mark.parametrize("n", [1000, 10_000, 300_000])
def test_patterns_place_most_pieces(n):
    """Lengths as of the documents: log-normal with whole sequences among them. Nearly all go by fitted patterns, in as few sequences as tokens allow, but for a hundredth."""
    r = np.random.default_rng(n)
    lengths = np.minimum(4096, np.exp(r.normal(6.4, 0.9, n)).astype(int) + 1)
    counts = np.bincount(lengths, minlength=4097)
    chosen, left = packing.fitted(counts, 4096)
    assert all(sum(p) <= 4096 and len(p) <= packing.MOST for p, _ in chosen)
    held = sum((k * np.bincount(p, minlength=4097) for p, k in chosen), np.zeros(4097, np.int64))
    assert (held + left == counts).all() and left.sum() <= 0.08 * n
    assert sum(k for _, k in packing.plan(counts, 4096)) <= 1.01 * lengths.sum() / 4096 + 1
