"""Decontamination: blocks of items meet passages by a join, whatever the benchmark's size and however often an item is copied."""

import random

from tracelode.llm import decontam


def _text(rng, n, words=5000):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def test_jobs_do_not_follow_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontam, "ITEMS_AT_ONCE", 2)
    rng, jobs = random.Random(3), []
    items = [(i, _text(rng, 30)) for i in range(80)]
    docs = spark.createDataFrame([(i, f"{_text(rng, 40)} {t} {_text(rng, 40)}") for i, t in items[::2]] + [(1000 + i, _text(rng, 90)) for i in range(20)], "doc_id long, text string")
    for some in (items[:4], items):
        spark.sparkContext.setJobGroup(f"items-{len(some)}", "")
        got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, spark.createDataFrame(some, "item_id long, text string")).collect()}
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"items-{len(some)}")))
        assert got == {(i, i) for i, _ in some if i % 2 == 0}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert abs(jobs[1] - jobs[0]) <= 4, jobs


def test_a_hot_item_and_boilerplate_in_small_cells(spark, monkeypatch):
    """A third of all documents hold one item; all items begin with the same words; equal items and repeated words; cells of few shingles."""
    monkeypatch.setattr(decontam, "ITEMS_AT_ONCE", 4)
    monkeypatch.setattr(decontam, "CELL", 100)
    rng = random.Random(5)
    same = "choose the one answer that fits the question best of all " * 2
    items = [(i, same + _text(rng, 25)) for i in range(20)] + [(20, None), (21, "a b c"), (None, "x " * 40)]
    items.append((22, items[7][1]))

    def edited(text):
        words = text.split()
        words[len(words) - 3] = "other"
        return " ".join(words)

    docs = [(i, f"{_text(rng, 20)} {edited(items[7][1]) if i % 2 else items[7][1]} {_text(rng, 20)}") for i in range(60)]
    docs += [(100 + i, f"{_text(rng, 20)} {same} {_text(rng, 30)}") for i in range(100)]
    docs += [(300, "see a b c here"), (301, "y " + "x " * 60), (302, None), (303, items[3][1]), (304, " ".join(items[4][1].split()[:-2]))]
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(i, k) for i in range(60) for k in (7, 22)} | {(300, 21), (301, None), (303, 3), (304, 4)}
    assert set(got) == want
    assert all((got[i, 7] == 1.0) == (i % 2 == 0) for i in range(60))


def test_rarest_shingles_meet_whatever_is_similar(spark):
    """Of any two multisets of that similarity, one holds one of the other's rarest shingles."""
    import numpy as np

    rng, rows, near = random.Random(9), [], []
    for k in range(60):
        item = [rng.randrange(30) if rng.random() < 0.4 else rng.randrange(10**6) for _ in range(rng.choice([1, 2, 5, 9, 30]))]
        rows.append((0, k, 1, np.array(item, "<u8").tobytes()))
        for _ in range(20):
            other = [x if rng.random() < 0.9 else rng.randrange(10**6) for x in item] + [rng.randrange(30)] * rng.choice([0, 0, 1])
            if decontam.weighted_jaccard(np.array(item), np.array(other)) >= 0.8:
                near.append((k, set(other)))
    held: dict = {}
    for r in decontam._rarest(spark.createDataFrame([(p, b, n, bytearray(s)) for p, b, n, s in rows], "part int, block int, number int, shingles binary"), 0.8).collect():
        held.setdefault(r.block, set()).add(r.key)
    assert near and all(held[k] & other for k, other in near)
