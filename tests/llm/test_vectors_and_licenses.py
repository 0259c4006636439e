import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import compare
from tracelode.llm import centroids, licenses, whitening
from tracelode.llm import queries as llm

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_centroids", "op13_licenses"])
def test_query_equals_sql(spark, name):
    assert compare.spark_rows(llm.queries()[name](spark, SF)) == compare.sql_rows(SF, llm.oracle_sql()[name])


def vectors(spark, rows):
    """With columns whose names clash with ours."""
    return spark.createDataFrame([(i, v if v is None else [e if e is None else float(e) for e in v], 7, "x", [1]) for i, v in rows], "vec_id long, embedding array<float>, cluster int, n string, x array<int>")


def plain_clusters(rows, k, rounds):
    """Lloyd's rounds in Python's integers."""
    kept = [(i, [int(np.floor(64 * float(np.float32(e)))) for e in v]) for i, v in rows]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    for turn in range(rounds + 1):
        d = [[sum((a - b) ** 2 for a, b in zip(v, w, strict=True)) for w in c] for _, v in kept]
        near = [x.index(min(x)) for x in d]
        if turn < rounds:
            c = [[sum(col) // len(m) for col in zip(*m, strict=True)] if (m := [v for (_, v), n in zip(kept, near, strict=True) if n == j]) else w for j, w in enumerate(c)]
    mine = [x[n] for x, n in zip(d, near, strict=True)]
    of = Counter()
    for n, x in zip(near, mine, strict=True):
        of[n] += x
    key = [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in c]
    return Counter((i, n, x, of[n], sum(mine), key[n]) for (i, _), n, x in zip(kept, near, mine, strict=True))


def told_clusters(df):
    return Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_clusters_against_plain_rounds(spark):
    """Groups that are far apart, so that bounds settle most; ties, repeated rows and ids, a null id."""
    r = random.Random(3)
    heads = [[r.uniform(-9, 9) for _ in range(5)] for _ in range(6)]
    rows = [(i, [x + r.gauss(0, 0.2) for x in heads[i % 6]]) for i in range(300)]
    rows += [(i, [float(i % 3), 0, 0, 0, 0]) for i in range(300, 360)] + [(None, [1.0, 1, 1, 1, 1]), (5, [0.5] * 5), (5, [0.5] * 5), (5, [0.25] * 5)]
    df = centroids.clusters(vectors(spark, rows).repartition(5), k=6, rounds=7, dims=5)
    assert told_clusters(df) == plain_clusters(rows, 6, 7)
    assert df.agg(F.avg("n_measured")).first()[0] < 0.75 * 6 * 8  # the bounds spare distances


def test_clusters_of_odd_tables(spark):
    bad = [(1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0]), (6, []), (7, [1.0, 2.0, 3.0])]
    assert centroids.clusters(vectors(spark, bad), dims=2).count() == 0
    few = [(8, [0.1, 0.2]), (9, [0.1, 0.2]), (10, [-3.0, 4.0])]
    assert told_clusters(centroids.clusters(vectors(spark, bad + few), dims=2)) == plain_clusters(few, 16, 3)
    with pytest.raises(Exception, match="leave a long"):
        centroids.clusters(vectors(spark, [(1, [3e38, 0.0])]), dims=2).count()


def test_displacement_counts_not_its_steps():
    """A centroid that goes away and comes back has moved by nothing: the bound is as tight as when it was measured."""
    x = np.array([[0, 0]])
    history = [np.array([[1, 0], [50, 0]]), np.array([[1, 0], [90, 0]]), np.array([[1, 0], [50, 0]])]
    d2, since = np.array([[1, 2500]]), np.array([[0, 0]])
    best, n = centroids.assign(x, history, np.array([0]), d2, since)
    assert best.tolist() == [0] and n.tolist() == [1]  # summed drifts of 80 would have asked for the second
    d2, since = np.array([[1, 2500]]), np.array([[0, 0]])
    assert centroids.assign(x, [*history, np.array([[60, 0], [50, 0]])], np.array([0]), d2, since)[0].tolist() == [1]


def plain_whitening(rows, k):
    x = np.floor(64 * np.array([v for _, v in rows], np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(0)
    c = x - total / n
    value, vector = np.linalg.eigh(c.T @ c / n)
    value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
    return ((n * x - total) ** 2).sum(1), c @ vector / np.sqrt(value), value / np.trace(c.T @ c / n)


def test_whitening_against_plain_eigenvectors(spark):
    r = np.random.default_rng(5)
    rows = [(i, (r.standard_normal(12) * np.arange(1, 13) ** 0.7).tolist()) for i in range(400)]
    deviation, white, explained = plain_whitening(rows, 9)
    got = whitening.whiten(vectors(spark, rows).repartition(6), k=9).orderBy("vec_id", "component").collect()
    assert [(g.vec_id, g.component, g.n) for g in got] == [(i, j + 1, 400) for i in range(400) for j in range(9)]
    assert [g.deviation for g in got[::9]] == deviation.tolist()
    mine = np.array([g.whitened for g in got]).reshape(400, 9)
    assert np.abs(mine * np.sign((mine * white).sum(0)) - white).max() < 1e-9
    assert np.abs(np.array([g.explained for g in got[:9]]) / explained - 1).max() < 1e-12
    assert max(g.identity_error for g in got) < 1e-12 and np.abs(np.cov(mine.T, bias=True) - np.eye(9)).max() < 1e-12


def test_whitening_of_odd_tables(spark):
    bad = [(1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [-float("inf"), 1.0]), (5, [])]
    assert whitening.whiten(vectors(spark, bad)).count() == 0 and whitening.whiten(vectors(spark, bad).limit(0)).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])] * 3)).count() == 0  # no variance
    line = [(i, [float(i), 2.0 * i, 5.0]) for i in range(6)] + [(None, [0.0, 0.0, 5.0]), (3, [3.0, 6.0, 5.0]), (9, [1.0, 2.0])]
    got = whitening.whiten(vectors(spark, bad + line)).collect()
    assert len(got) == 8 and {g.component for g in got} == {1} and abs(got[0].explained - 1) < 1e-12 and got[0].identity_error < 1e-12
    big = whitening.whiten(spark.createDataFrame([(1, [1e9, 0.0]), (2, [-1e9, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert len(big) == 2 and {g.deviation for g in big} == {None} and abs(abs(big[0].whitened) - 1) < 1e-9


def test_inertia_and_contours():
    """As many below a value as there are, also for repeated, clustered and zero eigenvalues; every slice holds what inertia counts."""
    r = np.random.default_rng(1)
    q = np.linalg.qr(r.standard_normal((40, 40)))[0]
    for values in (np.arange(40.0), np.repeat([1.0, 2, 3, 4], 10), np.concatenate([np.zeros(25), 1 + 1e-7 * np.arange(15)]), 10.0 ** -np.arange(40), np.full(40, 5.0)):
        v = (q * values) @ q.T
        v = (v + v.T) / 2
        for s in (-1.0, 0.5, 1.5, 2.5, 17.5, 100.0):
            assert whitening.negatives(v - s * np.eye(40)) == (values < s).sum()
        found = np.concatenate([whitening.feast(v, *part)[0] for part in whitening.slices(v, 32)])
        assert np.abs(np.sort(found)[::-1][:32] - np.sort(values)[::-1][:32]).max() < 1e-12 * max(values)
    a = np.array([[0.0, 1], [1, 0]])  # no pivot on the diagonal
    assert whitening.negatives(a) == 1 and whitening.negatives(np.zeros((3, 3))) == 0


def plain_scan(text):
    """Base labels by the words themselves."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, t.label) for t in licenses.TEMPLATES if t.base for i in range(len(words)) if words[i : i + len(t.text.split())] == t.text.split()]
    return len(words), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))


def license_texts():
    r = random.Random(4)
    vocabulary = ["gnu", "general", "public", "license", "apache", "mit", "cc", "by", "nc", "Ünï", "x1", "THE", "İ", "this", "software"]
    texts = ["", None, "mit", "MIT License", "mit-license MIT\nLICENSE", "GNU General Public License", "cc by cc by", "mit licenses", "mit licenſe", "mit License"]
    return texts + [" ".join(r.choices(vocabulary, k=n)) + r.choice(["", ".", "\n\n"]) for n in [3, 10, 50, 200] * 10]


def test_base_labels_against_plain_places(spark):
    rows = [(i if i % 7 else None, t, "z", [1]) for i, t in enumerate(license_texts())] * 2 + [(5, "MIT License", "z", [1])]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, template string, words array<int>")).collect()
    want = Counter((i, *plain_scan(t)) for i, t, *_ in rows)
    assert Counter((g.doc_id, g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) for g in got) == want
    assert all((g.labels == "") == (g.score == 0) and set(g.base_labels.split(",")) - {""} <= set(g.labels.split(",")) for g in got)
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_of_a_long_text(spark, monkeypatch):
    """Phrases across the ends of runs are found, once each; a text of many runs equals one in a single run."""
    words = ["w"] * (3 * licenses.RUN)
    for k in (0, licenses.RUN - 1, licenses.RUN, 2 * licenses.RUN - 2, 3 * licenses.RUN - 2):
        words[k : k + 2] = ["mit", "license"]
    words[2 * licenses.RUN - 3 : 2 * licenses.RUN + 1] = "gnu general public license".split()
    text = " ".join(words)
    got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (got.n_words, got.n_base, got.first_word, got.last_word, got.base_labels) == plain_scan(text)


def test_notices(spark):
    """A notice with words put in, left out or changed is found near its place; half of one isn't, nor are its words shuffled."""
    notice = next(t.text for t in licenses.TEMPLATES if t.label == "mit-notice").split()
    r = random.Random(8)
    edited = [w for i, w in enumerate(notice) if i % 13] + ["extra"]
    edited[20:20] = ["put", "in", "here"]
    mixed = r.sample(notice, len(notice))
    noise = [f"n{r.randint(0, 99)}" for _ in range(200)]
    texts = {"whole": noise + notice + noise, "edited": noise + edited + noise, "part": noise + notice[:20] + noise, "mixed": noise + mixed + noise, "none": noise, "twice": notice + noise + notice}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts.values())], "doc_id long, text string")
    got = dict(zip(texts, licenses.scan(df).orderBy("doc_id").collect(), strict=True))
    assert got["whole"].labels == got["edited"].labels == got["twice"].labels == "mit-notice" and got["whole"].score == 1 > got["edited"].score > 0.7
    assert [got[k].labels for k in ("part", "mixed", "none")] == ["", "", ""]
    spans = licenses.places(licenses.hits(df)).where("doc_id = 0").select("first", "last").distinct().collect()
    assert [(s.first, s.last) for s in spans] == [(200, 200 + len(notice) - 1)]
