"""Quality scores by supervised subword embeddings.

A document is the mean of the learned vectors of its features: its words, its runs of three and of four bytes (which are its characters where those are ASCII), and one feature
for a word that repeats the one before it; all but the last are hashed into BUCKETS rows. A softmax over two classes follows; both
are trained by stochastic gradient descent in numpy on a bounded sample of labelled rows. Since the output is linear in
the mean, scoring needs one number for each row: the difference of the two classes' products with its vector.

The sample has at most `per_class` texts of each class and at most `most_chars` characters a text (whole texts; the longer ones aren't
sampled), chosen by hash of the text, so that copies don't count twice. Scores are set to the classes' shares among all labelled rows.

Cases: a null text counts as empty, and texts without features get the classes' shares as their score; labels that are null, or of
documents that don't exist, aren't used; several labels of one id each count; with labels of one class or none the score is their
share (0.5 without any); null doc_ids are scored, never labelled; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, fold
from .textnum import Words, slices

BITS = 18
BUCKETS = 1 << BITS
REPEAT = BUCKETS  # the row of a repeated word
GRAMS = (3, 4)
BATCH_CHARS = 2_000_000


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: rows, and the text of each."""
    words = Words(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
    yield (words.hash >> np.uint64(64 - BITS)).astype(np.int64), doc
    same = np.flatnonzero((words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1]))
    yield np.full(len(same), REPEAT), doc[same]
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"".join([*parts, b"\0" * 8]), np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    window = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))[: len(buf) - 8]
    of, left = np.repeat(np.arange(len(texts)), sizes), np.repeat(np.cumsum(sizes), sizes) - np.arange(sizes.sum())
    for n in GRAMS:
        key = (window & np.uint64((1 << 8 * n) - 1)) + np.uint64(n << 60)
        key = key * np.uint64(0x9E3779B97F4A7C15)
        inside = left >= n
        yield ((key ^ key >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64)[inside], of[inside]


def _sampled(docs: DataFrame, labels: DataFrame, target: str, folds: int, held: int, per_class: int, most_chars: int) -> tuple[DataFrame, float]:
    """Distinct labelled training texts, and the share of label 1 among labelled training rows."""
    known = labels.select("doc_id", F.col(target).cast("int").alias("y")).where("y in (0, 1)").where(fold(F.col("doc_id"), folds) != held)
    share = known.join(docs.select("doc_id"), "doc_id", "left_semi").agg(F.avg("y")).first()[0]
    # Hash and length stand for a text until the sample is drawn, so that the shuffles carry no texts.
    texts = documents(docs).withColumn("h", F.xxhash64("text"))
    brief = texts.select("doc_id", "h", F.length("text").alias("n")).where(F.col("n") <= most_chars)
    rows = brief.join(known, "doc_id").groupBy("h", "n", "y").agg(F.min("doc_id").alias("doc_id"))
    picked = [rows.where(F.col("y") == y).orderBy("h", "n").limit(per_class) for y in (0, 1)]
    chosen = picked[0].unionByName(picked[1]).select("doc_id", "h", "y")
    # Rows that repeat a doc_id and its text are one.
    return texts.join(F.broadcast(chosen), ["doc_id", "h"]).dropDuplicates(["doc_id", "h", "y"]).drop("h"), 0.5 if share is None else share


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], dim: int = 12, epochs: int = 6, rate: float = 0.4, seed: int = 4) -> tuple[np.ndarray, float]:
    """rows: label, features, counts. Returns a number for each row of the embedding table, and the bias."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (BUCKETS + 1, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    steps, at = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            y, index, weight = rows[i]
            lr = np.float32(rate * (1 - at / steps))
            at += 1
            vectors = table[index]
            mean = weight @ vectors
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= lr * np.outer(mean, p)
            bias -= lr * p
            table[index] = vectors - (lr * min(40.0, 1 / float((weight**2).sum() + 1e-9) ** 0.5)) * weight[:, None] * back
    return (table @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", folds: int = 5, held: int = 0, per_class: int = 2000, most_chars: int = 8000) -> tuple[np.ndarray, float]:
    """Learns from labelled rows outside the held fold. The sample's bound is per_class texts of most_chars characters for each class; their features, not their texts, come to the driver."""
    sample, share = _sampled(docs, labels, target, folds, held, per_class, most_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            index, counts = [], []
            for t in texts:
                i, n = np.unique(np.concatenate([f for f, _ in features([t])]), return_counts=True)
                index.append(i.astype("<u4").tobytes())
                counts.append(n.astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(index, pa.binary()), pa.array(counts, pa.binary())], ["y", "index", "counts"])

    rows = []
    for y, index, counts in sample.select("text", "y").mapInArrow(run, "y int, index binary, counts binary").collect():
        index, counts = np.frombuffer(index, "<u4"), np.frombuffer(counts, "<u2").astype(np.float32)
        if len(index):
            rows.append((y, index, counts / counts.sum()))
    rows.sort(key=lambda r: (r[0], r[1].tobytes()))
    n = [sum(r[0] == y for r in rows) for y in (0, 1)]
    odds = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    if not all(n):
        return np.zeros(BUCKETS + 1, np.float32), odds
    table, bias = train(rows)
    return table, bias + odds - float(np.log(n[1] / n[0]))


def score(docs: DataFrame, model: tuple[np.ndarray, float], folds: int, held: int, cut: float) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text. The model has a fixed size."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = sent.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            z = np.zeros(len(texts))
            for a, b in slices([len(t) for t in texts], BATCH_CHARS):
                total, n = np.zeros(b - a), np.zeros(b - a)
                for rows, of in features(texts[a:b]):
                    total += np.bincount(of, table[rows], b - a)
                    n += np.bincount(of, minlength=b - a)
                z[a:b] = total / np.maximum(n, 1)
            p = 1 / (1 + np.exp(-np.clip(z + bias, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(p), pa.array((p >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = documents(docs).withColumn("held_out", fold(F.col("doc_id"), folds) == held)
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, cut: float = 0.3, **bounds: int) -> DataFrame:
    return score(docs, fit(docs, labels, "quality", folds, held, **bounds), folds, held, cut)
