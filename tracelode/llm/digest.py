"""Quartile digests of documents: like texts have like digests.

Byte triplets from a sliding window of five bytes are hashed and counted in 128 buckets. The digest holds, for each bucket,
in which quarter of the document's own counts it lies (two bits), and the length on a logarithmic scale. Two digests
differ by the sum of quarter steps (a step of three counts six, as far apart is worse) and a bounded length part;
likeness is one minus the share of the greatest difference.

Cases: a null text counts as empty; texts of fewer than three bytes have no triplets and all their buckets in the lowest
quarter; null ids come first; equal ids keep the order of their texts; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, documents, id_buckets, tasks_for

BUCKETS = 128
PAIRS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
_T = np.random.default_rng(8).integers(0, BUCKETS, (len(PAIRS), 3, 256)).astype(np.uint8)
LENGTH_STEPS, LENGTH_CAP = 8.0, 24
_STEP = np.array([0, 1, 2, 6], np.int64)
MOST = BUCKETS * 6 + LENGTH_CAP


def digest(data: bytes) -> np.ndarray:
    """BUCKETS quarters (0 to 3) and the length code."""
    counts = np.zeros(BUCKETS, np.int64)
    raw = np.frombuffer(data, np.uint8)
    for a in range(0, len(raw), 1 << 20):  # blocks bound the memory; they overlap by the window
        b = raw[a : a + (1 << 20) + 4]
        for k, (i, j) in enumerate(PAIRS):
            n = min(len(b) - j, 1 << 20)
            if n > 0:
                counts += np.bincount(_T[k, 0][b[:n]] ^ _T[k, 1][b[i : i + n]] ^ _T[k, 2][b[j : j + n]], minlength=BUCKETS)
    out = np.zeros(BUCKETS + 1, np.uint8)
    if counts.any():
        cut = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
        out[:BUCKETS] = (counts[:, None] > cut).sum(1)
    out[BUCKETS] = min(255, round(LENGTH_STEPS * np.log2(1 + len(raw))))
    return out


def text_of(d: np.ndarray) -> str:
    """The digest in hex: the length code, then four buckets a byte."""
    q = d[:BUCKETS].reshape(-1, 4)
    return f"{d[BUCKETS]:02x}" + (q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6).astype(np.uint8).tobytes().hex()


def parse(text: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(text), np.uint8)
    return np.append((raw[1:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).ravel(), raw[0]).astype(np.uint8)


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    step = np.abs(x[:BUCKETS].astype(int) - y[:BUCKETS])
    far = min(LENGTH_CAP, abs(int(x[BUCKETS]) - int(y[BUCKETS])))
    return 1.0 - (int(_STEP[step].sum()) + far) / MOST


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows (bucket, last, doc_id, text), dealt by buckets of doc_id and text and sorted; `last` marks, at each bucket's end, the row that follows it in the whole order (after the last row: the first)."""
    spark, rows = docs.sparkSession, documents(docs)
    cuts = id_buckets(rows, tasks_for(spark))
    rows = rows.withColumn("bucket", bucket_of(F.col("doc_id"), F.col("text"), cuts))
    # One row for each bucket passes the driver: its first id.
    firsts = sorted(rows.groupBy("bucket").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("null")).collect(), key=lambda r: r["bucket"])
    heads = [(firsts[i - 1]["bucket"], r["bucket"], None if r["null"] else r["first"]) for i, r in enumerate(firsts)]
    after = spark.createDataFrame(heads, "own int, of int, first long")
    joined = rows.join(F.broadcast(after), (F.col("bucket") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first")))
    tail = joined.groupBy("own").agg(F.min(F.struct("doc_id", "text")).alias("x")).select(F.col("own").alias("bucket"), F.lit(True).alias("last"), "x.doc_id", "x.text")
    both = rows.select("bucket", F.lit(False).alias("last"), "doc_id", "text").unionByName(tail)
    return both.repartitionById(len(cuts) + 1, F.col("bucket")).sortWithinPartitions("bucket", "last", "doc_id", "text"), len(cuts) + 1


def fingerprints(docs: DataFrame, pairs: bool = True) -> DataFrame:
    """doc_id, n_chars and fingerprint of every document; with pairs also the edited text's (its last half replaced from the next document) and likenesses."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    utf = lambda t: t.encode("utf-8", "surrogatepass")

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts = batch.column(0), batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([docs.cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([text_of(digest(utf(t))) for t in texts], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (doc, text, digest) that waits for the next one
        for batch in batches:
            out = []
            for last, doc, text in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                own = digest(utf(text))
                if held:
                    d, t, mine = held
                    half = len(t) // 2
                    new = t[: len(t) - half] + text[:half]
                    edited = digest(utf(new))
                    out.append((d, len(t), hashlib.sha256(utf(new)).hexdigest(), text_of(mine), text_of(edited), likeness(mine, edited), likeness(mine, own)))
                held = None if last else (doc, text, own)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    if not pairs:
        return documents(docs).mapInArrow(alone, "doc_id long, n_chars long, fingerprint string")
    return with_next(docs)[0].mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
