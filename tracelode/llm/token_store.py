"""Token ids in directly addressable codes.

An id is split into chunks of eight bits, the lowest first. Level k holds the k-th chunk of every id that has one,
beside a bitmap that says which of its ids go on to level k + 1 and a directory of the bitmap's ones before each
block of 512 bits. The place of an id on the next level is the rank of its bit, so any id is read with one look a
level, without decoding what stands before it.

File format: a Parquet table with a row for each segment (at most SEGMENT ids over, whole documents). Segments follow
each other by (bucket, part); buckets are runs of ascending doc_id. Columns: bucket, part, first_token (ids of the bucket
before it), n_tokens, n_docs, doc_ids, null_ids, doc_sizes, and levels, bitmaps, ranks (lists of binary).

Cases: a null text counts as empty (its document is the end id alone); null ids come first, as id null; equal ids keep
the order of their texts; an empty table gives an empty file; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of, documents, id_buckets, tasks_for
from .textnum import slices
from .tokens import chunked, crc_of

SEGMENT = 1 << 20
BLOCK = 512
BATCH_CHARS = 4_000_000
SCHEMA = "bucket int, part int, first_token long, n_tokens long, n_docs int, doc_ids binary, null_ids binary, doc_sizes binary, levels array<binary>, bitmaps array<binary>, ranks array<binary>"


class DirectCodes:
    """Ids of one segment."""

    def __init__(self, levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes]):
        self.levels = [np.frombuffer(x, np.uint8) for x in levels]
        self.bitmaps = [np.frombuffer(x, np.uint8) for x in bitmaps]
        self.ranks = [np.frombuffer(x, "<u4") for x in ranks]

    @staticmethod
    def encode(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
        levels, bitmaps, ranks = [], [], []
        rest = ids.astype(np.uint32)
        while len(rest):
            more = rest > 255
            bits = np.packbits(more, bitorder="little")
            ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64)
            levels.append((rest & 255).astype(np.uint8).tobytes())
            bitmaps.append(bits.tobytes())
            ranks.append((np.cumsum(ones) - ones).astype("<u4").tobytes())
            rest = rest[more] >> 8
        return levels, bitmaps, ranks

    def rank(self, level: int, i: int) -> int:
        """Ones of the level's bitmap before bit i; looks at one directory entry and one block."""
        block = i // BLOCK
        if block >= len(self.ranks[level]):
            return self.rank(level, i - 1) + self.bit(level, i - 1) if i else 0
        bits = np.unpackbits(self.bitmaps[level][block * BLOCK // 8 : (i + 7) // 8], bitorder="little")
        return int(self.ranks[level][block]) + int(bits[: i - block * BLOCK].sum())

    def bit(self, level: int, i: int) -> int:
        return int(self.bitmaps[level][i // 8] >> (i % 8)) & 1

    def get(self, i: int) -> int:
        value = shift = 0
        for level, chunks in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if not self.bit(level, i):
                break
            i, shift = self.rank(level, i), shift + 8
        return value

    def range(self, a: int, b: int) -> np.ndarray:
        """Ids a to b - 1: two ranks a level give the run on the next one."""
        out, at = np.zeros(b - a, np.uint32), np.arange(b - a)
        for level, chunks in enumerate(self.levels):
            if not len(at):
                break
            out[at] |= chunks[a:b].astype(np.uint32) << np.uint32(8 * level)
            bits = np.unpackbits(self.bitmaps[level][a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            a, at = self.rank(level, a), at[bits]
            b = a + len(at)
        return out


def _encoder(tokenizer: str, end_id: int):
    schema = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()), ("n_docs", pa.int32()), *((k, pa.binary()) for k in ("doc_ids", "null_ids", "doc_sizes")), *((k, pa.list_(pa.binary())) for k in ("levels", "bitmaps", "ranks"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = chunked(tokenizer)
        bucket, part, done, held, ids, sizes = None, 0, 0, [], [], []

        def segment() -> pa.RecordBatch:
            nonlocal part, done
            flat = np.concatenate(ids)
            levels, bitmaps, ranks = DirectCodes.encode(flat)
            row = [bucket, part, done, len(flat), len(held), np.array([x or 0 for x in held], "<i8").tobytes(), np.packbits([x is None for x in held]).tobytes(), np.concatenate(sizes).astype("<u4").tobytes(), levels, bitmaps, ranks]
            part, done = part + 1, done + len(flat)
            for x in (held, ids, sizes):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            buckets, docs, texts = (batch.column(i).to_pylist() for i in range(3))
            edges = [0, *(i for i in range(1, len(buckets)) if buckets[i] != buckets[i - 1]), len(buckets)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if buckets[lo] != bucket:
                    if held:
                        yield segment()
                    bucket, part, done = buckets[lo], 0, 0
                for a, b in slices([len(t) for t in texts[lo:hi]], BATCH_CHARS):
                    own = texts[lo + a : lo + b]
                    flat, n = coder.encode(own)
                    at = np.cumsum(n)
                    held.extend(docs[lo + a : lo + b])
                    ids.append(np.insert(flat, at, end_id))
                    sizes.append(n + 1)
                    if sum(map(len, ids)) >= SEGMENT:
                        yield segment()
        if held:
            yield segment()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode every text, end each with end_id, and write the file format to path in ascending order of doc_id and text. One shuffle, by buckets of both."""
    spark, rows = docs.sparkSession, documents(docs)
    n = tasks_for(spark)
    cuts = id_buckets(rows, n)
    dealt = rows.select(bucket_of(F.col("doc_id"), F.col("text"), cuts).alias("bucket"), "doc_id", "text").repartitionById(len(cuts) + 1, F.col("bucket")).sortWithinPartitions("bucket", "doc_id", "text")
    dealt.mapInArrow(_encoder(tokenizer, end_id), SCHEMA).write.parquet(path)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with base, the ids in all buckets before theirs. The totals by bucket, as few as there are partitions, pass the driver."""
    rows = spark.read.parquet(path)
    before, base = 0, []
    for bucket, n in sorted(rows.groupBy("bucket").agg(F.sum("n_tokens")).collect()):
        base.append((bucket, before))
        before += n
    bases = spark.createDataFrame(base, "bucket int, base long")
    return rows.join(F.broadcast(bases), "bucket")


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """A row for each document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids if asked, by random access to the codes."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.binary())] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes = DirectCodes(row["levels"], row["bitmaps"], row["ranks"])
                sizes = np.frombuffer(row["doc_sizes"], "<u4").astype(np.int64)
                to = np.cumsum(sizes)
                docs = np.frombuffer(row["doc_ids"], "<i8")
                null = np.unpackbits(np.frombuffer(row["null_ids"], np.uint8))[: len(docs)].astype(bool)
                ids = [codes.range(b - n, b) for b, n in zip(to.tolist(), sizes.tolist())]
                columns = [pa.array(docs, mask=null), pa.array(row["base"] + row["first_token"] + to - sizes), pa.array(sizes), pa.array([crc_of(x) for x in ids], pa.int64())]
                columns += [pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())] if with_ids else []
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    return _segments(spark, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def read_token(spark: SparkSession, path: str, position: int) -> int:
    """The id at a place of the whole corpus. Which segment holds it is told from their counts; of the codes only that segment's are read, by its bucket and part."""
    sizes = spark.read.parquet(path).select("bucket", "part", "first_token", "n_tokens")
    base = {r["bucket"]: r["n"] for r in sizes.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).collect()}
    at = position
    for bucket in sorted(base):
        if 0 <= at < base[bucket]:
            break
        at -= base[bucket]
    else:
        raise IndexError(position)
    part = sizes.where((F.col("bucket") == bucket) & (F.col("first_token") <= at) & (F.col("first_token") + F.col("n_tokens") > at)).select("part", "first_token").first()
    row = spark.read.parquet(path).where((F.col("bucket") == bucket) & (F.col("part") == part["part"])).select("levels", "bitmaps", "ranks").first()
    return DirectCodes(row["levels"], row["bitmaps"], row["ranks"]).get(at - part["first_token"])
