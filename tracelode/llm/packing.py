"""Packing documents into sequences of a fixed number of tokens by length patterns.

The histogram of piece lengths is fitted by non-negative least squares: candidate patterns are the lengths of at most
MOST pieces that fill a sequence, and their repeat counts are the unknowns. Counts are rounded, the greatest first, as far
as there are pieces; what is left is fitted anew by patterns of its own lengths, and with growing slack, until a round
places little. Patterns place nearly all pieces; the last ones are packed by best fit, longest first, again on the
histogram, so that the plan's size depends on the sequence length alone, not on the number of documents. Each piece then
finds its place by its rank among those of its length.

Cases: a null text counts as empty (the end id alone); equal ids and repeated rows are packed each for itself; an
empty table gives an empty result; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialise, tasks_for
from .textnum import slices
from .tokens import chunked, crc_of

BATCH_CHARS, SALTS = 4_000_000, 4096
#: Pieces of a pattern at most, and the share of a sequence that a pattern may leave empty in the last rounds.
MOST, MOST_SLACK = 8, 1 / 64
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("salt", pa.int32())])


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, budget: int, keep_ids: bool = True) -> DataFrame:
    """Token pieces of every document; only documents of more than budget ids are cut. ids: little-endian unsigned 32-bit. salt: any number, to spread pieces that are alike in everything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, salt = chunked(tokenizer), 0
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices([len(t) for t in texts], BATCH_CHARS):
                flat, n = coder.encode(texts[a:b])
                flat, n = np.insert(flat, np.cumsum(n), end_id).astype("<u4"), n + 1
                out, at = [], 0
                for doc, size in zip(docs[a:b], n.tolist()):
                    for piece, start in enumerate(range(0, size, budget)):
                        ids = flat[at + start : at + min(start + budget, size)]
                        out.append((doc, piece, start, len(ids), crc_of(ids), ids.tobytes() if keep_ids else None, salt))
                        salt = (salt + 1) % SALTS
                    at += size
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PIECES)], schema=PIECES)

    return documents(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, salt int")


def candidate_patterns(counts: np.ndarray, budget: int, slack: int, rng: np.random.Generator, draws: int = 30_000) -> np.ndarray:
    """Rows of at most MOST lengths that occur, falling, then zeros, that fill budget up to slack.

    The first length is drawn by the tokens, further ones by the pieces that fit, and as soon as a length that occurs closes the sequence it is taken."""
    below = np.where(counts > 0, np.arange(budget + 1), 0)
    below[0] = 0
    below = np.maximum.accumulate(below)  # the greatest that occurs up to each
    if not below[-1]:
        return np.zeros((0, MOST), np.int64)
    pieces, tokens = np.cumsum(counts), np.cumsum(counts * np.arange(budget + 1))
    rows = np.zeros((draws, MOST), np.int64)
    rows[:, 0] = np.searchsorted(tokens, rng.random(draws) * tokens[-1], "right")
    room = budget - rows[:, 0]
    full = room <= slack
    for k in range(1, MOST):
        last = below[room]
        close = ~full & (last > 0) & (room - last <= slack)
        rows[close, k] = last[close]
        if k < MOST - 1:
            more = ~full & ~close & (last > 0)
            rows[more, k] = np.searchsorted(pieces, rng.random(more.sum()) * pieces[room[more]], "right")
        room, full = room - rows[:, k], full | close
    return np.unique(-np.sort(-rows[full], 1), axis=0)


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, rounds: int = 80) -> np.ndarray:
    """Repeat counts x >= 0 that fit the histogram in least squares: multiplicative updates keep them non-negative."""
    n, h = len(counts), counts.astype(float)
    held = np.arange(n) > 0
    cover = lambda x: np.bincount(patterns.ravel(), np.repeat(x, patterns.shape[1]), n) * held
    goal = (h * held)[patterns].sum(1)
    x = np.full(len(patterns), counts.sum() / max(1, (patterns > 0).sum()))
    for _ in range(rounds):
        x *= goal / np.maximum(cover(x)[patterns].sum(1), 1e-9)
    return x


def round_repeats(patterns: np.ndarray, x: np.ndarray, left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Whole repeats, the greatest first, at least one of each pattern whose pieces are still there; takes them off `left`."""
    out = []
    for i in np.argsort(-x, kind="stable"):
        lengths, times = np.unique(patterns[i][patterns[i] > 0], return_counts=True)
        repeats = min(int((left[lengths] // times).min()), max(1, round(float(x[i]))))
        if repeats:
            left[lengths] -= times * repeats
            out.append((tuple(int(l) for l in patterns[i] if l), repeats))
    return out


def fitted(counts: np.ndarray, budget: int) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Patterns with repeat counts by rounds of fitting and rounding, and the histogram of what they leave. Slack grows when a round places less than a fiftieth of what is there."""
    left, chosen, slack, rng = counts.copy(), [], 0, np.random.default_rng(5)
    while left.sum():
        patterns, before = candidate_patterns(left, budget, slack, rng), left.sum()
        if len(patterns):
            chosen += round_repeats(patterns, fit_repeats(patterns, left), left)
        if before - left.sum() < 0.02 * before:
            if slack >= budget * MOST_SLACK:
                break
            slack = max(1, slack * 4)
    return chosen, left


def best_fit(counts: np.ndarray, budget: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, with equal bins kept as one pattern and a repeat count."""
    free, bins = np.zeros(budget + 1, np.int64), defaultdict(list)
    for length in range(budget, 0, -1):
        left = int(counts[length])
        while left:
            fits = np.flatnonzero(free[length:])
            if len(fits):
                room = int(fits[0]) + length
                lengths, repeats = bins[room].pop()
                used = min(left, repeats)
                free[room] -= used
                if repeats > used:
                    bins[room].append((lengths, repeats - used))
            else:
                room, lengths, used = budget, (), left
            most = 1 if lengths else min(used, room // length)  # fresh bins take as many as they hold
            whole = used // most if most > 1 else used
            if most > 1:
                used = whole * most
            grown, rest = lengths + (length,) * most, room - length * most
            bins[rest].append((grown, whole))
            free[rest] += whole
            left -= used
    return [x for held in bins.values() for x in held]


def plan(counts: np.ndarray, budget: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with repeat counts that hold every piece of the histogram (counts[length])."""
    chosen, left = fitted(counts, budget)
    return chosen + best_fit(left, budget)


def _slots(chosen: list[tuple[tuple[int, ...], int]], budget: int) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, offset), ascending by rank."""
    slots, next_rank, sequence = defaultdict(list), np.zeros(budget + 1, np.int64), 0
    for lengths, repeats in chosen:
        offset = 0
        for length in lengths:
            slots[length].append((int(next_rank[length]), sequence, offset))
            next_rank[length] += repeats
            offset += length
        sequence += repeats
    return {k: np.array(v, np.int64) for k, v in slots.items()}


def pack(pieces: DataFrame, budget: int) -> DataFrame:
    """Adds sequence_id and offset to pieces, which must be a written table (it is read three times). Only the histogram, of budget bins, passes the driver.

    Ranks among pieces of equal length are taken in blocks, so that a length, or a document, which a third of all pieces share is spread over many tasks."""
    spark = pieces.sparkSession
    counts = np.zeros(budget + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        counts[length] = n
    slots = spark.sparkContext.broadcast(_slots(plan(counts, budget), budget))
    blocks = max(64, tasks_for(spark))
    keyed = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(blocks)))
    sizes = keyed.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = sizes.select("length", "block", (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = keyed.withColumn("within", within).join(before, ["length", "block"]).withColumn("rank", F.col("before") + F.col("within")).drop("block", "before", "within", "salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for one in np.unique(length):
                own, rows = np.flatnonzero(length == one), slots.value[int(one)]
                at = rows[np.searchsorted(rows[:, 0], rank[own], "right") - 1]
                seq[own], off[own] = at[:, 1] + rank[own] - at[:, 0], at[:, 2]
            kept = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(seq), pa.array(off)], [*kept.schema.names, "sequence_id", "offset"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank"]
    return ranked.mapInArrow(run, ", ".join([*fields, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, budget: int, keep_ids: bool = True) -> DataFrame:
    """Every document's pieces with their ids and places."""
    pieces = materialise(cut_pieces(docs, tokenizer, end_id, budget, keep_ids), "pieces")
    return pack(pieces, budget)


def sequences(packed: DataFrame) -> DataFrame:
    """The filled sequences: sequence_id, ids (joined by offset) and doc_ids. A group holds one sequence, so it is bounded by the budget."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    grouped = packed.groupBy("sequence_id").agg(rows.alias("rows"))
    ids = F.aggregate("rows", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return grouped.select("sequence_id", ids.alias("ids"), F.col("rows.doc_id").alias("doc_ids"))
