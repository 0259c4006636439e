"""Benchmark decontamination by SimHash over item-sized windows.

Every item has a 256-bit SimHash of its five-word shingles, each weighted by how often it occurs: its second time counts as
an element of its own, its third likewise, so that weighted similarity is that of sets. In documents, windows of
as many words as an item has are fingerprinted likewise. Sixteen blocks of 16 bits make the index: two fingerprints within
63 bits agree in some block up to three bits, so a table of all values within three bits of each item's blocks finds every
item within the radius. Candidates are then verified by exact weighted Jaccard similarity of shingles. At similarity 0.8,
fingerprints differ in 39 bits on average, with a deviation of 6, so the radius lies four deviations away, whether shingles repeat or not.

The documents are read once. Windows that can't reach the threshold, as fewer than that share of their shingles occur in any
item, aren't fingerprinted (weighted similarity is at most that share); the others, joined where they overlap, are written as
passages: their shingles alone, cut into pieces of a bounded length. A filter of a bounded number of bits (2**MOST_BITS), which
may only err by letting too much through, says which shingles occur. Items lie in blocks of at most ITEMS_AT_ONCE items and
WORDS_AT_ONCE words. Passages meet blocks by a join on shingles: whatever is similar enough to an item holds one of its rarest
shingles at least, if as many are taken as may be missing and one more, so only these are joined. A block and the passages
that it met make cells of at most some CELL shingles, so an item that a third of all documents hold is spread over many tasks;
each cell has the Hamming index of its block. The number of jobs doesn't depend on the benchmark.

A document of fewer words than an item, an item cut short, is one window as a whole, and is held against all longer items.

Cases: null texts count as empty, and items without words match nothing; items of one to four words have one shingle, all
their words, and windows of that length likewise; equal items are reported each, once for each item_id; rows that repeat a doc_id share
their rows in the result, which tell of the best window in any of them, but are kept or dropped each by its own text; null doc_ids and
item_ids are kept; an empty table on either side gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialise
from .textnum import SHINGLE, Words, mix, short_runs, slices

BITS, BLOCKS, RADIUS = 256, 16, 63
ITEMS_AT_ONCE, WORDS_AT_ONCE = 512, 1 << 21
BATCH_CHARS = 1_000_000
CELL = 1 << 18  # shingles of passages that a task holds against a block at once
LEAST_BITS, MOST_BITS = 22, 27
PIECE, STEP = 1 << 15, 2048
_NEAR = np.array(sorted({sum(1 << b for b in c) for k in range(RADIUS // BLOCKS + 1) for c in combinations(range(16), k)}), np.uint32)


def _signs(shingles: np.ndarray) -> np.ndarray:
    """For each shingle 256 values of -1 or 1."""
    words = np.stack([mix(shingles + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)) for k in range(BITS // 64)], 1)
    return np.unpackbits(words.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def window_simhash(shingles: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints (rows of 32 bytes) of the runs of n shingles at starts (ascending); the second, third, ... time that a run holds a shingle counts as a shingle of its own.

    So fingerprints of runs with repeated shingles are as far apart as those of sets of the same (weighted) similarity; one heavy shingle doesn't rule them.
    Sums are kept at the runs' edges only, so memory follows the number of runs, however long they are."""
    edges = np.unique(np.concatenate([starts, starts + n]))
    sums, so_far, low = np.zeros((len(edges), BITS), np.int32), np.zeros(BITS, np.int32), edges[0] if len(edges) else 0
    for a in range(low, edges[-1] if len(edges) else 0, STEP):
        part = np.cumsum(_signs(shingles[a : min(a + STEP, edges[-1])]), 0, dtype=np.int32) + so_far
        lo, hi = np.searchsorted(edges, [a, a + STEP], "right")
        sums[lo:hi] = part[edges[lo:hi] - a - 1]
        so_far = part[-1]
    return np.packbits(sums[np.searchsorted(edges, starts + n)] - sums[np.searchsorted(edges, starts)] + _repeated(shingles, starts, n) > 0, axis=1)


def _repeated(shingles: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray | int:
    """What the sums of window_simhash change by if a shingle's j-th time in a run has signs of its own.

    A place is the j-th of its shingle for the runs that start after the one j places of it before, and not after the one before that: an interval of starts, so differences at its ends are summed up."""
    if not len(starts):
        return 0
    low, high = int(starts[0]), int(starts[-1]) + n
    own = shingles[low:high]
    order = np.argsort(own, kind="stable")
    before = np.full(len(own), -1)
    same = own[order[1:]] == own[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    place = np.flatnonzero((before >= 0) & (np.arange(len(own)) - before < n))
    if not len(place):
        return 0
    steps, near, j = np.zeros((len(starts) + 1, BITS), np.int32), before[place], 1
    while len(place):
        far = before[near]
        left = np.searchsorted(starts - low, np.maximum(far, place - n) + 1)
        right = np.searchsorted(starts - low, near, "right")
        for a in range(0, len(place), STEP):
            at = a + np.flatnonzero(left[a : a + STEP] < right[a : a + STEP])
            s = own[place[at]]
            change = _signs(mix(s + np.uint64(0xD1B54A32D192ED03 * j % 2**64))).astype(np.int32) - _signs(s)
            np.add.at(steps, left[at], change)
            np.subtract.at(steps, right[at], change)
        on = (far >= 0) & (place - far < n)
        place, near, j = place[on], far[on], j + 1
    return np.cumsum(steps[:-1], 0)


def weighted_jaccard(x: np.ndarray, y: np.ndarray) -> float:
    a, m = np.unique(x, return_counts=True)
    b, n = np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = int(np.minimum(m[i], n[j]).sum())
    return both / (len(x) + len(y) - both)


def _enough(sums: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """Starts of the windows of n shingles of which that share is known; sums: of known shingles before each place."""
    return np.flatnonzero(sums[n:] - sums[:-n] >= threshold * n - 1e-9)


class HammingIndex:
    """Finds all items within RADIUS of a fingerprint."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        blocks = prints.view(np.uint16).astype(np.uint32)  # items x BLOCKS
        keys = (blocks[:, :, None] ^ _NEAR) | (np.arange(BLOCKS, dtype=np.uint32) << 16)[None, :, None]
        order = np.argsort(keys.ravel(), kind="stable")
        self.keys, self.items = keys.ravel()[order], (order // (BLOCKS * len(_NEAR))).astype(np.int32)

    def search(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, item) at most RADIUS bits apart, each once."""
        keys = (prints.view(np.uint16).astype(np.uint32) | (np.arange(BLOCKS, dtype=np.uint32) << 16)).ravel()
        lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        n = hi - lo
        query = np.repeat(np.arange(len(keys)) // BLOCKS, n)
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pairs = np.unique(query * len(self.prints) + self.items[at])
        query, item = pairs // len(self.prints), pairs % len(self.prints)
        apart = np.bitwise_count(prints[query] ^ self.prints[item]).sum(1, dtype=np.int64)
        return query[apart <= RADIUS], item[apart <= RADIUS]


class Items:
    """A block of items: their shingles, numbers of words and index."""

    def __init__(self, rows: list[tuple[int | None, int, bytes]]):
        self.ids, self.words = [r[0] for r in rows], np.array([r[1] for r in rows])
        self.shingles = [np.frombuffer(r[2], "<u8") for r in rows]
        self.lengths, which = np.unique(self.words, return_inverse=True)
        # Which shingles occur in items of which length: rows of (shingle, length), ascending.
        sizes = [len(s) for s in self.shingles]
        pairs = np.unique(np.stack([np.concatenate(self.shingles), np.repeat(which, sizes).astype(np.uint64)], 1), axis=0)
        self.every, first = np.unique(pairs[:, 0], return_index=True)
        self.first, self.of = np.append(first, len(pairs)), pairs[:, 1].astype(np.int64)
        self.index = HammingIndex(np.concatenate([window_simhash(s, np.zeros(1, int), len(s)) for s in self.shingles]))

    def places(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, number of a length), once for each length in whose items the shingle at that place occurs."""
        at = np.minimum(np.searchsorted(self.every, shingles), len(self.every) - 1)
        place = np.flatnonzero(self.every[at] == shingles)
        lo, n = self.first[at[place]], self.first[at[place] + 1] - self.first[at[place]]
        return np.repeat(place, n), self.of[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def matches(self, shingles: np.ndarray, sums: np.ndarray, threshold: float, length: int) -> Iterator[tuple[int, float, int]]:
        """(item, similarity, start) for the windows of `length` words among a run of shingles."""
        n = max(1, length - SHINGLE + 1)
        starts = _enough(sums, n, threshold)
        for a in range(0, len(starts), STEP):
            part = starts[a : a + STEP]
            query, item = self.index.search(window_simhash(shingles, part, n))
            fits = self.words[item] == length
            for at, i in zip(part[query[fits]].tolist(), item[fits].tolist()):
                similarity = weighted_jaccard(shingles[at : at + n], self.shingles[i])
                if similarity >= threshold - 1e-12:
                    yield i, similarity, at

    def longer(self, shingles: np.ndarray, threshold: float, words: int) -> Iterator[tuple[int, float, int]]:
        """Likewise for a whole document and items of more words than it has."""
        _, item = self.index.search(window_simhash(shingles, np.zeros(1, int), len(shingles)))
        for i in item[self.words[item] > words].tolist():
            similarity = weighted_jaccard(shingles, self.shingles[i])
            if similarity >= threshold - 1e-12:
                yield i, similarity, 0


class Known:
    """A filter of the items' shingles, and the items' numbers of words."""

    def __init__(self, bits: np.ndarray, lengths: list[int]):
        self.bits, self.lengths = bits, lengths
        self.shift = np.uint64(64 - (len(bits) * 8).bit_length() + 1)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        at = shingles >> self.shift
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, words, shingles (as bytes) and part, block, number: each part's items, numbered, in blocks of a bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, held, size = TaskContext.get().partitionId(), 0, 0, 0
        for batch in batches:
            ids, texts, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for a, b in slices([len(t) for t in texts], BATCH_CHARS):
                words = Words(texts[a:b])
                shingles, bounds = words.shingles()
                for i, n in enumerate(np.diff(words.bounds).tolist()):
                    if n:
                        if held and (held >= ITEMS_AT_ONCE or size + n > WORDS_AT_ONCE):
                            block, held, size = block + 1, 0, 0
                        held, size = held + 1, size + n
                        out.append((ids[a + i], n, shingles[bounds[i] : bounds[i + 1]].tobytes(), part, block, held))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int32()))], ["item_id", "words", "shingles", "part", "block", "number"])

    return benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "item_id long, words int, shingles binary, part int, block int, number int")


def _keys(rows: DataFrame) -> DataFrame:
    """A row for each distinct shingle of each row: its other columns, key (the shingle) and times (how often it occurs). The shingles are the last column."""
    kept = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(len(kept)).to_pylist()
            for a, b in slices([len(x) for x in raw], 8 * PIECE):
                found = [np.unique(np.frombuffer(x, "<i8"), return_counts=True) for x in raw[a:b]]
                row = pa.array(np.repeat(np.arange(a, b), [len(k) for k, _ in found]))
                keys, times = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(row) for k in range(len(kept))), pa.array(keys), pa.array(times, pa.int32())], [*kept, "key", "times"])

    types = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema][:-1]
    return rows.mapInArrow(run, ", ".join([*types, "key long", "times int"]))


def _rarest(items: DataFrame, threshold: float) -> DataFrame:
    """key, part, block: of each item its rarest shingles, as many as may be missing and one more.

    A text of that similarity to an item of n shingles holds threshold * n of them, each as often as it occurs. So it holds one of any that make up more than the rest, and boilerplate of many items is joined only for items that hold little else."""
    n = F.octet_length("shingles") / 8
    need = (n - F.ceil(F.lit(threshold) * n - 1e-9) + 1).cast("int").alias("need")
    keys = _keys(items.select("part", "block", "number", need, "shingles"))
    often = keys.groupBy("key").agg(F.count("*").alias("often"))
    before = Window.partitionBy("part", "block", "number").orderBy("often", "key").rowsBetween(Window.unboundedPreceding, -1)
    ranked = keys.join(often, "key").withColumn("before", F.coalesce(F.sum("times").over(before), F.lit(0)))
    return ranked.where("before < need").select("key", "part", "block").distinct()


def _filter(items: DataFrame, shingles: int) -> np.ndarray:
    """The items' shingles as set bits; tasks send their bits in slices, and slices are joined."""
    width = min(MOST_BITS, max(LEAST_BITS, (32 * shingles).bit_length()))
    size, cut = 1 << width - 3, 1 << 14

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, np.uint8)
        for batch in batches:
            for s in batch.column(0).to_pylist():
                at = np.frombuffer(s, "<u8") >> np.uint64(64 - width)
                np.bitwise_or.at(own, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        some = np.flatnonzero(own.reshape(-1, cut).any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([own[k * cut : (k + 1) * cut].tobytes() for k in some], pa.binary())], ["k", "bits"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}  # at most a task's share of the filter
        for batch in batches:
            for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own[k] = own[k] | np.frombuffer(b, np.uint8) if k in own else np.frombuffer(b, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([b.tobytes() for b in own.values()], pa.binary())], ["k", "bits"])

    out = np.zeros(size, np.uint8)
    for k, b in items.select("shingles").mapInArrow(bits, "k int, bits binary").repartition(8, "k").mapInArrow(joined, "k int, bits binary").collect():
        out[k * cut : (k + 1) * cut] = np.frombuffer(b, np.uint8)
    return out


_PASSAGE = pa.schema([("pid", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("size", pa.int32()), ("first_word", pa.int64()), ("whole", pa.int64()), ("shingles", pa.binary())])


def _runs(covered: np.ndarray, reach: int) -> Iterator[tuple[int, int]]:
    """From and to of the runs of True, in pieces that overlap by the longest window."""
    edge = np.flatnonzero(np.diff(covered, prepend=False, append=False))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        for at in range(a, max(a + 1, b - reach + 1), PIECE):
            yield at, min(b, at + PIECE + reach - 1)


def _passages(docs: DataFrame, known: Known, threshold: float) -> DataFrame:
    """Runs of shingles in which a window may match: pid (a number of its own), doc_id, h (of the text), size (words a shingle), first_word, whole (words of the document, if it is one window as a whole), shingles."""
    sent = docs.sparkSession.sparkContext.broadcast((known.bits, known.lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(*sent.value)
        pid = TaskContext.get().partitionId() << 40
        full, short = [n - SHINGLE + 1 for n in known.lengths if n >= SHINGLE], [n for n in known.lengths if n < SHINGLE]
        for batch in batches:
            ids, hashes, texts = (c.to_pylist() for c in batch.columns)
            for a, b in slices([len(t) for t in texts], BATCH_CHARS):
                words, out = Words(texts[a:b]), []
                shingles, bounds = words.shingles()
                hit, counts = known(shingles), np.diff(words.bounds)
                before = np.concatenate([[0], np.cumsum(hit)])
                for d in np.flatnonzero((before[bounds[1:]] > before[bounds[:-1]]) & (counts >= SHINGLE)).tolist():
                    own = shingles[bounds[d] : bounds[d + 1]]
                    sums, edge = before[bounds[d] : bounds[d + 1] + 1], np.zeros(len(own) + 1, np.int32)
                    for n in full:
                        if n <= len(own):
                            starts = _enough(sums, n, threshold)
                            edge[starts] += 1
                            edge[starts + n] -= 1
                    out += [(ids[a + d], hashes[a + d], SHINGLE, x, None, own[x:y].tobytes()) for x, y in _runs(np.cumsum(edge[:-1]) > 0, max(full, default=1))]
                    if counts[d] < known.lengths[-1] and sums[-1] - sums[0] >= threshold * len(own) - 1e-9:
                        out.append((ids[a + d], hashes[a + d], SHINGLE, 0, int(counts[d]), own.tobytes()))
                for n in short:
                    for d in np.flatnonzero(counts >= n).tolist():
                        own = short_runs(words, d, n)
                        out += [(ids[a + d], hashes[a + d], n, x, None, own[x:y].tobytes()) for x, y in _runs(known(own), 1)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([range(pid, pid + len(out)), *zip(*out)], _PASSAGE)], schema=_PASSAGE)
                    pid += len(out)

    rows = documents(docs).select("doc_id", F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(run, "pid long, doc_id long, h long, size int, first_word long, whole long, shingles binary")


_FOUND = "doc_id long, h long, item_id long, similarity double, first_word long, n_words long"
_MATCHES = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())])
_BUILT: dict[tuple, Items] = {}


def _built(rows: list[tuple], key: tuple) -> Items:
    """A block's index; that of the last block is kept for its next cell."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Items(rows)
    return _BUILT[key]


def _found(items: Items, passages: pa.RecordBatch, threshold: float) -> pa.RecordBatch:
    """Matches of passages with the items of a block."""
    best: dict = {}
    for doc, h, size, first, whole, raw in zip(*(passages.column(c).to_pylist() for c in ("doc_id", "h", "size", "first_word", "whole", "shingles"))):
        shingles = np.frombuffer(raw, "<u8")
        place, length = items.places(shingles)
        if whole is not None:
            found = [(whole, m) for m in items.longer(shingles, threshold, whole)] if len(np.unique(place)) >= threshold * len(shingles) - 1e-9 else []
        else:
            found, often = [], np.bincount(length, minlength=len(items.lengths))
            for k in np.flatnonzero(often).tolist():
                n = int(items.lengths[k])
                if often[k] >= threshold * max(1, n - SHINGLE + 1) - 1e-9 and (n == size if size < SHINGLE else SHINGLE <= n < len(shingles) + SHINGLE):
                    # Of a window's shingles that share must occur in items of its own length.
                    hit = np.zeros(len(shingles) + 1, np.int64)
                    hit[place[length == k] + 1] = 1
                    found += [(n, m) for m in items.matches(shingles, np.cumsum(hit), threshold, n)]
        for n, (i, similarity, at) in found:
            told = (similarity, -first - at, n)
            best[doc, h, i] = max(told, best.get((doc, h, i), told))
    rows = [(doc, h, items.ids[i], s, -at, n) for (doc, h, i), (s, at, n) in best.items()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_MATCHES)], schema=_MATCHES)


def _held_against(passages: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """Matches of the passages with the items of the blocks that they meet, cell by cell."""
    meets = _keys(passages.select("pid", (F.octet_length("shingles") / 8).cast("int").alias("n"), "shingles")).join(materialise(_rarest(items, threshold), "rarest"), "key")
    meets = materialise(meets.select("pid", "n", "part", "block").distinct(), "meets")
    # A row for every block of items that was met: some ITEMS_AT_ONCE times fewer than there are items, so that Spark broadcasts it while it is small.
    cells = materialise(meets.groupBy("part", "block").agg(F.ceil(F.sum("n") / CELL).cast("int").alias("cells")), "cells")
    left = meets.join(cells, ["part", "block"]).withColumn("cell", F.pmod(F.xxhash64("pid"), F.col("cells")).cast("int")).drop("n", "cells").join(passages, "pid")
    right = items.join(cells, ["part", "block"]).withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).drop("cells")
    query = uuid.uuid4().hex

    def run(key: tuple, passages: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(passages):
            return _MATCHES.empty_table()
        block = _built([tuple(r.values()) for r in rows.select(["item_id", "words", "shingles"]).to_pylist()], (query, key[0].as_py(), key[1].as_py()))
        return pa.Table.from_batches([_found(block, b, threshold) for b in passages.to_batches(max_chunksize=256)], _MATCHES)

    return left.groupBy("part", "block", "cell").cogroup(right.groupBy("part", "block", "cell")).applyInArrow(run, _FOUND)


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """A row at least for each text (doc_id and h, the hash of the text) and item of which it holds a near copy, as a written table."""
    items = materialise(_items(benchmark), "items")
    total = items.agg(F.sum(F.octet_length("shingles") / 8)).first()[0]
    if not total:
        return docs.sparkSession.createDataFrame([], _FOUND)
    lengths = sorted(r[0] for r in items.select("words").distinct().collect())  # a row for every length that occurs
    passages = materialise(_passages(docs, Known(_filter(items, int(total)), lengths), threshold), "passages")
    return materialise(_held_against(passages, items, threshold), "matches")


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """A row for each doc_id and item of which the document holds a near copy: doc_id, item_id, similarity of the best window (the first of equals), its first word and its number of words."""
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("at"), "n_words"))
    rows = matches(docs, benchmark, threshold).groupBy("doc_id", "item_id").agg(best.alias("b"))
    return rows.select("doc_id", "item_id", "b.similarity", (-F.col("b.at")).alias("first_word"), "b.n_words")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id and item_ids of the documents that hold a near copy of an item; equal doc_ids share a row."""
    return leaks(docs, benchmark, threshold).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The documents, all columns, without those whose text holds a near copy of an item.

    The rows to drop are a small written table, ids and hashes of texts, which Spark broadcasts while it is below its own threshold; no text is shuffled then."""
    bad = materialise(matches(docs, benchmark, threshold).select("doc_id", "h").distinct(), "leaked")
    text = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["doc_id"]) & (text == bad["h"]), "left_anti")
