"""Language-model scores by prediction by partial matching over bytes.

A text's bytes (A-Z lower-cased) and an end symbol are coded one by one after their last ORDER bytes. A context predicts the
symbols that followed it in training, with estimate (2c - 1) / 2T, and escapes to the next shorter one with q / 2T (c: count,
T: sum, q: distinct symbols). After an escape the symbols of the longer context are excluded from the shorter one's counts.
Below the empty context all symbols left are alike. Code lengths are log10 probabilities, summed by document.

Pretrained scoring on Spark: documents are gathered into units of some megabytes, written once. Each unit asks for the
distinct (context, symbol) keys that it holds, with its training counts. Requests meet by hash of the key, so a frequent key
weighs one entry a unit; counts are summed, contexts are completed by their last three bytes, and every key's code length
travels back to the units that asked. Words for the base score go the same way. No part of the trie is broadcast but the counts
of contexts of two bytes, at most 2^24 of them.

Cases: a null text counts as empty (the end symbol alone); equal documents count each; a null doc_id is folded as empty text;
without training documents all symbols are alike; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, fold, materialise, tasks_for
from .textnum import _R, mix, slices

ORDER = 5
END = 255  # never a byte of UTF-8: end symbol and what stands before a text's start
SYMBOLS = 256
UNIT_BYTES, UNIT_DOCS = 12_000_000, 60_000
BUCKET_BYTES = 1 << 24  # of text a bucket of keys
PIECE = 1 << 20  # what is worked on at once within a unit
_UPPER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13, END]] = True
_END_WORD = np.uint64(0x5EED0FE4D0000001)


class Trie:
    """Counts of symbols after byte contexts, in memory, for one document or a small corpus."""

    def __init__(self, order: int = ORDER):
        self.order, self.counts = order, {}

    def log10(self, past: bytes, symbol: int) -> float:
        total, excluded = 0.0, {}
        for n in range(self.order, -1, -1):
            here = self.counts.get(past[len(past) - n :])
            if not here:
                continue
            left = {s: c for s, c in here.items() if s not in excluded}
            t = sum(left.values())
            if symbol in left:
                return total + math.log10((2 * left[symbol] - 1) / (2 * t))
            if t:
                total += math.log10(len(left) / (2 * t))
            excluded = here
        return total - math.log10(SYMBOLS - len(excluded))

    def learn(self, past: bytes, symbol: int) -> None:
        for n in range(self.order + 1):
            here = self.counts.setdefault(past[len(past) - n :], {})
            here[symbol] = here.get(symbol, 0) + 1

    def score(self, text: str, adapt: bool) -> float:
        data = bytes([END] * self.order) + text.encode("utf-8", "surrogatepass").translate(_UPPER) + bytes([END])
        total = 0.0
        for i in range(self.order, len(data)):
            past = data[i - self.order : i]
            total += self.log10(past, data[i])
            if adapt:
                self.learn(past, data[i])
        return total


def score_adaptive(docs: DataFrame) -> DataFrame:
    """doc_id and score with a trie that starts empty at each document and learns as it codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([Trie().score(t, True) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return documents(docs).mapInArrow(run, "doc_id long, score double")


# Units


def _units(docs: DataFrame, modulus: int, held: int) -> DataFrame:
    schema = pa.schema([("unit", pa.string()), ("ids", pa.binary()), ("nulls", pa.binary()), ("held", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, rows, size = TaskContext.get().partitionId(), 0, [], 0

        def unit() -> pa.RecordBatch:
            nonlocal number, size
            gap = bytes([END] * ORDER)
            data = zstandard.compress(gap + gap.join([*(r[2] for r in rows), b""]), 1)
            row = [f"{part}-{number}", np.array([r[0] or 0 for r in rows], "<i8").tobytes(), np.array([r[0] is None for r in rows]).tobytes(), np.array([r[1] for r in rows], bool).tobytes(), np.array([len(r[2]) for r in rows], "<i8").tobytes(), data]
            number, size = number + 1, 0
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for doc, text, out in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data = text.encode("utf-8", "surrogatepass").translate(_UPPER)
                rows.append((doc, out, data))
                size += len(data)
                if size >= UNIT_BYTES or len(rows) >= UNIT_DOCS:
                    yield unit()
        if rows:
            yield unit()

    rows = documents(docs).withColumn("held", fold(F.col("doc_id"), modulus) == held)
    return rows.mapInArrow(run, "unit string, ids binary, nulls binary, held binary, sizes binary, data binary")


class Unit:
    """A unit unpacked: sorted (key, document) words of its symbols, and hashes of its words."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.null = np.frombuffer(row["nulls"], bool)
        self.held = np.frombuffer(row["held"], bool)
        sizes = np.frombuffer(row["sizes"], "<i8")
        self.data = np.frombuffer(zstandard.decompress(row["data"]) + b"\0\0\0", np.uint8)
        self.starts = ORDER + np.cumsum(sizes + ORDER) - (sizes + ORDER)
        self.sizes = sizes

    def symbols(self) -> np.ndarray:
        """key << 16 | document, sorted; key: context, its last byte first, then the symbol."""
        window = np.ndarray((len(self.data) - 7,), "<u8", self.data, 0, (1,))
        ends = np.cumsum(self.sizes + 1)
        out = np.empty(ends[-1] if len(ends) else 0, np.uint64)
        for a, b in slices((self.sizes + 1).tolist(), PIECE):
            n = self.sizes[a:b] + 1
            to = np.cumsum(n)
            raw = window[np.repeat(self.starts[a:b] - ORDER - (to - n), n) + np.arange(to[-1])]
            key = (raw & np.uint64((1 << 40) - 1)) << np.uint64(8) | (raw >> np.uint64(40)) & np.uint64(255)
            out[ends[a] - n[0] : ends[b - 1]] = key << np.uint64(16) | np.repeat(np.arange(a, b, dtype=np.uint64), n)
        out.sort()
        return out

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash and document of each token, ends included (as the last ones)."""
        found, docs = [], []
        for a, b in slices((self.sizes + ORDER).tolist(), PIECE):
            lo = self.starts[a]
            data = self.data[lo : self.starts[b - 1] + self.sizes[b - 1] + 1]
            word = ~_SPACE[data]
            edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
            start, size = edge[0::2], edge[1::2] - edge[0::2]
            at = np.flatnonzero(word)
            place = at - np.repeat(start, size)
            sums = np.zeros(len(at) + 1, np.uint64)
            np.cumsum(data[at].astype(np.uint64) * _R[place & 4095], out=sums[1:])
            to = np.cumsum(size)
            found.append(mix(sums[to] - sums[to - size] + size.astype(np.uint64)))
            docs.append(np.searchsorted(self.starts, start + lo, "right") - 1)
        n = len(self.sizes)
        return np.concatenate([*found, np.full(n, _END_WORD)]), np.concatenate([*docs, np.arange(n)])


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start in a sorted array."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _changes(s: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start among a unit's sorted symbols."""
    parts = [np.flatnonzero((s[a : a + PIECE] ^ s[a - 1 : a - 1 + len(s[a : a + PIECE])]) >> np.uint64(16)) + a for a in range(1, len(s), PIECE)]
    return np.concatenate([np.zeros(min(1, len(s)), np.int64), *parts])


def _by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts sorted keys by bucket, and the buckets' edges."""
    bucket = (mix(keys) % np.uint64(buckets)).astype(np.uint16 if buckets < 65536 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _packed(x: np.ndarray, width: int) -> bytes:
    """Byte planes of the low `width` bytes, compressed: sorted keys have even high planes."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize)[:, :width].T).tobytes(), 1)


def _unpacked(blob: bytes, width: int, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = planes.T
    return out.view(kind).ravel()


#: Bytes of a key by kind: five of context and a symbol; a word's hash.
WIDTH = (6, 8)
#: Bytes and type of the value told for a key: a code length; a count.
VALUE = ((4, "<f4"), (8, "<i8"))


def _asked(unit: Unit) -> list[tuple[np.ndarray, np.ndarray]]:
    """For symbols, then words: distinct keys, sorted, and their counts in training documents."""
    s = unit.symbols()
    at = _changes(s)
    train = np.concatenate([~unit.held[(s[a : a + PIECE] & np.uint64(65535)).astype(np.int64)] for a in range(0, len(s), PIECE)] or [np.zeros(0, bool)])
    grams = s[at] >> np.uint64(16), np.add.reduceat(train, at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)
    del s, train
    hashes, doc = unit.words()
    words, where = np.unique(hashes, return_inverse=True)
    return [grams, (words, np.bincount(where, ~unit.held[doc], len(words)).astype(np.int64))]


def _requests(units: DataFrame, buckets: int) -> DataFrame:
    names = ["unit", "kind", "bucket", "keys", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for kind, (keys, counts) in enumerate(_asked(Unit(row))):
                    order, edge = _by_bucket(keys, buckets)
                    keys, counts = keys[order], counts[order].astype("<u4")
                    width = WIDTH[kind]
                    parts = [(b, x, y) for b, (x, y) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())) if y > x]
                    cut = lambda a, w: pa.array([_packed(a[x:y], w) for _, x, y in parts], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([row["unit"]] * len(parts)), pa.array([kind] * len(parts), pa.int32()), pa.array([b for b, _, _ in parts], pa.int32()), cut(keys, width), cut(counts, 4)], names)

    return units.mapInArrow(run, "unit string, kind int, bucket int, keys binary, counts binary")


def _column(table: pa.Table, name: str, width: int, kind: str = "<u8") -> list[np.ndarray]:
    return [_unpacked(x, width, kind) for x in table.column(name).to_pylist()]


def _summed(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate(_column(table, "keys", width)), np.concatenate(_column(table, "counts", 4, "<u4")).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = _runs(keys)
    return keys[at], np.add.reduceat(counts[order], at)


def _totals(requests: DataFrame, groups: int) -> DataFrame:
    """Distinct keys of each bucket with their counts, cut by groups of contexts of three bytes (words: group -1). A row's n_keys and n_tokens count what occurs in training."""
    names = ["kind", "bucket", "part", "keys", "counts", "n_keys", "n_tokens"]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        kind, bucket = key[0].as_py(), key[1].as_py()
        keys, counts = _summed(table, WIDTH[kind])
        if kind:
            rows = [(kind, bucket, -1, keys, counts)]
        else:
            part = (mix(keys >> np.uint64(24)) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edge = np.searchsorted(part[order], np.arange(groups + 1))
            rows = [(kind, bucket, g, keys[order[a:b]], counts[order[a:b]]) for g, (a, b) in enumerate(zip(edge[:-1], edge[1:])) if b > a]
        rows = [(*r[:3], _packed(r[3], WIDTH[kind]), _packed(r[4].astype("<i8"), 8), int((r[4] > 0).sum()), int(r[4].sum())) for r in rows]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return requests.groupBy("kind", "bucket").applyInArrow(run, "kind int, bucket int, part int, keys binary, counts binary, n_keys long, n_tokens long")


def _short_counts(totals: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of (two bytes, symbol), at most 2^24 of them, for the shortest contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts = _unpacked(row["keys"], WIDTH[0], "<u8"), _unpacked(row["counts"], 8, "<i8")
                keys, counts = keys[counts > 0], counts[counts > 0]
                short = (keys >> np.uint64(32)) << np.uint64(8) | keys & np.uint64(255)
                found, where = np.unique(short, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(np.bincount(where, counts, len(found)).astype(np.int64))], ["k", "n"])

    rows = totals.where("kind = 0").select("keys", "counts").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).orderBy("k").toArrow()
    return rows.column("k").to_numpy().astype(np.uint64), rows.column("n").to_numpy()


class Level:
    """Contexts of one order: symbols' counts, and by context their sum, number, and what exclusion leaves one order down."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, lower: "Level | None"):
        at = _runs(pairs)
        self.pairs, self.counts = pairs[at], np.add.reduceat(counts, at) if len(at) else counts[:0]
        context = self.pairs >> np.uint64(8)
        at = _runs(context)
        self.contexts, self.number = context[at], np.diff(np.append(at, len(context)))
        self.sum = np.add.reduceat(self.counts, at) if len(at) else self.counts[:0]
        if lower is not None and len(at):
            under = np.add.reduceat(lower.count(lower.shorter(self.pairs)), at)
            parent = lower.find(lower.contexts, lower.shorter(self.pairs[at]) >> np.uint64(8))[0]
            self.left_sum, self.left_number = lower.sum[parent] - under, lower.number[parent] - self.number

    @staticmethod
    def find(values: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(values, asked), max(len(values) - 1, 0))
        return at, values[at] == asked if len(values) else np.zeros(len(asked), bool)

    def count(self, pairs: np.ndarray) -> np.ndarray:
        at, found = self.find(self.pairs, pairs)
        return np.where(found, self.counts[at], 0) if len(self.pairs) else np.zeros(len(pairs), np.int64)

    def shorter(self, pairs: np.ndarray) -> np.ndarray:
        """Pairs of one order up, as pairs of this one: without the context's farthest byte."""
        return pairs >> np.uint64(16) << np.uint64(8) | pairs & np.uint64(255)


def code_lengths(keys: np.ndarray, counts: np.ndarray, short: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 probability of each key's symbol after its context. keys must hold all those of their last three bytes; short: what _short_counts returns."""
    levels: dict[int, Level] = {}

    def pairs_of(n: int, of: np.ndarray = keys) -> np.ndarray:
        return of >> np.uint64(8 * (ORDER + 1 - n)) << np.uint64(8) | of & np.uint64(255)

    seen, times = keys[counts > 0], counts[counts > 0]
    below = None
    for n in range(ORDER + 1):
        if n < 3:
            pairs, c = short[0] >> np.uint64(8 * (3 - n)) << np.uint64(8) | short[0] & np.uint64(255), short[1]
        else:
            pairs, c = pairs_of(n, seen), times
        order = np.argsort(pairs, kind="stable")
        below = levels[n] = Level(pairs[order], c[order], below)
    out, open_, above = np.zeros(len(keys)), np.arange(len(keys)), np.full(len(keys), -1)
    # above: for the keys still open, the place of the longer context in its level, or -1 if that never occurred
    for n in range(ORDER, -1, -1):
        level, pairs = levels[n], pairs_of(n, keys[open_])
        at, found = level.find(level.contexts, pairs >> np.uint64(8))
        if not found.any():
            continue
        t, q = np.where(found, level.sum[at], 0), np.where(found, level.number[at], 0)
        if n < ORDER and len(levels[n + 1].contexts):
            longer = above >= 0
            t[longer], q[longer] = levels[n + 1].left_sum[above[longer]], levels[n + 1].left_number[above[longer]]
        c = level.count(pairs)
        coded, escaped = found & (c > 0), found & (c == 0) & (t > 0)
        out[open_[coded]] += np.log10((2 * c[coded] - 1) / (2 * t[coded]))
        out[open_[escaped]] += np.log10(q[escaped] / (2 * t[escaped]))
        above = np.where(found, at, -1)[~coded]
        open_ = open_[~coded]
    out[open_] -= np.log10(SYMBOLS - len(levels[0].pairs))
    return out


def _coded(totals: DataFrame, short: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """By bucket: keys and the values that units are told: code lengths for symbols, counts for words."""
    sent = totals.sparkSession.sparkContext.broadcast(short)
    names = ["kind", "bucket", "keys", "values"]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        parts = _column(table, "keys", WIDTH[0])
        keys = np.concatenate(parts)
        values = code_lengths(keys, np.concatenate(_column(table, "counts", 8, "<i8")), sent.value).astype("<f4")
        ends = np.cumsum([len(x) for x in parts])
        cut = [_packed(values[e - len(x) : e], 4) for e, x in zip(ends, parts)]
        return pa.Table.from_arrays([table.column("kind"), table.column("bucket"), table.column("keys"), pa.array(cut, pa.binary())], names)

    schema = "kind int, bucket int, keys binary, values binary"
    grams = totals.where("kind = 0").groupBy("part").applyInArrow(run, schema)
    return grams.unionByName(totals.where("kind = 1").select("kind", "bucket", "keys", F.col("counts").alias("values")))


def _answers(requests: DataFrame, coded: DataFrame) -> DataFrame:
    """To each request the values of its keys, in its order."""
    names = ["unit", "kind", "bucket", "values"]

    def run(key: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
        kind = key[0].as_py()
        keys, values = np.concatenate(_column(known, "keys", WIDTH[kind])), np.concatenate(_column(known, "values", *VALUE[kind]))
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        told = [values[np.searchsorted(keys, x)] for x in _column(asked, "keys", WIDTH[kind])]
        return pa.Table.from_arrays([asked.column("unit"), asked.column("kind"), asked.column("bucket"), pa.array([_packed(x, VALUE[kind][0]) for x in told], pa.binary())], names)

    grouped = requests.select("unit", "kind", "bucket", "keys").groupBy("kind", "bucket").cogroup(coded.groupBy("kind", "bucket"))
    return grouped.applyInArrow(run, "unit string, kind int, bucket int, values binary")


def _scores(units: DataFrame, answers: DataFrame, buckets: int, n: int, v: int) -> DataFrame:
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(key: tuple, unit: pa.Table, told: pa.Table) -> pa.Table:
        row = Unit(unit.to_pylist()[0])
        answers = {(k, b): x for k, b, x in zip(*(told.column(c).to_pylist() for c in ("kind", "bucket", "values")))}

        def values(kind: int, keys: np.ndarray) -> np.ndarray:
            order, _ = _by_bucket(keys, buckets)
            out = np.zeros(len(keys), VALUE[kind][1])
            out[order] = np.concatenate([_unpacked(answers[k], *VALUE[kind]) for k in sorted(answers) if k[0] == kind])
            return out

        docs = len(row.ids)
        s = row.symbols()
        at = _changes(s)
        each = np.repeat(values(0, s[at] >> np.uint64(16)), np.diff(np.append(at, len(s))))
        score = np.zeros(docs)
        for a in range(0, len(s), PIECE):
            score += np.bincount((s[a : a + PIECE] & np.uint64(65535)).astype(np.int64), each[a : a + PIECE], docs)
        del s, each
        hashes, doc = row.words()
        found, where = np.unique(hashes, return_inverse=True)
        c = values(1, found)[where]
        tokens = np.bincount(doc, minlength=docs)
        base = np.bincount(doc, np.log10(c + 1), docs) - tokens * math.log10(n + v + 1)
        columns = [pa.array(row.ids, mask=row.null), pa.array(row.held), pa.array(tokens), pa.array(np.bincount(doc, c > 0, docs).astype(np.int64)), pa.array(np.full(docs, n, np.int64)), pa.array(base), pa.array(score)]
        return pa.Table.from_arrays(columns, names)

    both = units.groupBy("unit").cogroup(answers.groupBy("unit"))
    return both.applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_pretrained(docs: DataFrame, modulus: int = 7, held: int = 2) -> DataFrame:
    """Scores every document by a trie of those whose fold isn't `held`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    # What a bucket holds is bounded by the size of the texts, whatever the session's number of partitions.
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(tasks_for(docs.sparkSession), -(-size // BUCKET_BYTES))
    units = materialise(_units(docs, modulus, held), "units")
    requests = materialise(_requests(units, buckets), "asked")
    totals = materialise(_totals(requests, buckets), "totals")
    n, v = totals.where("kind = 1").agg(F.sum("n_tokens"), F.sum("n_keys")).first()
    answers = _answers(requests, _coded(totals, _short_counts(totals)))
    return _scores(units, answers, buckets, n or 0, v or 0)
