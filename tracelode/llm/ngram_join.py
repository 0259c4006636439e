"""Jaccard join on shingles of five words, with Bayesian pruning of MinHash candidates.

1. Texts with equal shingle sets are one node; it carries the number of its documents.
2. Candidates share one of BANDS bands of ROWS MinHash values. In a bucket of at most SMALL nodes all pairs are candidates; in
   a larger one, first each node and the bucket's leader, drawn anew for each band. A pair at similarity 0.8 shares no band with chance 4e-6.
3. MinHash values of a pair are compared STEP by step. When the posterior probability (uniform prior) that its similarity reaches
   the threshold is below `tolerance`, it is dropped. Then the larger buckets are compared in full, in blocks of some WIDE nodes
   against each other: all pairs whose nodes are not in one component yet.
4. Components of what is left are verified exactly, pair by pair, in blocks of some BLOCK nodes (of long texts, BLOCK_SHINGLES shingles) against each other: every node is counted
   its links, and each block gives the edges of a spanning forest. So a group of thousands of near copies is spread over
   tasks, and no row is made for a pair.
5. Components of the verified edges are the classes.

Links are documents at similarity of threshold or more: copies, and documents of linked nodes.

Cases: a null text counts as empty; texts without words have no links and are a class by themselves (its class_id is the doc_id); texts of one to four words
have one shingle, all their words; rows that repeat a doc_id, or have none, are nodes by their texts and each has a row in the result (a class_id is null only
if all its doc_ids are); an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialise, tasks_for
from .components import components
from .textnum import Words, mix, slices

BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
STEP, SMALL, BLOCK = 16, 16, 192
#: Shingles of a block on average at most, or of one node: blocks of long texts hold fewer nodes.
BLOCK_SHINGLES = 1 << 21
WIDE, TILE = 2048, 128
BATCH_CHARS = 2_000_000
_A = np.random.default_rng(91).integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = np.random.default_rng(92).integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minhash(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """HASHES x texts; starts: where each text's shingles begin (none is empty)."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.empty((HASHES, len(starts)), np.uint32)
    for k in range(HASHES):
        v = x * _A[k]
        v ^= v >> np.uint32(16)
        v *= _B[k]
        out[k] = np.minimum.reduceat(v, starts)
    return out


def node_names(every: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """128 bits for each text's set of shingles; every: the sets, one after the other."""
    sizes = np.diff(np.append(starts, len(every)))
    low = np.add.reduceat(mix(every + np.uint64(1)), starts) + sizes.astype(np.uint64)
    high = np.add.reduceat(mix(every ^ np.uint64(0x5DEECE66D1CE4E5B)), starts)
    return [x.tobytes() + y.tobytes() for x, y in zip(low, high)]


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For STEP, 2 STEP, ... values compared: the fewest matches at which similarity may still reach the threshold with at least that posterior probability."""
    s = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            weight = m * np.log(s) + (n - m) * np.log1p(-s)
            weight = np.exp(weight - weight.max())
            if weight[s >= threshold].sum() >= tolerance * weight.sum():
                out.append(m)
                break
    return out


def _features(docs: DataFrame) -> DataFrame:
    names = ["doc_id", "h", "node", "keys", "sig", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices([len(t) for t in texts], BATCH_CHARS):
                shingles, bounds = Words(texts[a:b]).shingles()
                sets = [np.unique(shingles[x:y]) for x, y in zip(bounds[:-1], bounds[1:])]
                some = [i for i, s in enumerate(sets) if len(s)]
                node, keys, sig = ([None] * (b - a) for _ in range(3))
                if some:
                    every, starts = np.concatenate([sets[i] for i in some]), np.cumsum([0, *(len(sets[i]) for i in some[:-1])])
                    m = minhash(every, starts)
                    names_ = node_names(every, starts)
                    band = np.zeros((BANDS, len(some)), np.uint64)
                    for r in range(ROWS):
                        band = mix(band + m[r::ROWS].astype(np.uint64) + np.arange(BANDS, dtype=np.uint64)[:, None])
                    short = np.ascontiguousarray((m & np.uint32(65535)).astype("<u2").T)
                    for k, i in enumerate(some):
                        node[i] = names_[k]
                        keys[i], sig[i] = band[:, k].view(np.int64), short[k].tobytes()
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("h"), pa.array(node, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary()), pa.array([len(s) for s in sets], pa.int64())], names)

    return _told(docs).mapInArrow(run, "doc_id long, h long, node binary, keys array<long>, sig binary, size long")


def _told(docs: DataFrame) -> DataFrame:
    """doc_id, text and its hash h: the last two tell apart rows that repeat a doc_id, or have none."""
    return documents(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")


def _buckets(nodes: DataFrame) -> DataFrame:
    """key, n, node, leader of the buckets that nodes share."""
    placed = nodes.select("node", F.explode("keys").alias("key"))
    draw = F.struct(F.xxhash64("node", "key"), F.col("node"))
    buckets = placed.groupBy("key").agg(F.count("*").alias("n"), F.min(draw).alias("draw")).where("n > 1").select("key", "n", F.when(F.col("n") > SMALL, F.col("draw.node")).alias("leader"))
    return placed.join(buckets, "key").select("key", "n", "node", "leader")


def _candidates(shared: DataFrame) -> DataFrame:
    """Pairs a < b of nodes: all of a small bucket, and those with its leader of a larger one."""
    small = shared.where(F.col("n") <= SMALL).select("key", "node")
    # At most SMALL rows a group: their pairs are bounded by SMALL / 2 for each node.
    group = small.groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("g"))
    pairs = group.select(F.explode(F.expr("flatten(transform(g, (x, i) -> transform(slice(g, i + 2, size(g)), y -> struct(x AS a, y AS b))))")).alias("p")).select("p.a", "p.b")
    stars = shared.where((F.col("n") > SMALL) & (F.col("node") != F.col("leader"))).select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
    return pairs.unionByName(stars).distinct()


def _pruned(pairs: DataFrame, nodes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    least = least_matches(threshold, tolerance)
    sig = nodes.select("node", "sig")
    both = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("x")), "a").join(sig.select(F.col("node").alias("b"), F.col("sig").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, HASHES) for c in ("x", "y"))
            live, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
            for k, floor in enumerate(least):
                part = slice(k * STEP, (k + 1) * STEP)
                matches[live] += (x[live, part] == y[live, part]).sum(1)
                live = live[matches[live] >= floor]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(live)), batch.column(1).take(pa.array(live))], ["a", "b"])

    return both.mapInArrow(run, "a binary, b binary")


def _met(root: list[bytes], sig: np.ndarray, left: np.ndarray, right: np.ndarray, least: list[int]) -> list[tuple[bytes, bytes]]:
    """Pairs of roots that join all roots of which a node of left and one of right survive pruning."""
    names = sorted(set(root))
    number = {x: i for i, x in enumerate(names)}
    own, top = np.array([number[x] for x in root]), np.arange(len(names))
    within = left is right
    values = np.ascontiguousarray(sig.T)
    for a in range(0, len(left), TILE):
        rows, cols = left[a : a + TILE], right[a:] if within else right
        live = top[own[rows]][:, None] != top[own[cols]][None, :]
        if not live.any():
            continue
        x, y = values[:, rows], values[:, cols]
        matches, pair = np.zeros(live.shape, np.uint8), None
        for k, floor in enumerate(least):
            part = slice(k * STEP, (k + 1) * STEP)
            if pair is None:
                for h in range(part.start, part.stop):
                    matches += x[h][:, None] == y[h][None, :]
                live &= matches >= floor
                if np.count_nonzero(live) * 32 < live.size:
                    pair = np.nonzero(live)
                    held = matches[pair].astype(np.int64)
            else:
                held += (x[part, pair[0]] == y[part, pair[1]]).sum(0)
                kept = held >= floor
                pair, held = (pair[0][kept], pair[1][kept]), held[kept]
        i, j = np.nonzero(live) if pair is None else pair
        while True:
            u, v = top[own[rows[i]]], top[own[cols[j]]]
            if (u == v).all():
                break
            np.minimum.at(top, np.maximum(u, v), np.minimum(u, v))
            while (top[top] != top).any():
                top = top[top]
    return [(names[i], names[t]) for i, t in enumerate(top.tolist()) if i != t]


def _completed(shared: DataFrame, nodes: DataFrame, groups: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """groups (node, root), joined where any two nodes of a larger bucket survive pruning. Pairs inside a group need no look, as all of them are verified."""
    least = least_matches(threshold, tolerance)
    large = shared.where(F.col("n") > SMALL).select("key", "node").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # A group that fills blocks of a bucket has them for itself, and they aren't compared with each other.
    # Keys are aggregates, too, so that joins on them exchange both of their sides and Spark can split a hot one.
    own = large.groupBy("key", "root").agg(F.min("key").alias("k"), F.min("root").alias("r"), F.count("*").alias("m")).select(F.col("k").alias("key"), F.col("r").alias("root"), "m").withColumn("full", F.when(F.col("m") >= WIDE, F.ceil(F.col("m") / WIDE)).otherwise(0).cast("int"))
    mixed = own.groupBy("key").agg(F.min("key").alias("k"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.sum(F.when(F.col("full") == 0, F.col("m")).otherwise(0)).alias("rest"))
    mixed = mixed.where("lo < hi").select(F.col("k").alias("key"), F.greatest(F.lit(1), F.ceil(F.col("rest") / WIDE)).cast("int").alias("rest"))
    full = F.col("full") > 0
    number = F.pmod(F.xxhash64("node"), F.when(full, F.col("full")).otherwise(F.col("rest"))).cast("int")
    placed = large.join(own, ["key", "root"]).join(mixed, "key").select("key", F.when(full, F.col("root")).otherwise(F.lit(b"")).alias("owner"), number.alias("number"), "node", "root")
    placed = materialise(placed, "contested")
    if placed.isEmpty():
        return groups
    blocks = placed.select("key", F.struct("owner", "number").alias("block")).distinct()
    cells = blocks.select("key", F.col("block").alias("x")).join(blocks.select("key", F.col("block").alias("y")), "key")
    cells = cells.where((F.col("x") <= F.col("y")) & ((F.col("x.owner") != F.col("y.owner")) | (F.col("x.owner") == F.lit(b""))))
    cells = cells.withColumn("cell", F.xxhash64("key", "x.owner", "x.number", "y.owner", "y.number"))
    sides = cells.select("key", "x.*", "cell", F.lit(0).alias("side")).unionByName(cells.where("x != y").select("key", "y.*", "cell", F.lit(1).alias("side")))
    rows = placed.join(sides, ["key", "owner", "number"]).select("cell", "side", "node", "root").join(nodes.select("node", "sig"), "node")
    dealt = rows.select("cell", "side", "root", "sig").repartition(tasks_for(nodes.sparkSession), "cell").sortWithinPartitions("cell")

    def compared(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
        side = np.array([r[1] for r in rows])
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        sig = np.frombuffer(b"".join(r[3] for r in rows), "<u2").reshape(-1, HASHES)
        return _met([r[2] for r in rows], sig, left, right if len(right) else left, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[0] != held[0][0]:
                    out += compared(held)
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.binary()) for k in (0, 1)], ["a", "b"])
        if held:
            out = compared(held)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.binary()) for k in (0, 1)], ["a", "b"])

    met = materialise(dealt.mapInArrow(run, "a binary, b binary").distinct(), "met")
    if met.isEmpty():
        return groups
    tops = components(met).select(F.col("node").alias("root"), F.col("root").alias("top"))
    every = groups.unionByName(tops.select(F.col("root").alias("node"), "root")).distinct()
    return materialise(every.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "groups")


def _linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """left x right: whether two sets' Jaccard similarity reaches the threshold."""
    sizes = np.array([len(s) for s in sets])
    who = np.repeat(np.arange(len(sets)), sizes)
    value, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.flatnonzero(times > 1)
    column = np.full(len(value), -1)
    column[common] = np.arange(len(common))
    at = column[where]
    who, at = who[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    who, at = who[order], at[order]
    both = np.zeros((len(left), len(right)), np.float32)
    step = 8192
    for c in range(0, len(common), step):
        lo, hi = np.searchsorted(at, [c, c + step])
        m = np.zeros((len(sets), step), np.float32)
        m[who[lo:hi], at[lo:hi] - c] = 1
        both += m[left] @ m[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - both
    return both >= threshold * union - 1e-6


def _forest(link: np.ndarray) -> np.ndarray:
    """The least row of each row's component; link is symmetric."""
    root = np.arange(len(link))
    while True:
        least = np.where(link, root[None, :], len(link)).min(1, initial=len(link))
        new = np.minimum(root, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verified(docs: DataFrame, nodes: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """Rows a, b, links: node a is in one tree with b (perhaps itself), and has so many linked documents in one pair of blocks."""
    held = groups.join(nodes.select("node", "size"), "node").groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    sizes = held.select("root", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    known = nodes.select("node", "told", "copies").join(groups, "node").join(sizes, "root").select("*", "told.*").drop("told")
    known = known.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            # Rows that repeat a doc_id and its text follow each other; one of them will do.
            names = batch.column("node").to_pylist()
            fresh = [i for i, x in enumerate(names) if x != (names[i - 1] if i else last)]
            last = names[-1] if names else last
            batch = batch.take(pa.array(fresh, pa.int64()))
            texts = batch.column("text").to_pylist()
            for a, b in slices([len(t) for t in texts], BATCH_CHARS):
                shingles, bounds = Words(texts[a:b]).shingles()
                sets = [np.unique(shingles[x:y]) for x, y in zip(bounds[:-1], bounds[1:])]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("root", "blocks", "block", "node", "copies")), pa.array([s.tobytes() for s in sets], pa.binary())], ["root", "blocks", "block", "node", "copies", "set"])

    texts = _told(docs)
    own = texts.join(known, texts["doc_id"].eqNullSafe(known["doc_id"]) & (texts["h"] == known["h"])).select("root", "blocks", "block", "node", "copies", "text")
    sets = own.mapInArrow(shingled, "root binary, blocks int, block int, node binary, copies long, set binary")
    placed = sets.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    dealt = placed.select("root", "i", "j", "block", "node", "copies", "set").repartition(tasks_for(docs.sparkSession), "root", "i", "j").sortWithinPartitions("root", "i", "j")

    def compared(rows: list[tuple]) -> list[tuple]:
        rows = list({r[4]: r for r in rows}.values())  # a node may come again from another task
        i, j = rows[0][1:3]
        block = np.array([r[3] for r in rows])
        weight = np.array([r[5] for r in rows])
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        sets = [np.frombuffer(r[6], "<u8") for r in rows]
        link = np.zeros((len(rows), len(rows)), bool)
        if len(left) and len(right):
            link[np.ix_(left, right)] = _linked(sets, left, right, threshold)
        link |= link.T
        np.fill_diagonal(link, False)
        return [(rows[k][4], rows[r][4], int(n)) for k, (r, n) in enumerate(zip(_forest(link), link @ weight))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[:3] != held[0][:3]:
                    out += compared(held)
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.int64()))], ["a", "b", "links"])
        if held:
            out = compared(held)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.int64()))], ["a", "b", "links"])

    return dealt.mapInArrow(run, "a binary, b binary, links long")


def _classed(docs: DataFrame, threshold: float, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h, node) of all documents, and a row for each node: doc_id and h of one of its rows (told), root, class_id, n_links."""
    rows = materialise(_features(docs), "features")
    told = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("told")
    grouped = rows.where("node is not null").groupBy("node").agg(told, F.count("*").alias("copies"), F.min("keys").alias("keys"), F.min("sig").alias("sig"), F.min("size").alias("size"))
    nodes = materialise(grouped, "nodes")
    shared = materialise(_buckets(nodes), "buckets")
    pairs = materialise(_pruned(_candidates(shared), nodes, threshold, tolerance), "pairs")
    groups = _completed(shared, nodes, components(pairs), threshold, tolerance)
    verified = materialise(_verified(docs, nodes, groups, threshold), "links")
    roots = components(verified.where("a != b").select("a", "b"))
    links = verified.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    known = nodes.select("node", "told", "copies").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = materialise(known, "known")
    first = known.groupBy("root").agg(F.min("told").alias("first"))
    return rows.select("doc_id", "h", "node"), known.join(first, "root").select("node", "told", "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))


def classes(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-5) -> DataFrame:
    """A row for each document: doc_id, class_id (the least doc_id of its class), n_links (documents at similarity of threshold or more)."""
    rows, known = _classed(docs, threshold, tolerance)
    out = rows.select("doc_id", "node").join(known, "node", "left")
    return out.select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-5) -> DataFrame:
    """The documents, all columns, with one of each class: the one whose doc_id is the least, of equal ones that whose text's hash is. Of rows that repeat both doc_id and text one stays, and so do all documents without words."""
    rows, known = _classed(docs, threshold, tolerance)
    chosen = known.where("told = first").select("told.doc_id", "told.h").unionByName(rows.where("node is null").select("doc_id", "h"))
    again = rows.groupBy("doc_id", "h").count().withColumnRenamed("count", "n").withColumnRenamed("doc_id", "i").withColumnRenamed("h", "g")
    chosen = chosen.distinct()
    kept = materialise(chosen.join(again, chosen["doc_id"].eqNullSafe(again["i"]) & (chosen["h"] == again["g"])).select("doc_id", "h", "n"), "kept")
    text = F.xxhash64(F.coalesce(docs["text"], F.lit("")))

    def those(rows: DataFrame) -> DataFrame:
        return docs.join(rows, docs["doc_id"].eqNullSafe(rows["doc_id"]) & (text == rows["h"]), "left_semi")

    if kept.where("n > 1").isEmpty():
        return those(kept)
    return those(kept.where("n = 1")).unionByName(those(kept.where("n > 1")).dropDuplicates(["doc_id", "text"]))
