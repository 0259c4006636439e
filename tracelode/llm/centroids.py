"""Lloyd's clustering with ns-bounds: most distances are told apart by what was measured rounds ago.

Each vector keeps, for every centroid, the squared distance last measured and the round of that measure. All centroids of
all rounds are kept. A stored distance, less the way that its centroid has come since (the norm of its whole displacement,
not the sum of its steps), bounds the distance now from below. Only the vector's own centroid, and those whose bound
doesn't exceed the distance to it, are measured again, so assignments are those of a full comparison, ties included.

Entries are integers, distances and sums exact; bounds are floating-point with a margin, and what they can't tell is
measured. A round is one pass over a written table: vectors aren't shuffled, tasks hand on a row of sums a cluster, and
what passes the driver is the centroids.

Cases: rows whose vector is null, has null or non-finite entries or another length are left out; a null id counts as an
empty text where centroids are drawn; of rows with the same id the lesser vector is drawn first; repeated rows are kept
each; with fewer vectors than clusters, each is a centroid; an empty table gives an empty result; entries beyond 2^27 as
integers raise ValueError, as distances could leave a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .vectors import integers, lists, with_vectors

_STATE = "vec_id long, x array<int>, cluster int, d2 array<long>, since array<smallint>, n_measured int, n long, sums array<long>, inertia string"
_UNSEEN = np.iinfo(np.int64).max


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def assign(x: np.ndarray, history: list[np.ndarray], cluster: np.ndarray | None, d2: np.ndarray, since: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of the last round for each row, and how many distances were measured; d2 and since are brought up to date in place."""
    now, k = len(history) - 1, len(history[-1])
    if cluster is None:
        ask = np.ones((len(x), k), bool)
    else:
        rows = np.arange(len(x))
        moved = np.array([np.sqrt(((history[-1] - c).astype(np.float64) ** 2).sum(1)) for c in history])  # round by centroid
        own = np.empty(len(x), np.int64)
        for j in range(k):
            at = cluster == j
            own[at] = squares(x[at], history[-1][j])
        d2[rows, cluster], since[rows, cluster] = own, now
        ask = np.sqrt(d2.astype(np.float64)) - moved[since, np.arange(k)] <= (np.sqrt(own.astype(np.float64)) * (1 + 1e-9) + 1e-6)[:, None]
        ask[rows, cluster] = False
    for j in range(k):
        at = ask[:, j]
        d2[at, j], since[at, j] = squares(x[at], history[-1][j]), now
    best = np.where(since == now, d2, _UNSEEN).argmin(1)  # the first of equal ones
    return best, ask.sum(1) + (0 if cluster is None else 1)


def _pass(history: list[np.ndarray], first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Assigns the rows of a task to the last centroids; at its end a row for each cluster with its count, sums and inertia here."""
    k, dims = history[-1].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["vec_id", "x", "cluster", "d2", "since", "n_measured", "n", "sums", "inertia"]
        count, sums, inertia = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), [0] * k
        for batch in batches:
            if not batch.num_rows:
                continue
            if first:
                x = integers(batch.column("embedding"), dims)
                cluster, before = None, 0
                d2, since = np.zeros((len(x), k), np.int64), np.full((len(x), k), -1, np.int64)
            else:
                x, d2, since = (batch.column(c).flatten().to_numpy().astype(np.int64).reshape(-1, w) for c, w in (("x", dims), ("d2", k), ("since", k)))
                cluster, before = batch.column("cluster").to_numpy(), batch.column("n_measured").to_numpy()
            best, n = assign(x, history, cluster, d2, since)
            mine = d2[np.arange(len(x)), best]
            for j in np.unique(best):
                at = best == j
                count[j] += at.sum()
                sums[j] += x[at].sum(0)
                inertia[j] += sum(mine[at].tolist())
            empty = [pa.nulls(len(x), t) for t in (pa.int64(), pa.list_(pa.int64()), pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), lists(x, pa.int32()), pa.array(best, pa.int32()), lists(d2, pa.int64()), lists(since, pa.int16()), pa.array(before + n, pa.int32()), *empty], names)
        full = np.flatnonzero(count)
        if len(full):
            empty = [pa.nulls(len(full), t) for t in (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int16()), pa.int32())]
            yield pa.RecordBatch.from_arrays([empty[0], empty[1], pa.array(full, pa.int32()), *empty[2:], pa.array(count[full]), lists(sums[full], pa.int64()), pa.array([str(inertia[j]) for j in full])], names)

    return run


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of sum by count; a cluster without vectors keeps its centroid. k * dims rows pass the driver."""
    rows = state.where("n is not null").select("cluster", "n", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    out = centroids.copy()
    for r in rows:
        out[r["cluster"], r["at"]] = int(r["s"]) // int(r["n"])
    return out


def drawn(vectors: DataFrame, k: int, seed: int) -> DataFrame:
    """The k vectors whose ids come first by the hash of `seed:id`."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return vectors.orderBy(h, "embedding").limit(k)


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 and n_measured (distances measured, of k * (rounds + 1)) of every vector kept."""
    spark, rows = vectors.sparkSession, with_vectors(vectors, dims)
    first = [r["embedding"] for r in drawn(rows, k, seed).collect()]
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, n_measured int")
    history = [integers(pa.array(first, pa.list_(pa.float64())), dims)]
    state = materialise(rows.mapInArrow(_pass(history, True), _STATE), "clusters")
    for _ in range(rounds):
        history.append(_means(state, history[-1]))
        state = materialise(state.where("n is null").mapInArrow(_pass(history, False), _STATE), "clusters")
    parts = state.where("n is not null").groupBy("cluster").agg(F.sum(F.col("inertia").cast("decimal(38,0)")).alias("i")).collect()  # k rows
    total = sum(int(r["i"]) for r in parts)
    told = [(r["cluster"], int(r["i"]), total, hashlib.sha256(",".join(map(str, history[-1][r["cluster"]].tolist())).encode()).hexdigest()) for r in parts]
    named = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    own = state.where("n is null").select("vec_id", "cluster", F.element_at("d2", F.col("cluster") + 1).alias("distance"), "n_measured")
    return own.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_measured")


def _sql(k: int = 16, rounds: int = 3, dims: int = 64, seed: int = 1) -> str:
    d2 = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (v.x[i] - k.x[i]) * (v.x[i] - k.x[i])))"
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims})",
        f"k0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, x FROM (SELECT * FROM v ORDER BY sha256('{seed}:' || vec_id) LIMIT {k}) t)",
    ]
    for r in range(rounds + 1):
        parts.append(f"d{r} AS MATERIALIZED (SELECT v.vec_id, k.c, {d2} AS d FROM v, k{r} k)")
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, c, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS n FROM d{r}) t WHERE n = 1)")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT a.c, i, sum(v.x[i]) AS s, count(*) AS n FROM a{r} a JOIN v USING (vec_id), range(1, {dims + 1}) t(i) GROUP BY a.c, i)")
            parts.append(f"m{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{r} GROUP BY c)")
            parts.append(f"k{r + 1} AS MATERIALIZED (SELECT k.c, coalesce(m.x, k.x) AS x FROM k{r} k LEFT JOIN m{r} m ON k.c = m.c)")
    return f"WITH {', '.join(parts)} SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN k{rounds} k ON a.c = k.c"


#: DuckDB SQL for the query's rows.
SQL = _sql()
