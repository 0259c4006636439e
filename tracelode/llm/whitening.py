"""Principal components by contour integration (FEAST), and embeddings whitened by them.

The covariance is made from exact integer sums in two passes: sums, then products of entries less a whole number next to
the mean; what rounding that number leaves is taken off exactly. Its eigenvalues are then told apart by inertia: the
number of negative pivots of V - sI says how many lie below s. The range of those wanted is halved until few lie in each
slice. For every slice, a task of its own solves (zI - V) Y = B at the nodes of a quadrature over a circle around it,
which projects random columns on the slice's eigenvectors; Rayleigh-Ritz extracts them; this is repeated until residuals
vanish and as many are found as inertia counts. A last Rayleigh-Ritz over all of them makes them orthogonal across slices.

What is broadcast and what passes the driver is matrices of dims by dims, whatever the number of rows; dims is refused
beyond MOST_DIMS.

Cases: rows whose vector is null or has null or non-finite entries, or another length than dims (by default the
commonest one, of equally common the greatest), are left out; repeated rows and null ids are kept each; components without
variance (eigenvalue zero to double precision) aren't returned, so one vector, or equal ones, give no rows; an empty table
gives an empty result; deviation is null where it leaves a long; entries beyond 2^40 as integers raise ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import integers, lists, sound, with_vectors

SHIFT = 1_000_000
MOST, MOST_DIMS = 1 << 40, 4096
PER_SLICE, NODES, TURNS = 8, 8, 60
_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# Covariance

def common_length(vectors: DataFrame) -> int:
    """The length that most sound vectors have; of equally common ones the greatest; 0 for none."""
    row = vectors.where(sound(F.col("embedding"))).groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return row["d"] if row else 0


def _shifted(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return integers(batch.column("embedding"), dims, most=MOST) + SHIFT


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a' b of whole numbers, as Python's integers; in floating point where no sum can leave 53 bits."""
    if len(a) * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2.0**53:
        return (a.astype(np.float64).T @ b.astype(np.float64)).astype(np.int64).astype(object)
    return a.astype(object).T @ b.astype(object)


def _added(rows: DataFrame, values: str) -> tuple[int, list[int]]:
    """Sums over tasks' rows (n, values as texts of whole numbers), by place."""
    long = rows.select("n", F.posexplode(values).alias("at", "x")).groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    got = sorted(long.collect())
    return (got[0]["n"] if got else 0), [int(r["x"]) for r in got]


def sums(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """n and S."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, object)
        for batch in batches:
            if batch.num_rows:
                x = _shifted(batch, dims)
                n, total = n + len(x), total + _exact(np.ones((len(x), 1), np.int64), x)[0]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[str(t) for t in total]], pa.list_(pa.string()))], ["n", "total"])

    return _added(rows.mapInArrow(run, "n long, total array<string>"), "total")


def covariance(rows: DataFrame, dims: int, n: int, total: list[int]) -> np.ndarray:
    """With divisor n. (n * sum(y y') - sum(y) sum(y)') / n^2 for y = x less the rounded mean: whole numbers up to the division."""
    middle = np.array([round(s / n) if abs(s) < 2**52 else s // n for s in total], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, out = 0, np.zeros((dims, dims), object)
        for batch in batches:
            if batch.num_rows:
                y = _shifted(batch, dims) - middle
                n, out = n + len(y), out + _exact(y, y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[str(t) for t in out.ravel()]], pa.list_(pa.string()))], ["n", "products"])

    _, products = _added(rows.mapInArrow(run, "n long, products array<string>"), "products")
    rest = np.array([s - n * int(m) for s, m in zip(total, middle, strict=True)], object)
    whole = n * np.array(products, object).reshape(dims, dims) - np.outer(rest, rest)
    return np.array([[v / (n * n) for v in row] for row in whole], np.float64)  # Python rounds the quotient of integers once


# Eigenvectors

def negatives(a: np.ndarray) -> int:
    """Negative eigenvalues of a symmetric matrix, by the pivots of its factorisation (one by one or two by two, the largest first)."""
    a, count = a.copy(), 0
    while len(a):
        diagonal = np.abs(a.diagonal())
        off = np.abs(a - np.diag(a.diagonal()))
        r, most = int(diagonal.argmax()), off.max()
        if diagonal[r] == 0 and most == 0:
            break
        pivots = [r] if diagonal[r] >= 0.6404 * most else list(np.unravel_index(int(off.argmax()), off.shape))  # (1 + sqrt(17)) / 8
        block = a[np.ix_(pivots, pivots)]
        count += int(block[0, 0] < 0) if len(pivots) == 1 else 1  # a two by two pivot has one eigenvalue of either sign
        rest = np.setdiff1d(np.arange(len(a)), pivots)
        side = a[np.ix_(rest, pivots)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        a = (a + a.T) / 2
    return count


def slices(v: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """(from, to, how many) of slices that hold the k greatest eigenvalues, each with PER_SLICE of them at most unless they lie too close together to part."""
    d, top = len(v), float(np.abs(v).sum(1).max()) * (1 + 1e-9)
    above = lambda s: d - negatives(v - s * np.eye(d))
    if top == 0:
        return []
    near, out, todo = 1e-10 * top, [], [(-1e-6 * top, top * (1 + 1e-6), d, 0)]
    while todo:
        a, b, over_a, over_b = todo.pop()
        if over_a == over_b or over_b >= k:
            continue
        parted = None
        if over_a - over_b > PER_SLICE and b - a > 1e-6 * top:
            for share in (0.5, 0.45, 0.55, 0.4, 0.6, 0.3, 0.7):  # a cut needs room on both of its sides
                s = a + share * (b - a)
                if (over := above(s - near)) == above(s + near):
                    parted = (s, over)
                    break
        if parted is None:
            out.append((a, b, over_a - over_b))
        else:
            todo += [(a, parted[0], over_a, parted[1]), (parted[0], b, parted[1], over_b)]
    return sorted(out)


def feast(v: np.ndarray, a: float, b: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` eigenpairs of v with values in (a, b]: values, and vectors as columns."""
    d, scale = len(v), float(np.abs(v).sum(1).max())
    y = np.random.default_rng(12).standard_normal((d, min(d, count + count // 2 + 4)))
    x, w = np.polynomial.legendre.leggauss(NODES)
    middle, radius, best = (a + b) / 2, (b - a) / 2, None
    for _ in range(TURNS):
        q = np.zeros_like(y)
        for turn, weight in zip(np.exp(0.5j * np.pi * (x + 1)), w, strict=True):  # the lower half of the circle mirrors the upper
            q += weight / 2 * (radius * turn * np.linalg.solve((middle + radius * turn) * np.eye(d) - v, y.astype(complex))).real
        q = np.linalg.qr(q)[0]
        value, small = np.linalg.eigh(q.T @ v @ q)
        y = q @ small
        inside = (value > a) & (value <= b)
        if inside.sum() == count:
            off = float(np.linalg.norm(v @ y[:, inside] - y[:, inside] * value[inside], axis=0).max())
            if best is not None and off >= 0.5 * best[0]:  # no longer better
                break
            best = (off, value[inside], y[:, inside]) if best is None or off < best[0] else best
    if best is None or best[0] > 1e-9 * scale:
        raise ArithmeticError(f"of {count} eigenvalues between {a} and {b} not all were found")
    return best[1], best[2]


def components(spark, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues of v, falling, and their unit eigenvectors as columns, each with its largest entry positive. A slice is a Spark task."""
    parts = slices(v, k)
    if not parts:
        return np.zeros(0), np.zeros((len(v), 0))
    sent = spark.sparkContext.broadcast(v)  # dims * dims numbers

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a, b, count in frame.itertuples(index=False):
                value, vector = feast(sent.value, a, b, count)
                yield pd.DataFrame({"value": value, "vector": list(vector.T)})

    found = spark.createDataFrame(parts, "a double, b double, n int").repartition(len(parts)).mapInPandas(run, "value double, vector array<double>").collect()
    sent.unpersist()
    q = np.linalg.qr(np.array([r["vector"] for r in sorted(found, key=lambda r: r["value"])]).T)[0]
    value, small = np.linalg.eigh(q.T @ v @ q)
    value, vector = value[::-1][:k], (q @ small)[:, ::-1][:, :k]
    vector = vector * np.sign(vector[np.abs(vector).argmax(0), np.arange(vector.shape[1])])
    full = value > len(v) * np.finfo(float).eps * max(value[0], 0)
    return value[full], vector[:, full]


# Whitening

def whiten(vectors: DataFrame, k: int = 32, dims: int | None = None) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error of each vector kept and each of the first k components."""
    spark = vectors.sparkSession
    dims = common_length(vectors) if dims is None else dims
    if dims > MOST_DIMS:
        raise ValueError(f"vectors of more than {MOST_DIMS} entries")
    rows = with_vectors(vectors, dims)
    n, total = sums(rows.select("embedding"), dims) if dims else (0, [])
    if not n:
        return spark.createDataFrame([], _RESULT)
    v = covariance(rows.select("embedding"), dims, n, total)
    value, vector = components(spark, v, min(k, dims))
    if not len(value):
        return spark.createDataFrame([], _RESULT)
    k, root = len(value), np.sqrt(value)
    wide = max(abs(s) for s in total)

    def centred(batch: pa.RecordBatch) -> np.ndarray:
        """n * x - S, exact."""
        x = _shifted(batch, dims)
        if n * float(np.abs(x).max()) + wide < 2.0**62:
            return n * x - np.array(total, np.int64)
        return n * x.astype(object) - np.array(total, object)

    def white(y: np.ndarray) -> np.ndarray:
        return (y.astype(np.float64) / n) @ vector / root

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((k + 1, k + 1))  # with ones beside, so that the sums come along
        for batch in batches:
            if batch.num_rows:
                w = np.hstack([white(centred(batch)), np.ones((batch.num_rows, 1))])
                out += w.T @ w
        if out[-1, -1]:
            yield pa.RecordBatch.from_arrays([pa.array([out.ravel().tolist()], pa.list_(pa.float64()))], ["out"])

    got = sorted(rows.select("embedding").mapInArrow(squares, "out array<double>").select(F.posexplode("out").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect())
    square = np.array([r["x"] for r in got]).reshape(k + 1, k + 1) / n
    error = float(np.abs(square[:k, :k] - np.outer(square[k, :k], square[k, :k]) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = centred(batch)
                if float(np.abs(y).max()) ** 2 * dims < 2.0**62:
                    deviation = (y.astype(np.int64) ** 2).sum(1).tolist()
                else:
                    deviation = [int(s) if s < 1 << 63 else None for s in (y.astype(object) ** 2).sum(1)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(deviation, pa.int64()), lists(white(y), pa.float64())], ["vec_id", "deviation", "w"])

    told = rows.mapInArrow(run, "vec_id long, deviation long, w array<double>")
    share = F.element_at(F.array(*map(F.lit, (value / np.trace(v)).tolist())), F.col("component"))
    long = told.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).withColumn("component", F.col("at") + 1)
    return long.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
