"""Rows of a table of vectors, and their entries as integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integer entries beyond this would let a squared distance of 64 of them leave a long.
MOST = 1 << 27


def sound(vector: Column) -> Column:
    """Whether a vector is there and has no null, infinite or NaN entry (an empty one has none)."""
    finite = lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False))  # noqa: E731  NaN is above infinity
    return F.coalesce(F.forall(vector, finite), F.lit(False))


def with_vectors(df: DataFrame, dims: int) -> DataFrame:
    """vec_id and embedding of the rows whose vector is sound and has dims entries; other columns are left behind."""
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where((F.size("embedding") == dims) & sound(F.col("embedding")))


def integers(column: pa.Array, dims: int, scale: float = 64.0, most: int = MOST) -> np.ndarray:
    """floor(scale * entry) of a column of vectors, a row each."""
    x = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims))
    if x.size and np.abs(x).max() > most:
        raise ValueError(f"an entry times {scale:g} is beyond {most}, where results leave a long")
    return x.astype(np.int64)


def lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a matrix as a column of lists."""
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * d, d) if d else np.zeros(n + 1, np.int64), pa.int32()), pa.array(np.ascontiguousarray(x).ravel(), kind))
