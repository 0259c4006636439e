"""Column profiles that grow with their table: each file is read once, into sketches that merge.

A row a file and column holds counts, ends, a HyperLogLog sketch of the values and, for numbers, a quantile sketch. The
profile of the table is their merge, so a table that has grown costs its new files, and the profile of any part of its files
costs none. A file that was written anew under its old name is told by its size and time, and read again.

Errors: distinct values within three standard errors, 1.04 / sqrt(2^lg_k) each (2.4 percent of the count for the default 14);
ranks of quantiles within 1.33 percent of the rows for the default k, with 99 percent confidence each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

LG_K = 14
SHARES = (0.25, 0.5, 0.75)
_STORE = "path string, size long, modified timestamp, column string, n long, n_null long, least string, most string, least_number double, most_number double, distinct_sketch binary, quantile_sketch binary"


def _parts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows: path, size, modified and the columns. A row a file and column; one aggregation, partial before its shuffle."""

    def of(name: str) -> list[Column]:
        c, number = F.col(f"`{name}`"), isinstance(rows.schema[name].dataType, NumericType)
        x = c.cast("double") if number else F.lit(None).cast("double")
        kll = F.kll_sketch_agg_double(x) if number else F.lit(None).cast("binary")
        return [F.lit(name).alias("column"), F.count(F.lit(1)).alias("n"), F.count_if(c.isNull()).alias("n_null"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("most"), F.min(x).alias("least_number"), F.max(x).alias("most_number"), F.hll_sketch_agg(c.cast("string"), LG_K).alias("distinct_sketch"), kll.alias("quantile_sketch")]

    told = rows.groupBy("path", "size", "modified").agg(F.array(*(F.struct(*of(c)) for c in columns)).alias("x"))
    return told.select("path", "size", "modified", F.inline("x"))


def _read(spark: SparkSession, store: str) -> DataFrame:
    try:
        return spark.read.schema(_STORE).parquet(store)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], _STORE)


def _files(spark: SparkSession, table: str) -> list[tuple[str, int, int]]:
    """path, size and time of the table's files: a line a file, from the file system."""
    return [(r["path"], r["length"], r["modificationTime"]) for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(table).select("path", "length", "modificationTime").collect()]


def refresh(spark: SparkSession, table: str, store: str, columns: list[str]) -> int:
    """Reads the files of a Parquet table that the store has no sketches of, and adds them. Returns how many."""
    now = {(p, n, t) for p, n, t in _files(spark, table)}
    had = {(r["path"], r["size"], r["modified"]) for r in _read(spark, store).select("path", "size", "modified").distinct().collect()}
    new = sorted(now - had)
    if new:
        meta = F.col("_metadata")
        rows = spark.read.parquet(*(p for p, _, _ in new)).select(meta["file_path"].alias("path"), meta["file_size"].alias("size"), meta["file_modification_time"].alias("modified"), *(F.col(f"`{c}`") for c in columns))
        parts = _parts(rows, columns)
        # A file without rows (Spark writes one for a first task that has none) has no part; it is known by a row of nothing a column.
        blank = spark.createDataFrame([(p, n, t, c) for p, n, t in new for c in columns], "path string, size long, modified timestamp, column string")
        known = F.broadcast(blank.withColumnsRenamed({"size": "_size", "modified": "_modified"}))  # a row a new file and column
        found = parts.join(known, ["path", "column"], "right")
        whole = {"size": F.coalesce("size", "_size"), "modified": F.coalesce("modified", "_modified"), "n": F.coalesce("n", F.lit(0)), "n_null": F.coalesce("n_null", F.lit(0))}
        found.withColumns(whole).select(parts.columns).write.mode("append").parquet(store)
    return len(new)


def profile(spark: SparkSession, store: str, table: str | None = None) -> DataFrame:
    """column, n, null_count, distinct_count (near), least, most, q25, q50, q75 from the store alone; with `table`, of the files that it has now.

    Of a file that was read more than once the latest counts."""
    parts = _read(spark, store)
    last = parts.groupBy("path").agg(F.max("modified").alias("modified"))
    parts = parts.join(last, ["path", "modified"])
    if table is not None:
        files = spark.createDataFrame([(p,) for p, _, _ in _files(spark, table)], "path string")
        parts = parts.join(files, "path", "left_semi")
    merged = parts.groupBy("column").agg(
        F.sum("n").alias("n"), F.sum("n_null").alias("null_count"), F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct_count"),
        F.when(F.count("least_number") > 0, F.min_by("least", "least_number")).otherwise(F.min("least")).alias("least"), F.when(F.count("most_number") > 0, F.max_by("most", "most_number")).otherwise(F.max("most")).alias("most"),
        F.kll_merge_agg_double("quantile_sketch").alias("q"),
    )
    at = [F.when(F.kll_sketch_get_n_double("q") > 0, F.kll_sketch_get_quantile_double("q", F.lit(s))).alias(f"q{int(100 * s)}") for s in SHARES]
    return merged.select("column", "n", "null_count", "distinct_count", "least", "most", *at)
