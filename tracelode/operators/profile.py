"""Column profiles, table statistics, event compliance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column, of any type that has an order: null_count, distinct_count, least and most (as texts, by the column's own order).

    Distinct values are counted in long form, as texts, so that one aggregation serves all columns; the rest is one aggregation without a shuffle of rows."""
    cell = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("x")) for c in columns)))
    long = df.select(cell.alias("c")).select("c.*").groupBy("column", "x").agg(F.count("*").alias("n"))
    counts = long.groupBy("column").agg(F.sum(F.when(F.col("x").isNull(), F.col("n")).otherwise(0)).alias("null_count"), F.count("x").alias("distinct_count"))
    ends = df.agg(F.array(*(F.struct(F.lit(c).alias("column"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("most")) for c in columns)).alias("e"))
    return counts.join(F.broadcast(ends.select(F.inline("e"))), "column")  # a row for each column


def first_rows(df: DataFrame, by: str, n: int = 5) -> DataFrame:
    """The n first rows by a column, as a sample to look at: the same rows each time."""
    return df.orderBy(by, *[c for c in df.columns if c != by]).limit(n)


def errors_listed(checked: DataFrame, key: str) -> DataFrame:
    """Every broken rule with its ordinal in its event: key, ordinal (from 1), path, rule."""
    return checked.select(key, F.posexplode("violations").alias("at", "v")).select(key, (F.col("at") + 1).alias("ordinal"), "v.path", "v.rule")


def file_statistics(checked: DataFrame) -> DataFrame:
    """By file: lines read, processed and failed, and the share that passed."""
    ok = F.count_if(F.size("violations") == 0)
    return checked.groupBy("path").agg(F.count("*").alias("n_lines"), ok.alias("processed"), (F.count("*") - ok).alias("failed"), (ok / F.count("*")).alias("rate"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in sorted(tables.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def distinct_sets(df: DataFrame, by: str, members: str, counted: str) -> DataFrame:
    """by, members (the few distinct values of a column of kinds, sorted) and how many distinct values another column has."""
    return df.groupBy(by).agg(F.array_sort(F.collect_set(members)).alias(members), F.countDistinct(counted).alias(f"n_{counted}"))


def processing_summary(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """processed, failed, total and success_rate (0 when empty) of lines that were read and the rows that came of them."""
    read, kept = lines.agg(F.count("*").alias("total")), rows.agg(F.count("*").alias("processed"))
    rate = F.coalesce(F.try_divide(F.col("processed").cast("double"), F.col("total")), F.lit(0.0))
    return read.join(F.broadcast(kept)).select("processed", (F.col("total") - F.col("processed")).alias("failed"), "total", rate.alias("success_rate"))  # a row each


def compliance(checked: DataFrame) -> DataFrame:
    """total, valid, invalid and rate (0 when empty) of checked lines."""
    ok = F.count_if(F.size("violations") == 0)
    return checked.agg(F.count("*").alias("total"), ok.alias("valid"), (F.count("*") - ok).alias("invalid"), F.coalesce(F.try_divide(ok.cast("double"), F.count("*")), F.lit(0.0)).alias("rate"))


def reasons(bad: DataFrame) -> DataFrame:
    return bad.groupBy("reason").agg(F.count("*").alias("n"))
