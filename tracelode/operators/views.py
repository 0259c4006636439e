"""The three views over the event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio

_NAMED = "array<struct<name:string>>"
_FRAMES = "array<struct<variable_name:string,shape:array<bigint>,columns:array<string>>>"


def names_of(json: Column) -> Column:
    """Names in a JSON list of datasets; those without one are left out; null for a null list."""
    return F.filter(F.from_json(json, _NAMED)["name"], lambda x: x.isNotNull())


def lineage_io(lineage: DataFrame) -> DataFrame:
    return lineage.select(
        "ol_event_id", "run_id", "execution_id", "event_type", "job_name", "event_time", "session_id",
        names_of(F.col("inputs_json")).alias("input_names"), names_of(F.col("outputs_json")).alias("output_names"),
        F.json_array_length("inputs_json").alias("input_count"), F.json_array_length("outputs_json").alias("output_count"),
    )


def performance_metrics(runtime: DataFrame, lineage: DataFrame) -> DataFrame:
    """Start and end events with every lineage event of their execution, or none. Sources and JSON stay out of the shuffle but for the counts."""
    r = runtime.where(F.col("event_type").isin("cell_execution_start", "cell_execution_end")).select(
        "execution_id", "session_id", "cell_id", F.col("event_type").alias("runtime_event_type"), "start_memory_mb", "end_memory_mb", (F.col("end_memory_mb") - F.col("start_memory_mb")).alias("memory_delta_mb"),
        F.col("duration_ms").alias("runtime_duration_ms"), F.col("timestamp").alias("runtime_timestamp"),
    )
    l = lineage.select(
        "execution_id", "ol_event_id", "run_id", F.col("event_type").alias("lineage_event_type"), "job_name", F.col("duration_ms").alias("lineage_duration_ms"), F.col("event_time").alias("lineage_timestamp"),
        F.json_array_length("inputs_json").alias("input_dataset_count"), F.json_array_length("outputs_json").alias("output_dataset_count"),
    )
    return r.join(l, "execution_id", "left").withColumn("lineage_to_runtime_ratio", ratio(F.col("lineage_duration_ms"), F.col("runtime_duration_ms")))


def dataframe_lineage(frames: DataFrame) -> DataFrame:
    parsed = frames.withColumn("i", F.from_json("input_dataframes", _FRAMES)).withColumn("o", F.from_json("output_dataframes", _FRAMES))
    first = lambda c: F.get(F.col(c), F.lit(0))
    size = lambda c, k: F.get(first(c)["shape"], F.lit(k))
    return parsed.select(
        "df_event_id", "execution_id", "cell_id", "session_id", "timestamp", "operation_type", "operation_method", "operation_code",
        F.json_array_length("input_dataframes").alias("input_df_count"), F.json_array_length("output_dataframes").alias("output_df_count"),
        first("i")["variable_name"].alias("input_variable"), first("o")["variable_name"].alias("output_variable"),
        size("i", 0).alias("input_rows"), size("i", 1).alias("input_cols"), size("o", 0).alias("output_rows"), size("o", 1).alias("output_cols"),
        F.from_json("column_lineage", "struct<output_columns:array<string>>")["output_columns"].alias("output_columns"),
        "overhead_ms", "df_size_mb", "sampled", ratio(size("o", 0).cast("double"), size("i", 0)).alias("row_retention_ratio"),
    )
