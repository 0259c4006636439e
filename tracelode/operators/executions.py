"""Executions: starts paired with ends, what stays open, runs, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import line_count
from ..plans.scratch import settled


def paired(runtime: DataFrame) -> DataFrame:
    """A row for each execution with a start: its times and state (end, error or open). One aggregation, with partial sums before the shuffle."""
    start, done = F.col("event_type") == "cell_execution_start", F.col("event_type").isin("cell_execution_end", "cell_execution_error")
    out = runtime.groupBy("execution_id").agg(
        F.min(F.when(start, F.col("timestamp"))).alias("started"), F.max(F.when(done, F.col("timestamp"))).alias("ended"), F.max_by("event_type", F.when(done, F.col("timestamp"))).alias("last"),
        F.max(F.when(done, F.col("duration_ms"))).alias("duration_ms"), F.min("session_id").alias("session_id"),
    )
    state = F.when(F.col("ended").isNull(), "open").otherwise(F.regexp_replace("last", "cell_execution_", ""))
    return out.where("started is not null").select("execution_id", "session_id", "started", "ended", "duration_ms", state.alias("state"))


def unmatched_ends(runtime: DataFrame) -> DataFrame:
    starts = runtime.where("event_type = 'cell_execution_start'").select("execution_id")
    return runtime.where("event_type <> 'cell_execution_start'").join(starts, "execution_id", "left_anti")


def orphans(runtime: DataFrame) -> DataFrame:
    """Starts that no end or error follows."""
    ends = runtime.where("event_type <> 'cell_execution_start'").select("execution_id")
    return runtime.where("event_type = 'cell_execution_start'").join(ends, "execution_id", "left_anti")


def newest_open(runtime: DataFrame) -> DataFrame:
    """Each session's open execution that began last; of equal ones the least id."""
    latest = F.max(F.struct(F.col("timestamp"), (-F.col("event_id")).alias("k"), F.col("execution_id"))).alias("x")
    return orphans(runtime).groupBy("session_id").agg(latest).select("session_id", "x.execution_id", "x.timestamp")


def runs(lineage: DataFrame) -> DataFrame:
    """Runs: first start, last event, how long between and the final state."""
    last = F.max_by("event_type", F.struct("event_time", "ol_event_id"))
    out = lineage.groupBy("run_id").agg(F.min(F.when(F.col("event_type") == "START", F.col("event_time"))).alias("started"), F.max("event_time").alias("ended"), last.alias("state"), F.count("*").alias("n_events"))
    return out.withColumn("elapsed_ms", (F.unix_micros("ended") - F.unix_micros("started")) / 1000.0)


def session_overview(runtime: DataFrame) -> DataFrame:
    """Sessions by their events that have a duration."""
    return runtime.where("duration_ms is not null").groupBy("session_id").agg(
        F.count("*").alias("total_events"), F.countDistinct("execution_id").alias("unique_executions"), F.avg("duration_ms").alias("avg_duration_ms"), F.max("duration_ms").alias("max_duration_ms"),
        F.min("timestamp").alias("session_start"), F.max("timestamp").alias("session_end"),
    )


def session_summary(runtime: DataFrame, frames: DataFrame) -> DataFrame:
    """Every session of either table: session_id, n_executions, n_failed, n_operations and n_frames (distinct frames that its operations read or made)."""
    ran = runtime.groupBy("session_id").agg(F.countDistinct("execution_id").alias("n_executions"), F.count_if(F.col("event_type") == "cell_execution_error").alias("n_failed"))
    named = "array<struct<variable_name:string>>"
    both = F.concat(*(F.coalesce(F.from_json(c, named)["variable_name"], F.array().cast("array<string>")) for c in ("input_dataframes", "output_dataframes")))
    ops = frames.groupBy("session_id").agg(F.count("*").alias("n_operations"))
    held = frames.select("session_id", F.explode(both).alias("frame")).groupBy("session_id").agg(F.countDistinct("frame").alias("n_frames"))
    joined = ran.join(ops, "session_id", "full_outer").join(held, "session_id", "full_outer")
    return joined.select("session_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_executions", "n_failed", "n_operations", "n_frames")))


def error_summary(runtime: DataFrame) -> DataFrame:
    kind = F.get_json_object("error_info", "$.error_type").alias("error_type")
    return runtime.where("error_info is not null").groupBy(kind).agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("n_sessions"))


def schema_changes(versions: DataFrame) -> DataFrame:
    """versions: dataset, version_time, columns (an array of names, or of structs of name and type). A row where they differ from the version before: names added, removed and, if types are given, retyped.

    A dataset of any number of versions is spread over tasks: versions lie in ranges of time, and each range's last one is handed on to the next."""
    typed = versions.schema["columns"].dataType.elementType.typeName() == "struct"
    rows = versions.withColumn("columns", F.transform("columns", lambda c: F.struct(c["name"].alias("name"), c["type"].alias("type")) if typed else F.struct(c.alias("name"), F.lit("").alias("type"))))
    rows = rows.repartitionByRange("dataset", "version_time").withColumn("part", F.spark_partition_id())
    rows = settled(rows, "versions")
    last = rows.groupBy("dataset", "part").agg(F.max_by("columns", "version_time").alias("last"))
    handed = F.lag("last").over(Window.partitionBy("dataset").orderBy("part"))
    last = last.select("dataset", "part", handed.alias("handed"))
    w = Window.partitionBy("dataset", "part").orderBy("version_time")
    rows = rows.withColumn("inside", F.lag("columns").over(w)).join(last, ["dataset", "part"]).withColumn("before", F.coalesce("inside", "handed")).where("before is not null")
    names = lambda c: F.transform(c, lambda x: x["name"])
    old, new = names("before"), names("columns")
    other = F.filter("columns", lambda x: F.array_contains(names("before"), x["name"]) & ~F.array_contains(F.col("before"), x))
    out = rows.select("dataset", "version_time", F.array_sort(F.array_except(new, old)).alias("added"), F.array_sort(F.array_except(old, new)).alias("removed"), F.array_sort(names(other)).alias("retyped"))
    return out.where("size(added) > 0 or size(removed) > 0 or size(retyped) > 0")


def dataset_schemas(lineage: DataFrame, side: str = "inputs_json") -> DataFrame:
    """dataset, version_time and columns (name, type) as schema facets of lineage events tell them, for schema_changes."""
    facet = "array<struct<name:string,facets:struct<schema:struct<fields:array<struct<name:string,type:string>>>>>>"
    rows = lineage.select("event_time", F.explode(F.from_json(side, facet)).alias("d"))
    rows = rows.select(F.col("d.name").alias("dataset"), F.col("event_time").alias("version_time"), F.col("d.facets.schema.fields").alias("columns"))
    return rows.where("columns is not null").groupBy("dataset", "version_time").agg(F.max("columns").alias("columns"))


def cell_events(jobs: DataFrame) -> DataFrame:
    """Runtime events of jobs that ran (T18): jobs has execution_id, cell_id, source, session_id, started, ended, start_memory_mb, end_memory_mb, error (text; null: none). A start event each, and an end or an error."""
    ms = (F.unix_micros("ended") - F.unix_micros("started")) / 1000.0
    stamp = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    base = ["execution_id", "cell_id", F.col("source").alias("cell_source"), F.greatest(line_count(F.col("source")), F.lit(1)).alias("cell_source_lines"), "start_memory_mb", "session_id"]
    none = lambda kind: F.lit(None).cast(kind)
    failed = "struct<error_type:string,error_message:string,traceback:string>"
    start = jobs.select(F.lit("cell_execution_start").alias("event_type"), *base, none("double").alias("end_memory_mb"), none("double").alias("duration_ms"), stamp("started").alias("timestamp"), none(failed).alias("error_info"))
    error = F.when(F.col("error").isNotNull(), F.struct(F.lit("Error").alias("error_type"), F.col("error").alias("error_message"), F.lit("").alias("traceback")))
    kind = F.when(F.col("error").isNotNull(), "cell_execution_error").otherwise("cell_execution_end")
    end = jobs.where("ended is not null").select(kind.alias("event_type"), *base, "end_memory_mb", ms.alias("duration_ms"), stamp("ended").alias("timestamp"), error.alias("error_info"))
    return start.unionByName(end).withColumn("emitted_at", F.col("timestamp"))
