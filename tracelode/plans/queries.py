"""Registered queries over the driver's tables, each beside SQL that computes its rows from the base tables without JSON."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.normalize import ROWS
from ..operators import executions, graph, guard, profile, tracked, views
from ..operators.views import names_of
from ..sources import catalogue, jsonl
from ..sources.corpus import LINES, load, spread
from ..streaming.ingest import committed, start_ingest, statistics
from .scratch import file_states, settled, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def us(c: str) -> Column:
    return F.unix_micros(c)


def r6(c: Column) -> Column:
    return F.round(c, 6)


# Tables

def _split(spark: SparkSession, sf_dir: str, kind: str) -> tuple[DataFrame, DataFrame]:
    return jsonl.split(jsonl.checked(LINES[kind](spark, sf_dir), kind), kind, F.col("key"))


_STORED: dict[tuple, DataFrame] = {}
#: The table from which each kind's lines are made.
_MADE_OF = {"runtime": "events", "lineage": "orders", "dataframe_lineage": "customer"}


def _table(spark: SparkSession, sf_dir: str, kind: str, name: str) -> DataFrame:
    """A stored table: lines are checked and typed once for each state of the input and session and written; queries read columns and ranges of times of what is stored. An input whose files are others, or newer, is stored anew.

    Logs are in the order of their times, and so are stored files: wide typed rows aren't sorted."""
    key = (spark.sparkContext.applicationId, shared_dir(spark), sf_dir, kind, file_states(spark, f"{sf_dir}/{_MADE_OF[kind]}.parquet"))
    if key not in _STORED:
        rows = _split(spark, sf_dir, kind)[0]
        _STORED[key] = settled(rows, name)
    return _STORED[key]


def runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "runtime", "runtime_events")


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineage", "lineage_events")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "dataframe_lineage", "dataframe_lineage_events")


def perf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.performance_metrics(runtime(spark, sf_dir), lineage(spark, sf_dir))


def io(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.lineage_io(lineage(spark, sf_dir))


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.dataframe_lineage(frames(spark, sf_dir))


# The same tables in SQL.
_DEFECT = "CASE WHEN event_id % 97 = 0 THEN 97 WHEN event_id % 89 = 0 THEN 89 WHEN event_id % 83 = 0 THEN 83 WHEN event_id % 79 = 0 THEN 79 WHEN event_id % 73 = 0 THEN 73 WHEN event_id % 71 = 0 THEN 71 ELSE 0 END"
RT = f"""rt AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'cell_execution_start' WHEN event_type = 'error' THEN 'cell_execution_error' ELSE 'cell_execution_end' END AS event_type,
 format('{{:08x}}', event_id // 2) AS execution_id, 'cell_' || (user_id % 20) AS cell_id, 'x = ' || event_id AS cell_source, 1 + event_id % 5 AS cell_source_lines, CAST(100 + event_id % 64 AS DOUBLE) AS start_memory_mb,
 CASE WHEN event_id % 2 = 1 THEN CAST(100 + event_id % 64 + event_id % 17 AS DOUBLE) END AS end_memory_mb, CASE WHEN event_id % 2 = 1 THEN round(value * 10, 3) END AS duration_ms, epoch_us(ts) AS us, format('{{:08x}}', user_id) AS session_id,
 CASE WHEN event_id % 2 = 1 AND event_type = 'error' THEN 'E' || (user_id % 3) END AS error_type,
 CASE WHEN event_id % 2 = 1 AND event_type = 'error' THEN '{{"error_message":"failed ' || event_id || '","error_type":"E' || (user_id % 3) || '","traceback":"at 1"}}' END AS error_info FROM events WHERE ({_DEFECT}) = 0)"""
LI = """li AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'START' WHEN 3 THEN 'FAIL' ELSE 'COMPLETE' END AS event_type, epoch_us(o_orderdate) AS us,
 substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) || '-' || substr(md5(CAST(o_orderkey AS VARCHAR)), 9, 4) || '-' || substr(md5(CAST(o_orderkey AS VARCHAR)), 13, 4) || '-' || substr(md5(CAST(o_orderkey AS VARCHAR)), 17, 4) || '-' || substr(md5(CAST(o_orderkey AS VARCHAR)), 21, 12) AS run_id,
 CASE WHEN o_orderkey % 9 <> 0 THEN format('{:08x}', o_orderkey % 4096) END AS execution_id, CASE WHEN o_orderkey % 9 <> 0 THEN format('{:08x}', o_custkey % 64) END AS session_id, CAST(o_orderkey % 3000 AS DOUBLE) AS duration_ms, 'job_' || substr(o_orderpriority, 1, 1) AS job_name,
 'customer_' || (o_custkey % 40) AS in1, CASE WHEN o_orderkey % 3 = 0 THEN 'part_' || (o_orderkey % 30) END AS in2, CASE WHEN o_orderkey % 11 <> 0 THEN 'order_' || (o_orderkey % 50) END AS out1,
 CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS n_in, CASE WHEN o_orderkey % 11 <> 0 THEN 1 END AS n_out FROM orders WHERE o_orderkey % 61 <> 0 AND o_orderkey % 67 <> 0)"""
FR = """fr AS (SELECT c_custkey AS k, format('{:08x}', c_custkey % 4096) AS execution_id, 'cell_' || (c_custkey % 20) AS cell_id, format('{:08x}', c_nationkey) AS session_id, (1700000000 + c_custkey) * 1000000 AS us,
 CASE c_custkey % 6 WHEN 0 THEN 'selection' WHEN 5 THEN 'join' ELSE 'aggregation' END AS operation_type, CASE c_custkey % 6 WHEN 0 THEN '__getitem__' WHEN 1 THEN 'groupby' WHEN 2 THEN 'sum' WHEN 3 THEN 'mean' WHEN 4 THEN 'count' ELSE 'merge' END AS operation_method,
 'df' || c_nationkey AS input_name, c_custkey % 500 AS input_rows, 'out' || c_nationkey AS output_name, (c_custkey % 500) // 2 AS output_rows, (c_custkey % 40) / 8.0 AS overhead_ms, (c_custkey % 16) / 4.0 AS df_size_mb, c_custkey % 2 = 0 AS sampled
 FROM customer WHERE c_custkey % 53 <> 0 AND c_custkey % 59 <> 0 AND c_custkey % 47 <> 0)"""
PM = f"""{RT}, {LI}, pm AS (SELECT rt.event_id, rt.execution_id, rt.cell_id, rt.session_id, rt.event_type AS runtime_event_type, rt.us AS runtime_us, rt.duration_ms AS runtime_duration_ms, rt.start_memory_mb, rt.end_memory_mb, rt.end_memory_mb - rt.start_memory_mb AS memory_delta_mb,
 li.k, li.us AS lineage_us, li.run_id, li.job_name, li.event_type AS lineage_event_type, li.duration_ms AS lineage_duration_ms, li.n_in AS input_count, li.n_out AS output_count, CASE WHEN rt.duration_ms > 0 THEN li.duration_ms / rt.duration_ms END AS duration_ratio
 FROM rt LEFT JOIN li ON rt.execution_id = li.execution_id WHERE rt.event_type IN ('cell_execution_start', 'cell_execution_end'))"""


# Validation

@query("SELECT reason, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN event_id % {m} = 0 THEN '{r}'" for m, r in ((97, "json:$"), (89, "required:$.cell_id"), (83, "additional:$"), (79, "pattern:$.execution_id"), (73, "enum:$.event_type"), (71, "minimum:$.cell_source_lines"))) + " END AS reason FROM events) t WHERE reason IS NOT NULL GROUP BY reason")
def validate_runtime(spark, sf_dir):
    return profile.reasons(_split(spark, sf_dir, "runtime")[1])


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 61 = 0 THEN 'enum:$.producer' WHEN o_orderkey % 67 = 0 THEN 'cast:run_id' END AS reason FROM orders) t WHERE reason IS NOT NULL GROUP BY reason")
def validate_lineage(spark, sf_dir):
    return profile.reasons(_split(spark, sf_dir, "lineage")[1])


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 53 = 0 THEN 'enum:$.operation_method' WHEN c_custkey % 47 = 0 THEN 'not_null:timestamp' WHEN c_custkey % 59 = 0 THEN 'not_null:output_dataframes' END AS reason FROM customer) t WHERE reason IS NOT NULL GROUP BY reason")
def validate_frames(spark, sf_dir):
    return profile.reasons(_split(spark, sf_dir, "dataframe_lineage")[1])


@query(f"SELECT 'runtime' AS kind, count(*) AS total, count(*) FILTER (({_DEFECT}) = 0) AS valid, count(*) FILTER (({_DEFECT}) <> 0) AS invalid, round(CAST(count(*) FILTER (({_DEFECT}) = 0) AS DOUBLE) / count(*), 6) AS rate FROM events UNION ALL SELECT 'lineage', count(*), count(*) FILTER (o_orderkey % 61 <> 0), count(*) FILTER (o_orderkey % 61 = 0), round(CAST(count(*) FILTER (o_orderkey % 61 <> 0) AS DOUBLE) / count(*), 6) FROM orders UNION ALL SELECT 'dataframe_lineage', count(*), count(*) FILTER (c_custkey % 53 <> 0), count(*) FILTER (c_custkey % 53 = 0), round(CAST(count(*) FILTER (c_custkey % 53 <> 0) AS DOUBLE) / count(*), 6) FROM customer")
def compliance_report(spark, sf_dir):
    parts = [profile.compliance(jsonl.checked(LINES[k](spark, sf_dir), k)).select(F.lit(k).alias("kind"), "total", "valid", "invalid", r6(F.col("rate")).alias("rate")) for k in LINES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Normalised rows

@query(f"WITH {RT} SELECT event_id, event_type, execution_id, cell_id, cell_source, cell_source_lines, start_memory_mb, end_memory_mb, duration_ms, us, session_id, error_type FROM rt")
def runtime_events(spark, sf_dir):
    return runtime(spark, sf_dir).select("event_id", "event_type", "execution_id", "cell_id", "cell_source", F.col("cell_source_lines").cast("long").alias("cell_source_lines"), "start_memory_mb", "end_memory_mb", "duration_ms", us("timestamp").alias("us"), "session_id", F.get_json_object("error_info", "$.error_type").alias("error_type"))


@query(f"WITH {LI} SELECT k, run_id, execution_id, event_type, job_name, us, duration_ms, session_id, CASE WHEN out1 IS NOT NULL THEN out1 END AS lineage_of, CASE WHEN out1 IS NOT NULL THEN k % 7 END AS null_count, CASE WHEN k % 13 = 0 THEN 1 END AS extra FROM li")
def lineage_events(spark, sf_dir):
    facet = "map<string,struct<columnMetrics:map<string,struct<nullCount:bigint>>>>"
    metrics = F.from_json("column_metrics_json", facet)
    return lineage(spark, sf_dir).select(
        F.col("ol_event_id").alias("k"), "run_id", "execution_id", "event_type", "job_name", us("event_time").alias("us"), "duration_ms", "session_id",
        F.get(F.json_object_keys("column_lineage_json"), F.lit(0)).alias("lineage_of"), F.get(F.map_values(metrics), F.lit(0))["columnMetrics"]["total"]["nullCount"].alias("null_count"),
        F.from_json("other_facets_json", "map<string,struct<x:bigint>>")["run.extra"]["x"].alias("extra"),
    )


@query(f"WITH {FR} SELECT k, execution_id, cell_id, session_id, us, operation_type, operation_method, overhead_ms, df_size_mb, sampled FROM fr")
def dataframe_lineage_events(spark, sf_dir):
    return frames(spark, sf_dir).select(F.col("df_event_id").alias("k"), "execution_id", "cell_id", "session_id", us("timestamp").alias("us"), "operation_type", "operation_method", "overhead_ms", "df_size_mb", "sampled")


# Views, with all of their columns (times as microseconds, lists of names as texts joined by commas)

@query(f"WITH {LI} SELECT k AS ol_event_id, run_id, execution_id, event_type, job_name, us AS event_time, session_id, CASE WHEN in2 IS NULL THEN in1 ELSE in1 || ',' || in2 END AS input_names, out1 AS output_names, n_in AS input_count, n_out AS output_count FROM li")
def vw_lineage_io(spark, sf_dir):
    v = io(spark, sf_dir)
    return v.withColumns({"event_time": us("event_time"), **{c: F.array_join(c, ",") for c in ("input_names", "output_names")}, **{c: F.col(c).cast("long") for c in ("input_count", "output_count")}})


@query(f"WITH {PM} SELECT execution_id, session_id, cell_id, runtime_event_type, start_memory_mb, end_memory_mb, memory_delta_mb, runtime_duration_ms, runtime_us AS runtime_timestamp, k AS ol_event_id, run_id, lineage_event_type, job_name, lineage_duration_ms, lineage_us AS lineage_timestamp, input_count AS input_dataset_count, output_count AS output_dataset_count, round(duration_ratio, 6) AS lineage_to_runtime_ratio FROM pm")
def vw_performance_metrics(spark, sf_dir):
    v = perf(spark, sf_dir)
    return v.withColumns({**{c: us(c) for c in ("runtime_timestamp", "lineage_timestamp")}, **{c: F.col(c).cast("long") for c in ("input_dataset_count", "output_dataset_count")}, "lineage_to_runtime_ratio": r6(F.col("lineage_to_runtime_ratio"))})


@query(f"WITH {FR} SELECT k AS df_event_id, execution_id, cell_id, session_id, us AS timestamp, operation_type, operation_method, 'df[...]' AS operation_code, 1 AS input_df_count, 1 AS output_df_count, input_name AS input_variable, output_name AS output_variable, input_rows, 3 AS input_cols, output_rows, 2 AS output_cols, 'id,value' AS output_columns, overhead_ms, df_size_mb, sampled, CASE WHEN input_rows > 0 THEN round(CAST(output_rows AS DOUBLE) / input_rows, 6) END AS row_retention_ratio FROM fr")
def vw_dataframe_lineage(spark, sf_dir):
    v = ops(spark, sf_dir)
    return v.withColumns({"timestamp": us("timestamp"), "output_columns": F.array_join("output_columns", ","), "row_retention_ratio": r6(F.col("row_retention_ratio"))})


# Catalogue

@query(f"WITH {PM} SELECT execution_id, cell_id, runtime_event_type AS event_type, runtime_duration_ms AS duration_ms, memory_delta_mb, runtime_us AS timestamp FROM pm ORDER BY runtime_us DESC, execution_id, runtime_event_type LIMIT 20")
def q1_recent_events(spark, sf_dir):
    p = perf(spark, sf_dir).orderBy(F.desc("runtime_timestamp"), "execution_id", "runtime_event_type").limit(20)
    return p.select("execution_id", "cell_id", F.col("runtime_event_type").alias("event_type"), F.col("runtime_duration_ms").alias("duration_ms"), "memory_delta_mb", us("runtime_timestamp").alias("timestamp"))


@query(f"WITH {LI} SELECT job_name, CASE WHEN in2 IS NULL THEN in1 ELSE in1 || ',' || in2 END AS input_names, out1 AS output_names, n_in AS input_count, n_out AS output_count, us AS event_time FROM li WHERE event_type = 'COMPLETE' ORDER BY us DESC, k LIMIT 15")
def q2_lineage_summary(spark, sf_dir):
    p = io(spark, sf_dir).where("event_type = 'COMPLETE'").orderBy(F.desc("event_time"), "ol_event_id").limit(15)
    return p.select("job_name", F.array_join("input_names", ",").alias("input_names"), F.array_join("output_names", ",").alias("output_names"), F.col("input_count").cast("long").alias("input_count"), F.col("output_count").cast("long").alias("output_count"), us("event_time").alias("event_time"))


@query(f"WITH {PM} SELECT execution_id, cell_id, runtime_duration_ms AS duration_ms, memory_delta_mb, round(duration_ratio, 6) AS lineage_to_runtime_ratio FROM pm WHERE runtime_duration_ms > 1000 ORDER BY runtime_duration_ms DESC, execution_id, coalesce(k, -1) LIMIT 10")
def q3_slow_executions(spark, sf_dir):
    p = perf(spark, sf_dir).where("runtime_duration_ms > 1000").orderBy(F.desc("runtime_duration_ms"), "execution_id", F.coalesce("ol_event_id", F.lit(-1))).limit(10)
    return p.select("execution_id", "cell_id", F.col("runtime_duration_ms").alias("duration_ms"), "memory_delta_mb", r6(F.col("lineage_to_runtime_ratio")).alias("lineage_to_runtime_ratio"))


@query(f"WITH {RT} SELECT execution_id, cell_id, event_type, error_info, us AS timestamp FROM rt WHERE error_info IS NOT NULL ORDER BY us DESC, event_id LIMIT 10")
def q4_errors(spark, sf_dir):
    return runtime(spark, sf_dir).where("error_info IS NOT NULL").orderBy(F.desc("timestamp"), "event_id").limit(10).select("execution_id", "cell_id", "event_type", "error_info", us("timestamp").alias("timestamp"))


@query(f"WITH {RT} SELECT execution_id, start_memory_mb, end_memory_mb, end_memory_mb - start_memory_mb AS memory_delta_mb, duration_ms, us AS timestamp FROM rt WHERE end_memory_mb IS NOT NULL ORDER BY us DESC, event_id LIMIT 20")
def q5_memory_trend(spark, sf_dir):
    p = runtime(spark, sf_dir).where("start_memory_mb IS NOT NULL AND end_memory_mb IS NOT NULL").orderBy(F.desc("timestamp"), "event_id").limit(20)
    return p.select("execution_id", "start_memory_mb", "end_memory_mb", (F.col("end_memory_mb") - F.col("start_memory_mb")).alias("memory_delta_mb"), "duration_ms", us("timestamp").alias("timestamp"))


@query(f"WITH {RT} SELECT session_id, count(*) AS total_events, count(DISTINCT execution_id) AS unique_executions, round(avg(duration_ms), 6) AS avg_duration_ms, max(duration_ms) AS max_duration_ms, min(us) AS session_start, max(us) AS session_end FROM rt WHERE duration_ms IS NOT NULL GROUP BY session_id")
def q6_session_overview(spark, sf_dir):
    o = executions.session_overview(runtime(spark, sf_dir)).orderBy(F.desc("session_start"))
    return o.withColumns({"avg_duration_ms": r6(F.col("avg_duration_ms")), "session_start": us("session_start"), "session_end": us("session_end")})


@query(f"WITH {LI} SELECT DISTINCT execution_id, unnest(CASE WHEN in2 IS NULL THEN [in1] ELSE [in1, in2] END) AS input FROM li WHERE execution_id = '00000021'")
def q7_datasets_of_execution(spark, sf_dir):
    return lineage(spark, sf_dir).where("execution_id = '00000021'").select("execution_id", F.explode(names_of(F.col("inputs_json"))).alias("input")).distinct()


@query(f"WITH {RT}, {LI} SELECT rt.event_id, li.k, rt.duration_ms AS runtime_duration_ms, li.duration_ms AS lineage_duration_ms FROM rt JOIN li USING (execution_id) WHERE rt.cell_id = 'cell_3'")
def q8_cell_timing(spark, sf_dir):
    l = lineage(spark, sf_dir).select("execution_id", F.col("ol_event_id").alias("k"), F.col("duration_ms").alias("lineage_duration_ms"))
    return runtime(spark, sf_dir).where("cell_id = 'cell_3'").select("event_id", "execution_id", F.col("duration_ms").alias("runtime_duration_ms")).join(l, "execution_id").drop("execution_id")


@query(f"WITH {RT} SELECT session_id, round(avg(end_memory_mb - start_memory_mb), 6) AS avg_delta, count(DISTINCT cell_id) AS n_cells FROM rt WHERE event_type = 'cell_execution_end' GROUP BY session_id")
def q9_session_memory(spark, sf_dir):
    return runtime(spark, sf_dir).where("event_type = 'cell_execution_end'").groupBy("session_id").agg(r6(F.avg(F.col("end_memory_mb") - F.col("start_memory_mb"))).alias("avg_delta"), F.countDistinct("cell_id").alias("n_cells"))


@query(f"WITH {LI} SELECT k, run_id FROM li WHERE in1 LIKE '%mer_7%' OR coalesce(in2, '') LIKE '%mer_7%'")
def q10_runs_by_input(spark, sf_dir):
    return io(spark, sf_dir).where(F.exists("input_names", lambda n: n.like("%mer_7%"))).select(F.col("ol_event_id").alias("k"), "run_id")


@query(f"WITH {LI} SELECT k, out1 AS output, 'total' AS target_column, 'c_custkey' AS source_column FROM li WHERE out1 IS NOT NULL")
def q11_column_lineage(spark, sf_dir):
    facet = "map<string,struct<fields:map<string,struct<inputFields:array<struct<field:string>>>>>>"
    p = lineage(spark, sf_dir).where("column_lineage_json IS NOT NULL").select("ol_event_id", F.explode(F.from_json("column_lineage_json", facet)).alias("output", "f"))
    return p.select(F.col("ol_event_id").alias("k"), "output", F.explode("f.fields").alias("target_column", "g")).select("k", "output", "target_column", F.get("g.inputFields", F.lit(0))["field"].alias("source_column"))


@query(f"WITH {PM} SELECT execution_id, coalesce(k, -1) AS k, runtime_duration_ms FROM pm WHERE runtime_duration_ms IS NOT NULL ORDER BY runtime_duration_ms DESC, execution_id, 2 LIMIT 10")
def q12_slowest_first(spark, sf_dir):
    p = perf(spark, sf_dir).withColumn("k", F.coalesce("ol_event_id", F.lit(-1)))
    return p.where("runtime_duration_ms is not null").orderBy(F.desc("runtime_duration_ms"), "execution_id", "k").limit(10).select("execution_id", "k", "runtime_duration_ms")


@query(f"WITH {LI} SELECT k, k % 7 AS null_count FROM li WHERE out1 IS NOT NULL AND k % 7 > 4")
def q13_nested_facet(spark, sf_dir):
    found = F.get_json_object(F.get(F.map_values(F.from_json("column_metrics_json", "map<string,string>")), F.lit(0)), "$.columnMetrics.total.nullCount").cast("long")
    return lineage(spark, sf_dir).select(F.col("ol_event_id").alias("k"), found.alias("null_count")).where("null_count > 4")


@query(f"WITH {LI} SELECT k, 'c_custkey,c_name' AS fields FROM li")
def q14_schema_fields(spark, sf_dir):
    parsed = F.from_json("inputs_json", "array<struct<facets:struct<schema:struct<fields:array<struct<name:string>>>>>>")
    return lineage(spark, sf_dir).select(F.col("ol_event_id").alias("k"), F.array_join(F.get(parsed, F.lit(0))["facets"]["schema"]["fields"]["name"], ",").alias("fields"))


@query(f"WITH {FR} SELECT operation_type, count(*) AS n FROM fr GROUP BY operation_type")
def q15_operation_types(spark, sf_dir):
    return frames(spark, sf_dir).groupBy("operation_type").agg(F.count("*").alias("n"))


@query(f"WITH {FR} SELECT operation_method, round(avg(overhead_ms), 6) AS avg_overhead, count(*) AS n FROM fr GROUP BY operation_method")
def q16_operation_times(spark, sf_dir):
    return frames(spark, sf_dir).groupBy("operation_method").agg(r6(F.avg("overhead_ms")).alias("avg_overhead"), F.count("*").alias("n")).orderBy(F.desc("avg_overhead"))


@query(f"WITH {PM} SELECT execution_id, runtime_event_type, coalesce(k, -1) AS k, memory_delta_mb FROM pm WHERE memory_delta_mb > 10")
def q17_memory_deltas(spark, sf_dir):
    return perf(spark, sf_dir).where("memory_delta_mb > 10").select("execution_id", "runtime_event_type", F.coalesce("ol_event_id", F.lit(-1)).alias("k"), "memory_delta_mb").orderBy(F.desc("memory_delta_mb"))


@query(f"WITH {RT}, {LI}, {FR} SELECT 'dataframe_lineage_events' AS table_name, count(*) AS n_rows FROM fr UNION ALL SELECT 'lineage_events', count(*) FROM li UNION ALL SELECT 'runtime_events', count(*) FROM rt")
def q18_events_per_table(spark, sf_dir):
    return profile.table_counts({"runtime_events": runtime(spark, sf_dir), "lineage_events": lineage(spark, sf_dir), "dataframe_lineage_events": frames(spark, sf_dir)})


@query(f"WITH {RT}, {LI} SELECT rt.session_id, count(*) AS n FROM rt JOIN li ON rt.execution_id = li.execution_id GROUP BY rt.session_id")
def q19_joined_sessions(spark, sf_dir):
    return runtime(spark, sf_dir).select("execution_id", "session_id").join(lineage(spark, sf_dir).select("execution_id"), "execution_id").groupBy("session_id").agg(F.count("*").alias("n"))


@query(f"WITH {RT}, {LI}, {FR} SELECT rt.event_id, li.k AS lineage_k, coalesce(fr.k, -1) AS frame_k FROM rt JOIN li ON rt.execution_id = li.execution_id LEFT JOIN fr ON rt.execution_id = fr.execution_id WHERE rt.event_type = 'cell_execution_end'")
def q20_three_way(spark, sf_dir):
    r = runtime(spark, sf_dir).where("event_type = 'cell_execution_end'").select("event_id", "execution_id")
    l = lineage(spark, sf_dir).select("execution_id", F.col("ol_event_id").alias("lineage_k"))
    f = frames(spark, sf_dir).select("execution_id", F.col("df_event_id").alias("frame_k"))
    return r.join(l, "execution_id").join(f, "execution_id", "left").select("event_id", "lineage_k", F.coalesce("frame_k", F.lit(-1)).alias("frame_k"))


# Executions

@query(f"WITH {RT} SELECT execution_id, min(us) FILTER (event_type = 'cell_execution_start') AS started_us, max(us) FILTER (event_type <> 'cell_execution_start') AS ended_us, max(duration_ms) AS duration_ms, coalesce(max(substr(event_type, 16)) FILTER (event_type <> 'cell_execution_start'), 'open') AS state FROM rt GROUP BY execution_id HAVING count(*) FILTER (event_type = 'cell_execution_start') > 0")
def paired_executions(spark, sf_dir):
    return executions.paired(runtime(spark, sf_dir)).select("execution_id", us("started").alias("started_us"), us("ended").alias("ended_us"), "duration_ms", "state")


@query(f"WITH {RT} SELECT event_id, execution_id FROM rt a WHERE event_type <> 'cell_execution_start' AND NOT EXISTS (SELECT 1 FROM rt b WHERE b.execution_id = a.execution_id AND b.event_type = 'cell_execution_start')")
def unmatched_ends(spark, sf_dir):
    return executions.unmatched_ends(runtime(spark, sf_dir)).select("event_id", "execution_id")


@query(f"WITH {RT} SELECT event_id, execution_id FROM rt a WHERE event_type = 'cell_execution_start' AND NOT EXISTS (SELECT 1 FROM rt b WHERE b.execution_id = a.execution_id AND b.event_type <> 'cell_execution_start')")
def orphan_executions(spark, sf_dir):
    return executions.orphans(runtime(spark, sf_dir)).select("event_id", "execution_id")


@query(f"WITH {RT} SELECT session_id, execution_id, us FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY us DESC, event_id) AS n FROM rt a WHERE event_type = 'cell_execution_start' AND NOT EXISTS (SELECT 1 FROM rt b WHERE b.execution_id = a.execution_id AND b.event_type <> 'cell_execution_start')) t WHERE n = 1")
def newest_open(spark, sf_dir):
    return executions.newest_open(runtime(spark, sf_dir)).select("session_id", "execution_id", us("timestamp").alias("us"))


@query(f"WITH {RT} SELECT error_type, count(*) AS n, count(DISTINCT session_id) AS n_sessions FROM rt WHERE error_type IS NOT NULL GROUP BY error_type")
def error_summary(spark, sf_dir):
    return executions.error_summary(runtime(spark, sf_dir))


@query(f"WITH {LI} SELECT job_name, event_type AS state, count(*) AS n_runs, count(*) FILTER (event_type = 'START') AS n_started FROM li GROUP BY job_name, event_type")
def run_states(spark, sf_dir):
    runs = executions.runs(lineage(spark, sf_dir)).join(lineage(spark, sf_dir).select("run_id", "job_name").distinct(), "run_id")
    return runs.groupBy("job_name", "state").agg(F.count("*").alias("n_runs"), F.count("started").alias("n_started"))


@query("WITH v AS (SELECT 'order_' || (o_orderkey % 50) AS dataset, o_orderkey AS k, o_orderkey // 50 % 3 AS m, lag(o_orderkey // 50 % 3) OVER (PARTITION BY o_orderkey % 50 ORDER BY o_orderkey) AS b FROM orders) SELECT dataset, k, CASE WHEN m = 2 THEN 'c' WHEN b = 0 THEN 'b' WHEN m = 0 THEN '' WHEN b = 2 AND m = 1 THEN 'b' ELSE '' END AS added, CASE WHEN m = 0 AND b = 2 THEN 'c' WHEN m = 0 AND b = 1 THEN 'b' WHEN m = 2 AND b = 1 THEN 'b' WHEN m = 1 AND b = 2 THEN 'c' ELSE '' END AS removed FROM v WHERE b IS NOT NULL AND m <> b")
def schema_changes(spark, sf_dir):
    v = load(spark, sf_dir, "orders").selectExpr("concat('order_', o_orderkey % 50) AS dataset", "o_orderkey AS version_time", "element_at(array(array('a'), array('a', 'b'), array('a', 'c')), cast(o_orderkey div 50 % 3 AS int) + 1) AS columns")
    return executions.schema_changes(v).select("dataset", F.col("version_time").alias("k"), F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


@query("WITH v AS (SELECT 'table_' || (o_orderkey % 50) AS dataset, o_orderkey AS k, o_orderkey // 50 % 3 AS m, lag(o_orderkey // 50 % 3) OVER (PARTITION BY o_orderkey % 50 ORDER BY o_orderkey) AS b FROM orders) SELECT dataset, k, CASE WHEN m = 2 THEN 'b' ELSE '' END AS added, CASE WHEN b = 2 THEN 'b' ELSE '' END AS removed, CASE WHEN (m = 0) <> (b = 0) THEN 'a' ELSE '' END AS retyped FROM v WHERE b IS NOT NULL AND m <> b")
def schema_retypes(spark, sf_dir):
    """Versions of schemas as facets of lineage events tell them: a is an int, then a long, then a long beside b."""
    facet = lambda x: f"concat('[{{\"name\":\"table_', o_orderkey % 50, '\",\"facets\":{{\"schema\":{{\"fields\":', {x}, '}}}}}}]')"
    fields = "element_at(array('[{\"name\":\"a\",\"type\":\"int\"}]', '[{\"name\":\"a\",\"type\":\"long\"}]', '[{\"name\":\"a\",\"type\":\"long\"},{\"name\":\"b\",\"type\":\"int\"}]'), cast(o_orderkey div 50 % 3 AS int) + 1)"
    events = load(spark, sf_dir, "orders").selectExpr("timestamp_seconds(o_orderkey) AS event_time", f"{facet(fields)} AS inputs_json")
    found = executions.schema_changes(executions.dataset_schemas(events))
    return found.select("dataset", F.unix_seconds("version_time").alias("k"), *(F.array_join(c, ",").alias(c) for c in ("added", "removed", "retyped")))


@query(f"SELECT path_rule AS rule, ordinal, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN event_id % {m} = 0 THEN '{r}'" for m, r in ((97, "json:$"), (89, "required:$.cell_id"), (83, "additional:$"), (79, "pattern:$.execution_id"), (73, "enum:$.event_type"), (71, "minimum:$.cell_source_lines"))) + " END AS path_rule, 1 AS ordinal FROM events) t WHERE path_rule IS NOT NULL GROUP BY path_rule, ordinal")
def compliance_errors(spark, sf_dir):
    """Every broken rule with its ordinal in its event."""
    found = profile.errors_listed(jsonl.checked(LINES["runtime"](spark, sf_dir), "runtime"), "key")
    return found.groupBy(F.concat_ws(":", "rule", "path").alias("rule"), "ordinal").agg(F.count("*").alias("n"))


@query(f"WITH {RT}, {LI}, {FR} SELECT * FROM (SELECT 'runtime_events' AS table_name, event_id AS k, row_number() OVER (ORDER BY us, event_id) AS n FROM rt) WHERE n <= 5 UNION ALL SELECT * FROM (SELECT 'lineage_events', k, row_number() OVER (ORDER BY us, k) AS n FROM li) WHERE n <= 5")
def table_samples(spark, sf_dir):
    """The first rows of a table, as a look at it."""
    out = None
    for name, df, key, time in (("runtime_events", runtime(spark, sf_dir), "event_id", "timestamp"), ("lineage_events", lineage(spark, sf_dir), "ol_event_id", "event_time")):
        rows = profile.first_rows(df.select(time, F.col(key).alias("k")), time)
        part = rows.select(F.lit(name).alias("table_name"), "k", F.row_number().over(Window.orderBy(time, "k")).cast("long").alias("n"))  # five rows
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {PM}, {FR} SELECT pm.session_id, count(*) AS n, round(avg(duration_ratio), 6) AS ratio FROM pm WHERE duration_ratio IS NOT NULL GROUP BY pm.session_id")
def catalogue_sql(spark, sf_dir):
    """A user's SQL on the registered views, by their names."""
    catalogue.register(spark, runtime(spark, sf_dir), lineage(spark, sf_dir), frames(spark, sf_dir))
    return guard.guarded_sql(spark, "SELECT session_id, count(*) AS n, round(avg(lineage_to_runtime_ratio), 6) AS ratio FROM vw_performance_metrics WHERE lineage_to_runtime_ratio IS NOT NULL GROUP BY session_id", limit=None)


# Graph

_EDGES = "ed AS (SELECT in1 AS source, out1 AS target, k FROM li WHERE out1 IS NOT NULL UNION ALL SELECT in2, out1, k FROM li WHERE out1 IS NOT NULL AND in2 IS NOT NULL)"


@query(f"WITH {LI}, {_EDGES} SELECT source, target, count(*) AS n_runs FROM ed GROUP BY source, target")
def dataset_edges(spark, sf_dir):
    return graph.dataset_edges(lineage(spark, sf_dir)).groupBy("source", "target").agg(F.count("*").alias("n_runs"))


@query(f"WITH {LI} SELECT in1 AS source, 'c_custkey' AS source_column, out1 AS target, 'total' AS target_column, count(*) AS n FROM li WHERE out1 IS NOT NULL GROUP BY in1, out1")
def column_edges(spark, sf_dir):
    return graph.column_edges(lineage(spark, sf_dir)).groupBy("source", "source_column", "target", "target_column").agg(F.count("*").alias("n"))


@query(f"WITH {FR} SELECT input_name AS source, c AS source_column, output_name AS target, 'value' AS target_column, count(*) AS n FROM fr, (VALUES ('value'), ('id')) t(c) GROUP BY input_name, c, output_name")
def frame_column_edges(spark, sf_dir):
    return graph.frame_column_edges(frames(spark, sf_dir)).groupBy("source", "source_column", "target", "target_column").agg(F.count("*").alias("n"))


@query(f"WITH {LI}, {_EDGES}, d AS (SELECT DISTINCT source, target FROM ed), b AS (SELECT source AS node, 0 AS i, 1 AS o FROM d UNION ALL SELECT target, 1, 0 FROM d) SELECT node, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out, CASE WHEN sum(i) = 0 THEN 'root' WHEN sum(o) = 0 THEN 'leaf' ELSE 'inner' END AS role FROM b GROUP BY node")
def dataset_degrees(spark, sf_dir):
    return graph.degrees(graph.dataset_edges(lineage(spark, sf_dir)))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of turns as datasets, each made from the one before it."""
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    return c.selectExpr("concat(conv_id, ':', turn) AS source", "concat(conv_id, ':', turn + 1) AS target")


_TURNS = "tu AS (SELECT DISTINCT conv_id || ':' || turn AS source, conv_id || ':' || (turn + 1) AS target FROM conversations)"


@query(f"WITH RECURSIVE {_TURNS}, up AS (SELECT target AS seed, source AS node, 1 AS depth FROM tu UNION SELECT up.seed, tu.source, up.depth + 1 FROM up JOIN tu ON up.node = tu.target) SELECT seed, node, CAST(min(depth) AS INTEGER) AS depth FROM up GROUP BY seed, node")
def upstream_closure(spark, sf_dir):
    e = settled(_turns(spark, sf_dir).distinct(), "turns")
    return graph.upstream(e, e.select(F.col("target").alias("node")))


@query(f"WITH RECURSIVE {_TURNS}, dn AS (SELECT source AS seed, target AS node, 1 AS depth FROM tu WHERE source LIKE '%:0' UNION SELECT dn.seed, tu.target, dn.depth + 1 FROM dn JOIN tu ON dn.node = tu.source) SELECT seed, count(DISTINCT node) AS n_nodes, CAST(max(depth) AS INTEGER) AS max_depth FROM dn GROUP BY seed")
def impact_analysis(spark, sf_dir):
    e = settled(_turns(spark, sf_dir).distinct(), "turns")
    return graph.impact(e, e.where("source LIKE '%:0'").select(F.col("source").alias("node")))


@query("SELECT 'n' || n_nationkey AS node, min('n' || n_nationkey) OVER (PARTITION BY n_regionkey) AS component FROM nation")
def cycles(spark, sf_dir):
    """Nations joined to all of their region, reached from customers, which lie on no cycle; a component for each region."""
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    a, b = n.alias("a"), n.alias("b")
    ring = a.join(b, "n_regionkey").selectExpr("concat('n', a.n_nationkey) AS source", "concat('n', b.n_nationkey) AS target")
    return graph.in_cycles(ring.unionByName(load(spark, sf_dir, "customer").selectExpr("concat('c', c_custkey) AS source", "concat('n', c_nationkey) AS target")))


@query(f"WITH {FR} SELECT input_name AS seed, count(*) AS n_operations, CAST(sum(input_rows) AS BIGINT) AS rows_in, CAST(sum(output_rows) AS BIGINT) AS rows_out, round(sum(overhead_ms), 6) AS overhead_ms, max(df_size_mb) AS max_mb, CASE WHEN sum(input_rows) > 0 THEN round(CAST(sum(output_rows) AS DOUBLE) / sum(input_rows), 6) END AS retention FROM fr GROUP BY input_name")
def chain_metrics(spark, sf_dir):
    view = ops(spark, sf_dir)
    edges = view.select(F.col("input_variable").alias("source"), F.col("output_variable").alias("target"))
    m = graph.chain_metrics(graph.closure(edges, edges.select(F.col("source").alias("node"))), view)
    return m.withColumn("overhead_ms", r6(F.col("overhead_ms"))).withColumn("retention", r6(F.col("retention")))


# Profiles, tracked operations, guard

@query("SELECT 'o_custkey' AS \"column\", count(*) FILTER (o_custkey IS NULL) AS null_count, count(DISTINCT o_custkey) AS distinct_count, CAST(min(o_custkey) AS VARCHAR) AS least, CAST(max(o_custkey) AS VARCHAR) AS most FROM orders UNION ALL SELECT 'o_orderkey' AS \"column\", count(*) FILTER (o_orderkey IS NULL) AS null_count, count(DISTINCT o_orderkey) AS distinct_count, CAST(min(o_orderkey) AS VARCHAR) AS least, CAST(max(o_orderkey) AS VARCHAR) AS most FROM orders UNION ALL SELECT 'o_orderstatus' AS \"column\", count(*) FILTER (o_orderstatus IS NULL) AS null_count, count(DISTINCT o_orderstatus) AS distinct_count, CAST(min(o_orderstatus) AS VARCHAR) AS least, CAST(max(o_orderstatus) AS VARCHAR) AS most FROM orders UNION ALL SELECT 'o_orderpriority' AS \"column\", count(*) FILTER (o_orderpriority IS NULL) AS null_count, count(DISTINCT o_orderpriority) AS distinct_count, CAST(min(o_orderpriority) AS VARCHAR) AS least, CAST(max(o_orderpriority) AS VARCHAR) AS most FROM orders UNION ALL SELECT 'o_totalprice' AS \"column\", count(*) FILTER (o_totalprice IS NULL) AS null_count, count(DISTINCT o_totalprice) AS distinct_count, CAST(min(o_totalprice) AS VARCHAR) AS least, CAST(max(o_totalprice) AS VARCHAR) AS most FROM orders")
def column_profile(spark, sf_dir):
    return profile.column_profile(load(spark, sf_dir, "orders"), ["o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"])


@query("SELECT 'selection' AS operation_type, '__getitem__' AS operation_method, 1 AS step, (SELECT count(*) FROM orders) AS rows_in, (SELECT count(*) FROM orders) AS rows_out, 2 AS columns_out UNION ALL SELECT 'selection', '__getitem__', 2, (SELECT count(*) FROM orders), (SELECT count(*) FROM orders WHERE o_totalprice > 100000), 2 UNION ALL SELECT 'join', 'merge', 3, (SELECT count(*) FROM orders WHERE o_totalprice > 100000), (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000), 4 UNION ALL SELECT 'aggregation', 'mean', 4, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000), (SELECT count(DISTINCT c_nationkey) FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000), 2")
def tracked_events(spark, sf_dir):
    """A chain of tracked operations, with the events that they leave."""
    a = tracked.track_select(load(spark, sf_dir, "orders"), ["o_custkey", "o_totalprice"])
    b = tracked.track_filter(a.result, "o_totalprice > 100000")
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_acctbal")
    j = tracked.track_join(b.result, c, "o_custkey")
    g = tracked.track_group(j.result, ["c_nationkey"], "mean", ["o_totalprice"])
    out = None
    for step, t in enumerate((a, b, j, g), 1):
        shape = lambda c, k: F.get(F.get(F.col(c), F.lit(0))["shape"], F.lit(k))
        e = t.events.select("operation_type", "operation_method", F.lit(step).alias("step"), shape("input_dataframes", 0).alias("rows_in"), shape("output_dataframes", 0).alias("rows_out"), shape("output_dataframes", 1).alias("columns_out"))
        out = e if out is None else out.unionByName(e)
    return out


@query("SELECT l_returnflag, round(sum(l_quantity), 2) AS l_quantity FROM lineitem WHERE l_discount > 0.05 GROUP BY l_returnflag")
def tracked_result(spark, sf_dir):
    f = tracked.track_filter(load(spark, sf_dir, "lineitem"), "l_discount > 0.05")
    return tracked.track_group(f.result, ["l_returnflag"], "sum", ["l_quantity"]).result.select("l_returnflag", F.round("l_quantity", 2).alias("l_quantity"))


#: Query texts with the verdict that each must get.
TEXTS = (
    ("SELECT * FROM runtime_events WHERE cell_id = '{}'", "valid"), ("  select a from vw_lineage_io join lineage_events using (run_id) where x = 'INSERT {}'", "valid"), ("WITH x AS (SELECT '{}') SELECT * FROM x", "not_select"),
    ("SELECT 1 -- {}", "dangerous_pattern"), ("SELECT '{}' UNION SELECT 2", "dangerous_pattern"), ("SELECT exp_{} FROM runtime_events", "dangerous_pattern"), ("SELECT CREATE '{}' FROM runtime_events", "forbidden_operation"),
    ("SELECT * FROM `secrets` WHERE n = '{}'", "unauthorized_table"), ("SELECT * FROM runtime_events, secrets_{}", "unauthorized_table"), ("SELECT * FROM(secrets_{})", "unauthorized_table"), ("SELECT * FROM runtime_events r, `parquet`.`/etc/{}`", "unauthorized_table"),
    ("SELECT * FROM (SELECT '{}' FROM runtime_events) t, secrets", "unauthorized_table"), ("SELECT * FROM \"secrets_{}\"", "unauthorized_table"), ("SELECT count(*) AS n, max(a) FROM `runtime_events` r, vw_lineage_io v WHERE r.k IN (SELECT k FROM lineage_events WHERE x = '(from z{}')", "valid"),
    ("SELECT * FROM secrets_{}", "unauthorized_table"), ("SELECT * FROM (SELECT '{}' FROM runtime_events) t", "valid"), ("DELETE FROM runtime_events WHERE n = '{}'", "not_select"),
)


@query("SELECT verdict, CAST(count(*) AS BIGINT) AS n FROM customer, (VALUES " + ", ".join(f"('{v}')" for _, v in TEXTS) + ") t(verdict) GROUP BY verdict")
def query_log_audit(spark, sf_dir):
    texts = F.explode(F.array(*map(F.lit, (t for t, _ in TEXTS)))).alias("t")
    log = spread(load(spark, sf_dir, "customer")).select("c_custkey", texts).select(F.replace("t", F.lit("{}"), F.col("c_custkey").cast("string")).alias("sql"))
    return log.select(guard.audit(F.col("sql"))["verdict"].alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


@query(f"WITH {RT}, {LI} SELECT 'runtime_events' AS table_name, count(*) AS n_rows, 13 AS n_columns FROM rt UNION ALL SELECT 'lineage_events', count(*), 14 FROM li")
def inspect_schema(spark, sf_dir):
    found = guard.inspect_schema({"runtime_events": runtime(spark, sf_dir), "lineage_events": lineage(spark, sf_dir)})
    return found.where("error is null").groupBy("table_name").agg(F.max("n_rows").alias("n_rows"), F.count("*").cast("int").alias("n_columns"))


@query(f"WITH {RT} SELECT cell_id, count(*) AS n FROM rt WHERE duration_ms > 500 GROUP BY cell_id")
def guarded_query(spark, sf_dir):
    runtime(spark, sf_dir).createOrReplaceTempView("runtime_events")
    return guard.guarded_sql(spark, "SELECT cell_id, count(*) AS n FROM runtime_events WHERE duration_ms > ? GROUP BY cell_id", args=[500])


@query("SELECT event_id, substr(sha256('/nb/' || user_id || '/a b.py'), 1, 8) AS notebook_hash, 'a_b' AS notebook_name, 1 + event_id % 3 AS n_lines, CAST(event_id AS DOUBLE) / 1048576 AS mb FROM events")
def scalar_functions(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("path", F.expr("concat('/nb/', user_id, '/a b.py')")).withColumn("source", F.expr("concat('x', repeat('\\ny', cast(event_id % 3 as int)))"))
    return e.select("event_id", scalars.notebook_hash(F.col("path")).alias("notebook_hash"), scalars.notebook_name(F.col("path")).alias("notebook_name"), scalars.line_count(F.col("source")).cast("long").alias("n_lines"), scalars.megabytes(F.col("event_id")).alias("mb"))


# Files and streams

def _written(spark: SparkSession, sf_dir: str) -> str:
    """The runtime lines as files of two notebooks under a root of event directories."""
    root = f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    for name in ("aaaaaaaa", "bbbbbbbb"):
        part = LINES["runtime"](spark, sf_dir).where(f"key % 2 = {0 if name[0] == 'a' else 1}")
        part.select("value").write.text(f"{root}/staging/{name}")
    return root


@query(f"WITH {RT} SELECT event_type, count(*) AS n, count(DISTINCT execution_id) AS n_executions FROM rt GROUP BY event_type")
def scanned_logs(spark, sf_dir):
    """Lines written as text and read back, with a row identity for each."""
    root = _written(spark, sf_dir)
    lines = spark.read.text([f"{root}/staging/aaaaaaaa", f"{root}/staging/bbbbbbbb"]).select("value", F.col("_metadata.file_path").alias("path")).where(F.trim("value") != "")
    rows = jsonl.split(jsonl.checked(jsonl.identified(lines), "runtime"), "runtime", F.xxhash64("row_id"))[0]
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("execution_id").alias("n_executions"))


@query(f"SELECT CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(ok) AS BIGINT) AS processed, CAST(sum(n - ok) AS BIGINT) AS failed FROM (SELECT 1 AS n, CASE WHEN ({_DEFECT}) = 0 THEN 1 ELSE 0 END AS ok FROM events UNION ALL SELECT 1, CASE WHEN o_orderkey % 61 <> 0 THEN 1 ELSE 0 END FROM orders UNION ALL SELECT 1, CASE WHEN c_custkey % 53 <> 0 THEN 1 ELSE 0 END FROM customer) t")
def ingest_statistics(spark, sf_dir):
    """All three kinds through their streams: lines read, processed and failed, by file, summed."""
    root, out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", None
    for kind in LINES:
        LINES[kind](spark, sf_dir).select("value").write.option("compression", "lz4").text(f"{root}/in/{kind}")
        start_ingest(spark, kind, f"{root}/in", f"{root}/{kind}", f"{root}/bad-{kind}", f"{root}/check-{kind}", glob="*").awaitTermination()
        part = statistics(spark, f"{root}/{kind}", f"{root}/bad-{kind}")
        out = part if out is None else out.unionByName(part)
    return out.agg(*(F.sum(c).alias(c) for c in ("n_lines", "processed", "failed")))


@query(f"WITH {RT} SELECT session_id, count(*) AS n, max(duration_ms) AS max_duration FROM rt GROUP BY session_id")
def streamed_ingest(spark, sf_dir):
    """The same files through the stream, twice: the second run finds nothing new, and identities are unique."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    LINES["runtime"](spark, sf_dir).select("value").write.text(f"{root}/in/runtime")
    # Text writers name their files part-*.txt; the stream takes them by directory.
    for _ in range(2):
        start_ingest(spark, "runtime", f"{root}/in", f"{root}/table", f"{root}/quarantine", f"{root}/checkpoint", glob="*").awaitTermination()
    return committed(spark, "runtime", f"{root}/table").groupBy("session_id").agg(F.count("*").alias("n"), F.max("duration_ms").alias("max_duration"))


assert set(ROWS) == set(LINES)
