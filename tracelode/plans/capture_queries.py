"""Registered queries on what captures events: tracked frames, run and cell events, the guard's reports, looks at tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.normalize import lineage_rows
from ..operators import executions, guard, tracked
from ..sources import jsonl
from ..sources.corpus import LINES, hex8, load, spread
from .queries import LI, RT, TEXTS, io, query, r6, runtime
from .scratch import shared_dir

_TYPE = "CASE WHEN {m} = 'merge' THEN 'join' WHEN {m} IN ('groupby', 'sum', 'mean', 'count') THEN 'aggregation' ELSE 'selection' END"
_METHOD = "CASE WHEN c_custkey % 53 = 0 THEN 'groupby.sum' ELSE CASE c_custkey % 6 WHEN 0 THEN '__getitem__' WHEN 1 THEN 'groupby' WHEN 2 THEN 'sum' WHEN 3 THEN 'mean' WHEN 4 THEN 'count' ELSE 'merge' END END"


@query(f"SELECT operation_method, {_TYPE.format(m='operation_method')} AS operation_type, count(*) AS n FROM (SELECT {_METHOD} AS operation_method FROM customer) t GROUP BY operation_method")
def operation_types(spark, sf_dir):
    """Types by methods, unknown methods among them."""
    method = F.get_json_object("value", "$.operation_method").alias("operation_method")
    rows = LINES["dataframe_lineage"](spark, sf_dir).select(method)
    return rows.groupBy("operation_method", tracked.operation_type(F.col("operation_method")).alias("operation_type")).agg(F.count("*").alias("n"))


_J = "orders JOIN customer ON o_custkey = c_custkey"


@query(f"""SELECT 1 AS step, 'selection' AS operation_type, '{{"columns":["o_custkey","o_totalprice"]}}' AS parameters, count(*) AS rows_in, count(*) AS rows_out, 'orders.o_custkey' AS origin FROM orders
UNION ALL SELECT 2, 'selection', '{{"condition":"o_totalprice > 150000","is_boolean_mask":true}}', count(*), count(*) FILTER (o_totalprice > 150000), 'orders.o_custkey' FROM orders
UNION ALL SELECT 3, 'join', '{{"how":"inner","on":"o_custkey"}}', (SELECT count(*) FROM orders), count(*), 'orders.o_custkey,customer.o_custkey' FROM {_J}
UNION ALL SELECT 4, 'aggregation', '{{"columns":["o_custkey"]}}', (SELECT count(*) FROM orders), count(DISTINCT o_custkey), 'orders.o_custkey' FROM orders
UNION ALL SELECT 5, 'selection', '{{"columns":["gross"],"value_type":"double"}}', count(*), count(*), 'orders.o_custkey' FROM orders""")
def tracked_parameters(spark, sf_dir):
    """Parameters of each tracked operation, its rows before and after, and where one column of its result comes from."""
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    customer = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    done = [
        tracked.track_select(orders, ["o_custkey", "o_totalprice"], "orders"), tracked.track_filter(orders, "o_totalprice > 150000", "orders"), tracked.track_join(orders, customer, "o_custkey", names=("orders", "customer")),
        tracked.track_group(orders, ["o_custkey"], "count", ["o_totalprice"], "orders"), tracked.track_with_column(orders, "gross", F.col("o_totalprice") * 1.1, "orders"),
    ]
    out = None
    for step, t in enumerate(done, 1):
        rows = lambda c: F.get(F.get(F.col(c), F.lit(0))["shape"], F.lit(0))
        part = t.events.select(F.lit(step).alias("step"), "operation_type", F.to_json("operation_parameters").alias("parameters"), rows("input_dataframes").alias("rows_in"), rows("output_dataframes").alias("rows_out"), F.array_join(F.col("column_lineage")["column_mapping"]["out.o_custkey"], ",").alias("origin"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT 'START' AS event_type, 'create_orders' AS job_name, NULL AS column_set, NULL AS value_type, count(*) AS n_rows, count(*) * 0.0 AS total, true AS valid FROM orders UNION ALL SELECT 'COMPLETE', 'modify_orders', 'gross', 'double', count(*), round(sum(o_totalprice * 2), 2), true FROM orders")
def tracked_sources(spark, sf_dir):
    """A frame created and a column set on it: the frames, and the run events that they leave, which keep the rules."""
    place = tracked.Place("0000000a", "cell_1", "0000000b")
    frame, started = tracked.track_source(load(spark, sf_dir, "orders"), "orders", place)
    made, changed = tracked.set_column(frame, "gross", F.col("o_totalprice") * 2, "orders", place)
    out = None
    for line, total in ((started, frame.agg(F.count("*").alias("n_rows"), F.lit(0.0).alias("total"))), (changed, made.agg(F.count("*").alias("n_rows"), F.round(F.sum("gross"), 2).alias("total")))):
        rows = jsonl.checked(line, "lineage").select(F.size("violations").alias("broken"), F.lit(0).cast("long").alias("key"), "v")
        event = lineage_rows(rows).join(F.broadcast(rows.select(F.col("key").alias("ol_event_id"), "broken")), "ol_event_id")  # one row
        facet = lambda k: F.get_json_object("other_facets_json", f"$['job.{k}']")
        part = event.select("event_type", "job_name", facet("key").alias("column_set"), facet("value_type").alias("value_type"), (F.col("broken") == 0).alias("valid")).join(F.broadcast(total))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT 'customer' AS variable_name, count(*) AS n_rows, 5 AS n_columns, round((count(*) * 20 + sum(strlen(c_name)) + sum(strlen(c_mktsegment))) / 1048576.0, 6) AS memory_usage_mb FROM customer UNION ALL SELECT 'orders', count(*), 6, round((count(*) * 32 + sum(strlen(o_orderstatus)) + sum(strlen(o_orderpriority))) / 1048576.0, 6) FROM orders")
def frame_infos(spark, sf_dir):
    """Shapes of frames and estimates of their size."""
    parts = [tracked.frame_info(load(spark, sf_dir, n), n) for n in ("customer", "orders")]
    return parts[0].unionByName(parts[1]).select("variable_name", F.get("shape", F.lit(0)).alias("n_rows"), F.size("columns").alias("n_columns"), r6(F.col("memory_usage_mb")).alias("memory_usage_mb"))


_STATES = ("START", "COMPLETE", "ABORT", "FAIL")


@query("SELECT event_type, count(*) AS n, count(*) AS n_valid, CAST(sum(CASE WHEN event_type IN ('ABORT', 'FAIL') THEN 1 ELSE 0 END) AS BIGINT) AS n_errors, CAST(sum(CASE WHEN event_type IN ('COMPLETE', 'FAIL') THEN 1 ELSE 0 END) AS BIGINT) AS n_outputs, CAST(sum(CASE WHEN event_type <> 'START' THEN o_orderkey % 3000 ELSE 0 END) AS DOUBLE) AS spent_ms FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'START' WHEN 1 THEN 'COMPLETE' WHEN 2 THEN 'ABORT' ELSE 'FAIL' END AS event_type FROM orders) t GROUP BY event_type")
def run_events(spark, sf_dir):
    """Run events made for every order: begun, ended, aborted or failed, the last with the outputs made so far; checked and typed again."""
    orders = load(spark, sf_dir, "orders")
    data, place = [tracked.dataset(orders, "orders")], tracked.Place("0000000a", "cell_1", "0000000b")
    value, error = None, F.concat(F.lit("failed "), F.col("o_orderkey"))
    for n, state in enumerate(_STATES):
        event = tracked.run_event(state, F.md5(F.col("o_orderkey").cast("string")), "job", data, data if state in ("COMPLETE", "FAIL") else [], F.col("o_orderdate"), place, None if state == "START" else F.col("o_orderkey") % 3000, error, {"termination_reason": F.lit("interrupted")} if state == "ABORT" else None)
        value = F.when(F.col("o_orderkey") % 4 == n, event) if value is None else value.when(F.col("o_orderkey") % 4 == n, event)
    lines = jsonl.checked(orders.select(F.col("o_orderkey").alias("key"), value.alias("value")), "lineage")
    rows = lineage_rows(lines.select(F.struct("key", (F.size("violations") == 0).alias("ok")).alias("key"), "v"))
    failed = F.get_json_object("other_facets_json", "$['run.errorMessage'].message") == F.concat(F.lit("failed "), F.col("ol_event_id.key"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("ol_event_id.ok").alias("n_valid"), F.count_if(failed).alias("n_errors"), F.count("outputs_json").alias("n_outputs"), F.coalesce(F.sum("duration_ms"), F.lit(0.0)).alias("spent_ms"))


@query("WITH e AS (SELECT 'cell_execution_start' AS event_type, 0 AS ms, 1 + event_id % 3 AS n FROM events UNION ALL SELECT CASE WHEN event_type = 'error' THEN 'cell_execution_error' ELSE 'cell_execution_end' END, event_id % 500, 1 + event_id % 3 FROM events WHERE event_id % 10 <> 0) SELECT event_type, count(*) AS n, CAST(sum(ms) AS DOUBLE) AS spent_ms, CAST(sum(n) AS BIGINT) AS n_source_lines FROM e GROUP BY event_type")
def cell_events(spark, sf_dir):
    """Events of jobs that ran, emitted as a log, read again and checked; a tenth of the jobs still runs."""
    jobs = load(spark, sf_dir, "events").select(
        F.expr(hex8("event_id")).alias("execution_id"), F.expr("concat('cell_', user_id % 20)").alias("cell_id"), F.expr("concat('x', repeat('\\ny', cast(event_id % 3 as int)))").alias("source"), F.expr(hex8("user_id")).alias("session_id"), F.col("ts").cast("timestamp").alias("started"),
        F.expr("CASE WHEN event_id % 10 <> 0 THEN cast(ts as timestamp) + make_interval(0, 0, 0, 0, 0, 0, cast(event_id % 500 as decimal(9, 3)) / 1000) END").alias("ended"), F.lit(100.0).alias("start_memory_mb"), F.lit(101.0).alias("end_memory_mb"), F.expr("CASE WHEN event_type = 'error' THEN 'it broke' END").alias("error"),
    )
    path = f"{shared_dir(spark)}/emitted-{uuid.uuid4().hex}"
    jsonl.emit(executions.cell_events(jobs), path)
    lines = jsonl.checked(spark.read.text(path).withColumn("key", F.lit(0).cast("long")), "runtime")
    rows = jsonl.split(lines, "runtime", F.col("key"))[0]
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.coalesce(F.round(F.sum("duration_ms"), 3), F.lit(0.0)).alias("spent_ms"), F.sum("cell_source_lines").alias("n_source_lines"))


_DRAWN = "CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 10"


@query(f"SELECT 'customer' AS frame, false AS sampled, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer UNION ALL SELECT 'orders', true, count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders WHERE {_DRAWN}")
def sampled_frames(spark, sf_dir):
    """A frame above the size limit is sampled, the same rows each time; one below it is whole."""
    out = None
    for name, key, mb in (("customer", "c_custkey", 4.0), ("orders", "o_orderkey", 40.0)):
        part = tracked.sampled(load(spark, sf_dir, name), key, mb).groupBy("sampled").agg(F.count("*").alias("n"), F.sum(key).alias("keys")).select(F.lit(name).alias("frame"), "sampled", "n", "keys")
        out = part if out is None else out.unionByName(part)
    return out


# The guard's reports, and looks at tables

@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 3 <> 0 AND c_custkey * 7 - 500 > 0 THEN least(c_custkey * 7 - 500, 1000) END AS appended FROM customer")
def limit_rule(spark, sf_dir):
    """The limit that a query gets: none if it has its own or the asked one isn't positive, a thousand at most."""
    c = load(spark, sf_dir, "customer")
    asked = F.when(F.col("c_custkey") % 3 == 0, "SELECT a FROM runtime_events LIMIT 5").otherwise("SELECT a FROM runtime_events")
    return c.select(F.col("c_custkey").alias("k"), guard.limit_column(asked, F.col("c_custkey") * 7 - 500).alias("appended"))


@query("SELECT verdict = 'valid' AS valid, CASE WHEN verdict <> 'valid' THEN verdict END AS issue, CASE WHEN verdict <> 'valid' THEN 1 ELSE 0 END AS n_suggestions, CAST(count(*) AS BIGINT) AS n FROM customer, (VALUES " + ", ".join(f"('{v}')" for _, v in TEXTS) + ") t(verdict) GROUP BY verdict")
def syntax_reports(spark, sf_dir):
    """Reports on a log of query texts: whether valid, and if not, what is wrong and what to do."""
    texts = F.explode(F.array(*map(F.lit, (t for t, _ in TEXTS)))).alias("t")
    log = spread(load(spark, sf_dir, "customer")).select("c_custkey", texts).select(F.replace("t", F.lit("{}"), F.col("c_custkey").cast("string")).alias("sql"))
    report = log.select(guard.syntax_report(F.col("sql")).alias("r")).select("r.*")
    issue = F.get(F.split(F.get("issues", F.lit(0)), ":"), F.lit(0)).alias("issue")
    return report.groupBy("valid", issue, F.size("suggestions").alias("n_suggestions")).agg(F.count("*").alias("n"))


_RT_COLUMNS = "event_id bigint, event_type string, execution_id string, cell_id string, cell_source string, cell_source_lines int, start_memory_mb double, end_memory_mb double, duration_ms double, timestamp timestamp, session_id string, emitted_at timestamp, error_info string"
_IO_COLUMNS = "ol_event_id bigint, run_id string, execution_id string, event_type string, job_name string, event_time timestamp, session_id string, input_names array<string>, output_names array<string>, input_count int, output_count int"


def _described(table: str, columns: str, n: str, samples: str) -> str:
    rows = ", ".join(f"({i}, '{c.split()[0]}', '{c.split()[1]}')" for i, c in enumerate(columns.split(", "), 1))
    return f"SELECT '{table}' AS table_name, position, column_name, data_type, ({n}) AS n_rows, CASE WHEN position = 1 THEN ({samples}) END AS samples FROM (VALUES {rows}) t(position, column_name, data_type)"


@query(f"WITH {RT}, {LI} " + _described("runtime_events", _RT_COLUMNS, "SELECT count(*) FROM rt", "SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT CAST(event_id AS VARCHAR) AS k FROM rt ORDER BY event_id LIMIT 3) s") + " UNION ALL " + _described("vw_lineage_io", _IO_COLUMNS, "SELECT count(*) FROM li", "SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT CAST(k AS VARCHAR) AS x FROM li ORDER BY k LIMIT 3) s"))
def described_tables(spark, sf_dir):
    """Columns of a table and of a view: place, name, type, rows, and the first three values of the key. If one of them can't be read, there is no result."""
    found = guard.inspect_schema({"runtime_events": runtime(spark, sf_dir), "vw_lineage_io": io(spark, sf_dir)}, samples=3)
    failed = found.where("error is not null").select("table_name", "error").collect()  # a row a table
    if failed:
        raise RuntimeError("; ".join(f"{r.table_name} can't be read: {r.error}" for r in failed))
    return found.select("table_name", "position", "column_name", "data_type", "n_rows", F.when(F.col("position") == 1, F.array_join("samples", ",")).alias("samples"))
