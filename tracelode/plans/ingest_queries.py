"""Registered queries on reading, checking and storing of logs: nested rules, files and directories, re-processing, keys, rule changes."""

from __future__ import annotations

import time
import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.normalize import unique
from ..functions.rules import RUNTIME, Rule, number, text
from ..operators import executions, profile, sketches, views
from ..sources import catalogue, jsonl
from ..sources.corpus import LINES, hex8, iso, load, spread
from ..streaming.ingest import Counters, committed, compact, open_executions, process_now, quarantined, start_ingest, statistics
from .queries import _DEFECT, FR, LI, PM, RT, frames, lineage, query, r6, runtime, us
from .scratch import settled, shared_dir

#: Changes made to lines of DataFrame operations, by c_custkey % 8: (text, its replacement, the path and the rule that then break).
FRAME_CHANGES = (
    (r'"shape":\[(\d+),3\]', '"shape":[$1,3,1]', "$.input_dataframes[].shape", "length"), (r'"shape":\[(\d+),3\]', '"shape":[$1,"3"]', "$.input_dataframes[].shape[]", "type"), (r'"out(\d+)\.value":', '"out$1":', "$.column_lineage.column_mapping", "key"),
    ('"operation_parameters":\\{', '"operation_parameters":{"on":3,', "$.operation_parameters.on", "type"), ('"sampled":(true|false)', '"sampled":"$1"', "$.performance.sampled", "type"), (r'"variable_name":"df(\d+)",', "", "$.input_dataframes[].variable_name", "required"), ('"variable_name":"df', '"other":1,"variable_name":"df', "$.input_dataframes[]", "additional"),
)
#: The same for lineage events, by o_orderkey % 6.
RUN_CHANGES = (
    (r'"durationMs":(\d+)', '"durationMs":-1', "$.run.facets.performance.durationMs", "minimum"), ('"name":"c_custkey","type":"long"', '"name":"c_custkey","type":7', "$.inputs[].facets.schema.fields[].type", "type"), ('"job":\\{', '"job":{"x":1,', "$.job", "additional"),
    (r'"name":"customer_(\d+)",', "", "$.inputs[].name", "required"), (r'"runId":"[^"]*",', "", "$.run.runId", "required"),
)


def _changed(lines, changes):
    value = F.col("value")
    for k, (found, put, *_) in enumerate(changes, 1):
        value = F.when(F.col("key") % (len(changes) + 1) == k, F.regexp_replace("value", found, put)).otherwise(value)
    return lines.withColumn("value", value)


def _expected(key: str, table: str, kind: str, changes) -> str:
    return " UNION ALL ".join(f"SELECT '{kind}' AS kind, '{path}' AS path, '{rule}' AS rule FROM {table} WHERE {key} % {len(changes) + 1} = {k}" for k, (_, _, path, rule) in enumerate(changes, 1))


@query(
    f"SELECT kind, path, rule, count(*) AS n FROM ({_expected('c_custkey', 'customer', 'dataframe_lineage', FRAME_CHANGES)} UNION ALL SELECT 'dataframe_lineage', '$.operation_method', 'enum' FROM customer WHERE c_custkey % 53 = 0 UNION ALL {_expected('o_orderkey', 'orders', 'lineage', RUN_CHANGES)}"
    " UNION ALL SELECT 'lineage', '$.outputs[].facets.columnLineage.fields.*.inputFields[].name', 'required' FROM orders WHERE o_orderkey % 6 = 4 AND o_orderkey % 11 <> 0 UNION ALL SELECT 'lineage', '$.producer', 'enum' FROM orders WHERE o_orderkey % 61 = 0) t GROUP BY kind, path, rule"
)
def nested_rules(spark, sf_dir):
    """Events with defects inside lists, maps and nested objects: every broken rule, each once an event."""
    out = None
    for kind, changes in (("dataframe_lineage", FRAME_CHANGES), ("lineage", RUN_CHANGES)):
        found = jsonl.checked(_changed(LINES[kind](spark, sf_dir), changes), kind)
        part = found.select(F.lit(kind).alias("kind"), F.inline("violations")).groupBy("kind", "path", "rule").agg(F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"SELECT 'lenient' AS mode, count(*) FILTER (event_id % 97 <> 0) AS valid, count(*) FILTER (event_id % 97 = 0) AS invalid FROM events UNION ALL SELECT 'strict', count(*) FILTER (({_DEFECT}) = 0), count(*) FILTER (({_DEFECT}) <> 0) FROM events")
def strict_and_lenient(spark, sf_dir):
    """Without strict rules an event has only to be JSON."""
    lines = LINES["runtime"](spark, sf_dir)
    parts = [profile.compliance(jsonl.checked(lines, "runtime", strict=s)).select(F.lit("strict" if s else "lenient").alias("mode"), "valid", "invalid") for s in (True, False)]
    return parts[0].unionByName(parts[1])


_UUID = "substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) || '-' || substr(md5(CAST(o_orderkey AS VARCHAR)), 9, 4) || '-' || substr(md5(CAST(o_orderkey AS VARCHAR)), 13, 4) || '-' || substr(md5(CAST(o_orderkey AS VARCHAR)), 17, 4) || '-' || substr(md5(CAST(o_orderkey AS VARCHAR)), 21, 12)"


@query(f"SELECT o_orderkey AS k, {_UUID} AS run_id, format('{{:08x}}', o_orderkey % 4096) AS execution_id, 'COMPLETE' AS event_type, 'job_' || (o_custkey % 9) AS job_name, epoch_us(o_orderdate) AS us, CAST(o_orderkey % 3000 AS DOUBLE) AS duration_ms, 's' || (o_custkey % 7) AS session_id FROM orders WHERE o_orderkey % 5 <> 0")
def flat_lineage(spark, sf_dir):
    """Lineage events without run and job objects, with flat names in their place; a fifth has an id that is no UUID and is dropped."""
    o = spread(load(spark, sf_dir, "orders")).withColumn("m", F.expr("md5(cast(o_orderkey as string))"))
    body = F.struct(
        F.expr("CASE WHEN o_orderkey % 5 = 0 THEN 'none' ELSE concat_ws('-', substring(m, 1, 8), substring(m, 9, 4), substring(m, 13, 4), substring(m, 17, 4), substring(m, 21, 12)) END").alias("run_id"), F.expr(hex8("o_orderkey % 4096")).alias("execution_id"), F.lit("COMPLETE").alias("eventType"),
        F.expr("concat('job_', o_custkey % 9)").alias("job_name"), F.expr(iso("o_orderdate")).alias("eventTime"), F.expr("o_orderkey % 3000").alias("duration_ms"), F.expr("concat('s', o_custkey % 7)").alias("session_id"), F.expr(iso("o_orderdate")).alias("emitted_at"),
    )
    lines = jsonl.checked(o.select(F.col("o_orderkey").alias("key"), F.to_json(body).alias("value")), "lineage", strict=False)
    rows = jsonl.split(lines, "lineage", F.col("key"))[0]
    return rows.select(F.col("ol_event_id").alias("k"), "run_id", "execution_id", "event_type", "job_name", us("event_time").alias("us"), "duration_ms", "session_id")


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS excerpt FROM documents")
def text_excerpts(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", scalars.excerpt(F.col("text")).alias("excerpt"))


_PROCESSED = "CAST(count(*) FILTER ({ok}) AS BIGINT) AS processed, CAST(count(*) FILTER (NOT ({ok})) AS BIGINT) AS failed, count(*) AS total, round(CAST(count(*) FILTER ({ok}) AS DOUBLE) / count(*), 6) AS success_rate"


@query(f"SELECT 'runtime' AS kind, {_PROCESSED.format(ok=f'({_DEFECT}) = 0')} FROM events UNION ALL SELECT 'lineage', {_PROCESSED.format(ok='o_orderkey % 61 <> 0 AND o_orderkey % 67 <> 0')} FROM orders UNION ALL SELECT 'dataframe_lineage', {_PROCESSED.format(ok='c_custkey % 53 <> 0 AND c_custkey % 59 <> 0 AND c_custkey % 47 <> 0')} FROM customer")
def processing_summary(spark, sf_dir):
    """By kind: lines read, and rows that came into the table."""
    out = None
    for kind, table in (("runtime", runtime), ("lineage", lineage), ("dataframe_lineage", frames)):
        part = profile.processing_summary(LINES[kind](spark, sf_dir), table(spark, sf_dir)).select(F.lit(kind).alias("kind"), "processed", "failed", "total", r6(F.col("success_rate")).alias("success_rate"))
        out = part if out is None else out.unionByName(part)
    return out


_HASH = "substr(sha256('/nb/' || ({k} % 4) || '.py'), 1, 8)"


@query(f"WITH {RT}, {LI}, {FR}, every AS (SELECT 'runtime_events' AS table_name, {_HASH.format(k='event_id')} AS notebook_hash, event_id AS k FROM rt UNION ALL SELECT 'lineage_events', {_HASH.format(k='k')}, k FROM li UNION ALL SELECT 'dataframe_lineage_events', {_HASH.format(k='k')}, k FROM fr) SELECT table_name, notebook_hash, count(*) AS n, CAST(sum(k) AS BIGINT) AS keys FROM every WHERE notebook_hash IN (substr(sha256('/nb/1.py'), 1, 8), substr(sha256('/nb/3.py'), 1, 8)) GROUP BY table_name, notebook_hash")
def stored_by_notebook(spark, sf_dir):
    """The three tables appended to their stores in two goes, and two notebooks of four read back: the other notebooks' files aren't opened."""
    out = None
    for name, df in (("runtime_events", runtime(spark, sf_dir)), ("lineage_events", lineage(spark, sf_dir)), ("dataframe_lineage_events", frames(spark, sf_dir))):
        path, key = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}/{name}", df.columns[0]
        rows = df.withColumn("notebook_hash", scalars.notebook_hash(F.concat(F.lit("/nb/"), F.col(key) % 4, F.lit(".py"))))
        for half in (0, 1):
            catalogue.append(rows.where(F.col(key) % 3 == 0 if half else F.col(key) % 3 != 0), path)
        for notebook in ("/nb/1.py", "/nb/3.py"):
            mine = catalogue.stored(spark, name, path, jsonl.hash_of(spark, notebook))
            part = mine.groupBy("notebook_hash").agg(F.count("*").alias("n"), F.sum(key).alias("keys")).select(F.lit(name).alias("table_name"), "notebook_hash", "n", "keys")
            out = part if out is None else out.unionByName(part)
    return out


@query("SELECT 'all' AS scope, 'runtime' AS kind, substr(sha256('/nb/' || (event_id % 2) || '.py'), 1, 8) AS notebook_hash, count(*) AS n FROM events GROUP BY event_id % 2 UNION ALL SELECT 'all', 'dataframe_lineage', substr(sha256('/nb/1.py'), 1, 8), count(*) FROM customer UNION ALL SELECT 'one', 'runtime', substr(sha256('/nb/1.py'), 1, 8), count(*) FROM events WHERE event_id % 2 = 1 UNION ALL SELECT 'one', 'dataframe_lineage', substr(sha256('/nb/1.py'), 1, 8), count(*) FROM customer UNION ALL SELECT 'unrouted', 'other', '', count(*) FROM customer")
def landed_logs(spark, sf_dir):
    """Files of two notebooks in directories of two kinds, and one of no kind: all read, one notebook's read, and what isn't read counted."""
    root = f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    lines = LINES["runtime"](spark, sf_dir)
    for n in (0, 1):
        jsonl.land(lines.where(f"key % 2 = {n}"), root, "runtime", f"/nb/{n}.py")
    jsonl.land(LINES["dataframe_lineage"](spark, sf_dir), root, "dataframe_lineage", "/nb/1.py")
    jsonl.land(LINES["dataframe_lineage"](spark, sf_dir), root, "other", "/nb/1.py")
    count = lambda df, scope: df.groupBy("kind", "notebook_hash").agg(F.count("*").alias("n")).select(F.lit(scope).alias("scope"), "kind", "notebook_hash", "n")
    left = jsonl.unrouted(spark, root).select(F.lit("unrouted").alias("scope"), F.col("directory").alias("kind"), F.lit("").alias("notebook_hash"), F.col("n_lines").alias("n"))
    return count(jsonl.scan(spark, root), "all").unionByName(count(jsonl.scan(spark, root, "/nb/1.py"), "one")).unionByName(left)


@query(f"WITH {RT} SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_rows FROM rt GROUP BY event_type")
def reprocessed_files(spark, sf_dir):
    """One notebook's files processed at once, then again together with another's: nothing comes twice."""
    root = f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    lines = LINES["runtime"](spark, sf_dir)
    for n in (0, 1):
        jsonl.land(lines.where(f"key % 2 = {n}"), root, "runtime", f"/nb/{n}.py")
    first = f"{root}/runtime/{jsonl.hash_of(spark, '/nb/0.py')}_*.jsonl"
    for files in ([first], [f"{root}/runtime/*.jsonl"]):
        process_now(spark, "runtime", files, f"{root}/table", f"{root}/bad")
    return committed(spark, "runtime", f"{root}/table").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("n_rows"))


@query(f"WITH {RT} SELECT 'kept' AS part, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS keys, CAST(sum(us % 1000003) AS BIGINT) AS times FROM rt UNION ALL SELECT 'repeated', count(*), CAST(sum(event_id) AS BIGINT), CAST(sum((us + 1) % 1000003) AS BIGINT) FROM rt WHERE event_id % 5 = 0 OR event_id % 7 = 0")
def unique_keys(spark, sf_dir):
    """Rows whose key is there already, with a later time, are told apart from the first."""
    rows = runtime(spark, sf_dir).select("event_id", us("timestamp").alias("at"))
    kept, repeated = unique(rows.unionByName(rows.where("event_id % 5 = 0 OR event_id % 7 = 0").withColumn("at", F.col("at") + 1)), "event_id", "at")
    total = lambda df, name: df.agg(F.count("*").alias("n"), F.sum("event_id").alias("keys"), F.sum(F.col("at") % 1000003).alias("times")).select(F.lit(name).alias("part"), "n", "keys", "times")
    return total(kept, "kept").unionByName(total(repeated, "repeated"))


#: A later version of the runtime rules that breaks with old events: no errors, more memory from the start, sources counted as texts.
NARROWER = replace(RUNTIME, required={**RUNTIME.required, "event_type": text(among=("cell_execution_start", "cell_execution_end")), "start_memory_mb": number(110), "cell_source_lines": Rule(("string",))})


@query(f"WITH {RT} SELECT '$.event_type' AS path, 'enum' AS rule, count(*) AS n FROM rt WHERE event_type = 'cell_execution_error' UNION ALL SELECT '$.start_memory_mb', 'minimum', count(*) FROM rt WHERE start_memory_mb < 110 UNION ALL SELECT '$.cell_source_lines', 'type', count(*) FROM rt")
def rule_compatibility(spark, sf_dir):
    """Stored events replayed through a narrower version of their rules: what it refuses of what was valid."""
    found = catalogue.no_longer_valid(LINES["runtime"](spark, sf_dir), RUNTIME, NARROWER)
    return found.groupBy("path", "rule").agg(F.count("*").alias("n"))


@query(f"WITH {RT} SELECT session_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS event_types, count(DISTINCT execution_id) AS n_executions FROM rt GROUP BY session_id")
def distinct_sets(spark, sf_dir):
    found = profile.distinct_sets(runtime(spark, sf_dir), "session_id", "event_type", "execution_id")
    return found.select("session_id", F.array_join("event_type", ",").alias("event_types"), F.col("n_execution_id").alias("n_executions"))


@query(f"WITH {RT} SELECT execution_id, min(us) FILTER (event_type = 'cell_execution_start') AS started_us, max(us) FILTER (event_type <> 'cell_execution_start') AS ended_us FROM rt GROUP BY execution_id HAVING count(*) FILTER (event_type = 'cell_execution_start') > 0 AND count(*) FILTER (event_type <> 'cell_execution_start') > 0")
def open_execution_stream(spark, sf_dir):
    """Events as a stream, with state for each execution under way: those that closed."""
    root = f"{shared_dir(spark)}/open-{uuid.uuid4().hex}"
    rows = runtime(spark, sf_dir).select("execution_id", "event_type", F.col("timestamp").alias("emitted_at"))
    rows.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
    open_executions(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{root}/check").option("path", f"{root}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").where("state = 'closed'").select("execution_id", us("started").alias("started_us"), us("ended").alias("ended_us"))


def _three_states(us):
    """SQL for closed, open and unmatched executions, by what comes first of each side."""
    return f"SELECT coalesce(s.execution_id, e.execution_id) AS execution_id, CASE WHEN e.execution_id IS NULL THEN 'open' WHEN s.execution_id IS NULL THEN 'unmatched' ELSE 'closed' END AS state, s.us AS started_us, e.us AS ended_us FROM (SELECT execution_id, {us} AS us FROM rt WHERE event_type = 'cell_execution_start') s FULL JOIN (SELECT execution_id, {us} AS us FROM rt WHERE event_type <> 'cell_execution_start') e ON s.execution_id = e.execution_id"


@query(f"WITH {RT} {_three_states('us')}")
def execution_states_stream(spark, sf_dir):
    """All executions as a stream over several batches: closed, still open and ended without a start. A beat two days after the last event moves the watermark past them all."""
    root = f"{shared_dir(spark)}/states-{uuid.uuid4().hex}"
    rows = runtime(spark, sf_dir).select("execution_id", "event_type", F.col("timestamp").alias("emitted_at"))
    first, last = rows.agg(F.min("emitted_at"), F.max("emitted_at")).first()
    beat = rows.agg((F.max("emitted_at") + F.expr("INTERVAL 2 DAYS")).alias("emitted_at")).select(F.lit("beat").alias("execution_id"), F.lit("cell_execution_start").alias("event_type"), "emitted_at")
    quarter = lambda k: F.lit(first) + (F.lit(last) - F.lit(first)) * (k / 4)
    parts = [rows.where((F.col("emitted_at") >= quarter(k)) & ((F.col("emitted_at") < quarter(k + 1)) | F.lit(k == 3))) for k in range(4)]
    for part in (*parts, beat):  # files come in the order of their events
        part.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
        open_executions(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{root}/check").option("path", f"{root}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").select("execution_id", "state", us("started").alias("started_us"), us("ended").alias("ended_us"))


@query(f"WITH {RT}, n AS (SELECT count(*) AS n_lines, count(*) FILTER (({_DEFECT}) = 0) AS processed FROM events) SELECT 'table' AS part, n_lines, processed, n_lines - processed AS failed, (SELECT count(*) FROM rt) AS n_rows FROM n UNION ALL SELECT 'after', n_lines, processed, n_lines - processed, (SELECT count(*) FROM rt) FROM n")
def committed_ingest(spark, sf_dir):
    """A stream and a second look at the same files, both at once, then one more look and all commits made one: each line has one row or one place in the quarantine, and one count."""
    root = f"{shared_dir(spark)}/commits-{uuid.uuid4().hex}"
    lines = LINES["runtime"](spark, sf_dir)
    for n in (0, 1):
        jsonl.land(lines.where(f"key % 2 = {n}"), root, "runtime", f"/nb/{n}.py")
    table, bad, files = f"{root}/table", f"{root}/bad", [f"{root}/runtime/*.jsonl"]

    def counts(part):
        seen = statistics(spark, table, bad).agg(*(F.sum(c).alias(c) for c in ("n_lines", "processed")))
        failed = quarantined(spark, table, bad).agg(F.count("*").alias("failed"))
        rows = committed(spark, "runtime", table).agg(F.count_distinct("row_id").alias("ids"), F.count("*").alias("n_rows")).where("ids = n_rows").drop("ids")
        return settled(seen.join(F.broadcast(failed)).join(F.broadcast(rows)).select(F.lit(part).alias("part"), "*"), "counts")  # a row each

    stream = start_ingest(spark, "runtime", root, table, bad, f"{root}/check", files_a_batch=3)
    process_now(spark, "runtime", files, table, bad)
    stream.awaitTermination()
    first = counts("table")
    process_now(spark, "runtime", files, table, bad)
    compact(spark, "runtime", table, bad)
    return first.unionByName(counts("after"))


@query(f"SELECT 'runtime' AS kind, 7 AS files, count(*) AS n_lines, count(*) FILTER (({_DEFECT}) = 0) AS processed, count(*) FILTER (({_DEFECT}) <> 0) AS failed FROM events UNION ALL SELECT 'lineage', 5, count(*), count(*) FILTER (o_orderkey % 61 <> 0), count(*) FILTER (o_orderkey % 61 = 0) FROM orders")
def live_counters(spark, sf_dir):
    """What a listener has counted of two streams of several batches when they end."""
    root, counters = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}", Counters()
    spark.streams.addListener(counters)
    try:
        for kind, n in (("runtime", 7), ("lineage", 5)):
            LINES[kind](spark, sf_dir).select("value").repartition(n).write.text(f"{root}/in/{kind}")
            start_ingest(spark, kind, f"{root}/in", f"{root}/{kind}", f"{root}/bad-{kind}", f"{root}/check-{kind}", glob="*.txt", files_a_batch=2).awaitTermination()
        want = {k: spark.read.text(f"{root}/in/{k}").count() for k in ("runtime", "lineage")}
        for _ in range(100):  # events reach a listener a moment after their batch
            told = counters.table(spark)
            if {r["kind"]: r["n_lines"] for r in told.collect()} == want:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(counters)
    return told.select("kind", "files", "n_lines", "processed", "failed")


@query(f"WITH {PM} SELECT session_id, count(*) AS n, count(k) AS n_joined, CAST(sum(k) AS BIGINT) AS keys, TRUE AS has_bytes FROM pm GROUP BY session_id")
def stored_catalogue(spark, sf_dir):
    """W2 over tables of the session's catalogue that lie in buckets of execution_id, created twice and filled in two goes."""
    database, folder = f"telemetry_{uuid.uuid4().hex[:8]}", f"{shared_dir(spark)}/catalogue-{uuid.uuid4().hex}"
    for half in (0, 1):
        catalogue.create(spark, database, folder)
        for name, rows in (("runtime_events", runtime(spark, sf_dir)), ("lineage_events", lineage(spark, sf_dir)), ("dataframe_lineage_events", frames(spark, sf_dir))):
            catalogue.fill(spark, database, name, rows.where(F.col(rows.columns[0]) % 2 == half))
    r, l, _ = catalogue.tables(spark, database)
    bytes_told = catalogue.sizes(spark, database).agg((F.min("n_bytes") > 0).alias("has_bytes"))
    out = views.performance_metrics(r, l).groupBy("session_id").agg(F.count("*").alias("n"), F.count("ol_event_id").alias("n_joined"), F.sum("ol_event_id").alias("keys"))
    return out.join(F.broadcast(bytes_told))  # one row


_PROFILED = ("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS null_count, CAST(min({c}) AS VARCHAR) AS least, CAST(max({c}) AS VARCHAR) AS most, TRUE AS distinct_near, TRUE AS median_near FROM orders" for c in _PROFILED))
def incremental_profile(spark, sf_dir):
    """Orders in two lots of files: the second refresh reads the second lot only; distinct values within 2.4 percent, the median's rank within 1.33 percent of exact ones."""
    root, o = f"{shared_dir(spark)}/profile-{uuid.uuid4().hex}", load(spark, sf_dir, "orders")
    for lot in (0, 1):
        o.where(f"o_orderkey % 2 = {lot}").write.mode("append").parquet(f"{root}/orders")
        sketches.refresh(spark, f"{root}/orders", f"{root}/sketches", list(_PROFILED))
    if sketches.refresh(spark, f"{root}/orders", f"{root}/sketches", list(_PROFILED)):
        raise AssertionError("files were read again")
    told = settled(sketches.profile(spark, f"{root}/sketches", f"{root}/orders"), "profile")
    middle = {r["column"]: r["q50"] for r in told.collect()}  # a row a column
    exact = o.agg(F.array(*(F.struct(F.lit(c).alias("column"), F.countDistinct(c).alias("exact"), (F.lit(0.5) if middle[c] is None else F.count_if(F.col(c) <= middle[c]) / F.count(c)).alias("rank")) for c in _PROFILED)).alias("x")).select(F.inline("x"))
    near = (F.abs(F.col("distinct_count") - F.col("exact")) <= 0.024 * F.col("exact") + 0.5).alias("distinct_near")
    return told.join(F.broadcast(exact), "column").select("column", "n", "null_count", "least", "most", near, (F.abs(F.col("rank") - 0.5) <= 0.0133 + 1 / F.col("n")).alias("median_near"))


@query(f"WITH {RT}, {FR}, r AS (SELECT session_id, count(DISTINCT execution_id) AS n_executions, count(*) FILTER (event_type = 'cell_execution_error') AS n_failed FROM rt GROUP BY session_id), o AS (SELECT session_id, count(*) AS n_operations FROM fr GROUP BY session_id), v AS (SELECT session_id, count(DISTINCT f) AS n_frames FROM (SELECT session_id, input_name AS f FROM fr UNION SELECT session_id, output_name FROM fr) t GROUP BY session_id) SELECT coalesce(r.session_id, o.session_id) AS session_id, coalesce(n_executions, 0) AS n_executions, coalesce(n_failed, 0) AS n_failed, coalesce(n_operations, 0) AS n_operations, coalesce(n_frames, 0) AS n_frames FROM r FULL JOIN o ON r.session_id = o.session_id LEFT JOIN v ON v.session_id = o.session_id")
def session_summary(spark, sf_dir):
    return executions.session_summary(runtime(spark, sf_dir), frames(spark, sf_dir))
