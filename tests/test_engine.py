import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tests.compare import spark_rows, sql_rows
from tracelode.functions import rules
from tracelode.functions.normalize import unique
from tracelode.functions.rules import PRODUCER, plainly_valid, typed, violations
from tracelode.functions.scalars import excerpt, line_count, notebook_name, parse_time
from tracelode.operators import executions, graph, guard, profile, tracked
from tracelode.plans.registry import QUERIES, SQL
from tracelode.sources import catalogue
from tracelode.sources.jsonl import checked
from tracelode.streaming.ingest import open_executions

SF = "/root/testdata/sf0.001"
RUNTIME = {"event_type": "cell_execution_start", "execution_id": "abcdef01", "cell_id": "c", "cell_source": "x", "cell_source_lines": 1, "start_memory_mb": 1.5, "timestamp": "2024-01-01T00:00:00Z", "session_id": "abcdef02", "emitted_at": "1700000000"}
RUN = {"eventType": "COMPLETE", "eventTime": "t", "run": {"runId": "r"}, "job": {"namespace": "n", "name": "j"}, "inputs": [{"namespace": "n", "name": "d"}], "outputs": [], "producer": PRODUCER, "schemaURL": "u", "session_id": "s", "emitted_at": "t"}


@pytest.mark.parametrize("name", ["validate_runtime", "validate_frames", "runtime_events", "vw_dataframe_lineage", "q6_session_overview", "paired_executions", "upstream_closure", "cycles", "tracked_events", "query_log_audit", "streamed_ingest", "scanned_logs", "vw_lineage_io", "vw_performance_metrics", "q1_recent_events", "q3_slow_executions", "q4_errors", "schema_changes", "schema_retypes", "column_profile", "compliance_errors", "table_samples", "catalogue_sql", "ingest_statistics",
    "nested_rules", "strict_and_lenient", "flat_lineage", "text_excerpts", "processing_summary", "stored_by_notebook", "landed_logs", "reprocessed_files", "unique_keys", "rule_compatibility", "distinct_sets", "open_execution_stream",
    "operation_types", "tracked_parameters", "tracked_sources", "frame_infos", "run_events", "cell_events", "sampled_frames", "limit_rule", "syntax_reports", "described_tables",
])
def test_query_matches_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == sql_rows(SF, SQL[name])


def _broken(spark, kind, events):
    lines = spark.createDataFrame([(i, e if isinstance(e, str) else json.dumps(e)) for i, e in enumerate(events)], "key int, value string")
    return [[(v.path, v.rule) for v in r.violations] for r in checked(lines, kind).orderBy("key").collect()]


def test_runtime_rules(spark):
    got = _broken(spark, "runtime", [RUNTIME, "{", "[1]", RUNTIME | {"x": 1}, {k: v for k, v in RUNTIME.items() if k != "cell_id"}, RUNTIME | {"cell_source_lines": 0}, RUNTIME | {"cell_source_lines": 1.0}, RUNTIME | {"cell_source_lines": "1"}, RUNTIME | {"session_id": "ABCDEF01"}, RUNTIME | {"error_info": {"error_type": 3}}])
    assert got[0] == got[6] == []
    assert got[1] == [("$", "json")] and ("$", "type") in got[2]
    assert got[3] == [("$", "additional")] and got[4] == [("$.cell_id", "required")] and got[5] == [("$.cell_source_lines", "minimum")]
    assert got[7] == [("$.cell_source_lines", "type")] and got[8] == [("$.session_id", "pattern")] and got[9] == [("$.error_info.error_type", "type")]


def test_lineage_rules_reach_into_lists_and_maps(spark):
    facet = {"_producer": PRODUCER, "_schemaURL": "u"}
    bad = RUN | {"outputs": [{"namespace": "n", "name": "d", "facets": {"schema": facet | {"fields": [{"name": 1, "type": "t"}]}}}]}
    worse = RUN | {"inputs": [{"namespace": "n", "name": "d", "facets": {"columnMetrics": facet | {"columnMetrics": {"c": {"nullCount": "x"}}}}}, {"name": "e"}]}
    got = _broken(spark, "lineage", [RUN, bad, worse, RUN | {"run": {"runId": "r", "y": 1}}])
    assert got[0] == [] and got[1] == [("$.outputs[].facets.schema.fields[].name", "type")]
    assert set(got[2]) == {("$.inputs[].facets.columnMetrics.columnMetrics.*.nullCount", "type"), ("$.inputs[].namespace", "required")}
    assert got[3] == [("$.run", "additional")]


def _mutations(value):
    """An event with one value changed, taken away or added, for each place in it."""
    for other in (None, 1, -1.5, "x", [], {}, True, [None]):
        yield other
    if isinstance(value, dict):
        yield value | {"other": 1}
        for k, v in value.items():
            yield {n: w for n, w in value.items() if n != k}
            yield from (value | {k: m} for m in _mutations(v))
    if isinstance(value, list):
        yield value + value
        for i, v in enumerate(value):
            yield from (value[:i] + [m] + value[i + 1 :] for m in _mutations(v))


def test_first_look_lets_nothing_pass(spark):
    """Whatever is valid at first sight breaks no rule; and an event that breaks none is mostly valid at first sight."""
    made = {"_producer": PRODUCER, "_schemaURL": "u"}
    facets = {"schema": made | {"fields": [{"name": "a", "type": "t"}]}, "columnMetrics": made | {"columnMetrics": {"a": {"nullCount": None, "min": 1.5}}}, "columnLineage": made | {"fields": {"a": {"inputFields": [{"namespace": "n", "name": "d", "field": "f"}]}}}, "dataQualityMetrics": {"x": [1]}}
    frame = {"variable_name": "v", "shape": [1, 2], "columns": ["a"], "memory_usage_mb": 0.5}
    whole = {
        "runtime": RUNTIME | {"end_memory_mb": 1, "duration_ms": 2.25, "error_info": {"error_type": "é\"/\n"}},
        "lineage": RUN | {"inputs": [{"namespace": "n", "name": "d", "facets": facets}], "run": {"runId": "r", "facets": {"performance": {"_producer": "p", "durationMs": 7}}}},
        "dataframe_lineage": {"event_type": "dataframe_lineage", "execution_id": "abcdef01", "cell_id": "c", "session_id": "abcdef02", "timestamp": "t", "emitted_at": "t", "operation_type": "join", "operation_method": "merge", "operation_code": "x", "input_dataframes": [frame], "output_dataframes": [frame], "operation_parameters": {"on": ["a"]}, "column_lineage": {"column_mapping": {"a.b": ["c.d"]}, "input_columns": [], "output_columns": ["b"], "operation_method": "merge", "lineage_type": "join"}, "performance": {"sampled": False, "overhead_ms": 1e-3}},
    }
    for kind, event in whole.items():
        lines = spark.createDataFrame([(json.dumps(e),) for e in (event, *_mutations(event))], "value string").select(F.try_parse_json("value").alias("v"))
        rows = lines.select(F.to_json("v").alias("c"), "v").withColumn("t", typed(F.col("c"), kind)).select(plainly_valid("c", "t", kind).alias("plain"), violations("v", kind).alias("broken"), "c").collect()
        assert rows[0].plain and not rows[0].broken, kind
        assert [r.c for r in rows if r.plain and r.broken] == []
        assert sum(r.plain for r in rows) > 3 and sum(bool(r.broken) for r in rows) > 30


def test_scalars(spark):
    rows = spark.createDataFrame([("2024-01-01T12:00:00Z", "a\nb", "/x/my nb.py"), ("0.5", "", "b-1.ipynb"), ("2024-01-01", "x", "é.py"), (None, None, None)], "t string, s string, p string")
    got = rows.select(F.unix_micros(parse_time(F.col("t"))), line_count(F.col("s")), notebook_name(F.col("p")), excerpt(F.lit("z" * 101))).collect()
    assert [r[0] for r in got] == [1704110400000000, 500000, None, None] and [r[1] for r in got][:3] == [2, 0, 1]
    assert [r[2] for r in got][:3] == ["my_nb", "b-1", "é"] and got[0][3] == "z" * 100 + "..."


def test_closure_ends_in_cycles_and_on_nothing(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "source string, target string")
    got = {(r.seed, r.node): r.depth for r in graph.closure(e, e.select(F.col("source").alias("node"))).collect()}
    assert got["a", "a"] == 3 and got["a", "d"] == 3 and len(got) == 12
    assert graph.closure(e.limit(0), e.select(F.col("source").alias("node"))).count() == 0
    assert {r.node for r in graph.in_cycles(e).collect()} == {"a", "b", "c"}


def test_closure_has_no_depth_of_its_own(spark):
    e = spark.range(1300).selectExpr("id AS source", "id + 1 AS target")
    seed = spark.createDataFrame([(0,)], "node long")
    got = {r.node: r.depth for r in graph.closure(e, seed).collect()}
    assert got == {i: i for i in range(1, 1301)}
    assert sorted(r.node for r in graph.closure(e, seed, 5).collect()) == [1, 2, 3, 4, 5]
    assert graph.impact(e, seed).first()[1:] == (1300, 1300)


def test_guard(spark):
    spark.range(5).createOrReplaceTempView("runtime_events")
    assert guard.guarded_sql(spark, "SELECT * FROM runtime_events", limit=2).count() == 2
    with pytest.raises(ValueError, match="forbidden_operation"):
        guard.guarded_sql(spark, "SELECT * FROM runtime_events WHERE SET = 1")
    assert guard.limit_of("select 1 limit 5", 9) is None and guard.limit_of("select 1", 5000) == 1000 and guard.limit_of("select 1", 0) is None


@pytest.mark.parametrize("text", [
    "SELECT * FROM `secrets`", "SELECT * FROM runtime_events, secrets", "SELECT * FROM(secrets)", "SELECT * FROM runtime_events r, `parquet`.`/etc/x`", "SELECT * FROM parquet.`/etc/x`", 'SELECT * FROM "secrets"',
    "SELECT * FROM (SELECT 1 FROM runtime_events) t, secrets", "SELECT * FROM (runtime_events JOIN secrets)", "SELECT 1 FROM runtime_events UNION TABLE secrets", "SELECT ')' , * FROM runtime_events\n,\n secrets",
    'SELECT "(" , * FROM secrets WHERE x = ")"', "SELECT 1 WHERE r'\\' = '' AND EXISTS (SELECT 1 FROM secrets WHERE '' = '')", "SELECT (SELECT max(a) FROM secrets)", "SELECT * FROM range(3)", "SELECT * FROM runtime_events JOIN other.vw_lineage_io", "SELECT * FROM runtime_events LATERAL JOIN secrets",
])
def test_guard_reads_every_table(spark, text):
    assert spark.range(1).select(guard.audit(F.lit(text))["verdict"]).first()[0] in ("unauthorized_table", "dangerous_pattern")
    with pytest.raises(ValueError):
        guard.guarded_sql(spark, text)


def test_guard_lets_the_catalogue_pass(spark):
    for text in ("SELECT a, count(*) FROM runtime_events r, vw_lineage_io v WHERE r.x IN (1, 2) GROUP BY a", "select * from `runtime_events` t join (select max(y) y from lineage_events where z = 'from secrets') q on t.y = q.y", "SELECT 1", "SELECT * FROM runtime_events WHERE cell_id = 'it''s (a' AND n = \"b)\""):
        assert spark.range(1).select(guard.audit(F.lit(text))["verdict"]).first()[0] == "valid", text
    report = spark.range(1).select(guard.syntax_report(F.lit("DROP x")).alias("r")).first().r
    assert not report.valid and report.issues == ["not_select"] and report.suggestions == ["Start with SELECT."]
    with pytest.raises(ValueError, match="forbidden_operation"):
        guard.guarded_sql(spark, "SELECT reflect('java.lang.System', 'exit')")


def test_observed_rows(spark):
    t = tracked.track_filter(spark.range(10).toDF("x"), "x > 6", observe=True)
    assert t.result.count() == 3 and t.observation.get["rows"] == 3
    assert tracked.column_mapping([("d", ["a", "b"])], ["a", "s"], "o") == {"o.a": ["d.a"], "o.s": ["d.a", "d.b"]}
    assert tracked.column_mapping([("l", ["k", "l"]), ("r", ["k", "r"])], ["k", "l", "r"], "o") == {"o.k": ["l.k", "r.k"], "o.l": ["l.l"], "o.r": ["r.r"]}


def test_tracked_events_keep_the_rules(spark):
    a, b = spark.createDataFrame([(1, 2)], "k long, l long"), spark.createDataFrame([(1, "x")], "k long, r string")
    done = [
        tracked.track_select(a, ["k"]), tracked.track_filter(a, "l > 1"), tracked.track_group(a, ["k"], "sum", ["l"]), tracked.track_join(a, b, "k"), tracked.track_join(a, b, ["k"], "left"),
        tracked.track_with_column(a, "m", F.col("l") + 1),
    ]
    for t in done:
        assert checked(tracked.lines(t.events), "dataframe_lineage").first().violations == []
    place = tracked.Place("abcdef01", "c", "abcdef02")
    data, run = [tracked.dataset(a, "a")], F.lit("0" * 32)
    for state in ("START", "COMPLETE", "ABORT", "FAIL"):
        event = tracked.run_event(state, run, "job", data, data, F.current_timestamp(), place, F.lit(5), F.lit("it broke"))
        row = checked(spark.range(1).select(event.alias("value")), "lineage").first()
        assert row.violations == [] and ("it broke" in row.value) == (state in ("ABORT", "FAIL"))
    frame, start = tracked.track_source(a, "a", place)
    assert frame is a and checked(start, "lineage").first().violations == []
    mapped = done[3].events.select("column_lineage.column_mapping").first()[0]
    assert mapped["out.r"] == ["right.r"] and mapped["out.k"] == ["left.k", "right.k"]


def test_cell_events_keep_the_rules(spark):
    jobs = spark.sql("SELECT '0000000a' AS execution_id, 'c' AS cell_id, 'x' AS source, '0000000b' AS session_id, timestamp'2024-01-01 00:00:00' AS started, timestamp'2024-01-01 00:00:01' AS ended, 1.0D AS start_memory_mb, 2.0D AS end_memory_mb, e AS error FROM VALUES (NULL), ('bad') AS t(e)")
    made = tracked.lines(executions.cell_events(jobs))
    assert {r.violations == [] for r in checked(made, "runtime").collect()} == {True}
    assert sorted(json.loads(r.value)["event_type"] for r in made.collect()) == ["cell_execution_end", "cell_execution_error", "cell_execution_start", "cell_execution_start"]


def test_profile_takes_any_type(spark):
    df = spark.createDataFrame([("b", 2**53, None), ("a", 2**53 + 1, 1.5), ("b", None, 1.5)], "t string, n long, x double")
    got = {r["column"]: tuple(r)[1:] for r in profile.column_profile(df, ["t", "n", "x"]).collect()}
    assert got == {"t": (0, 2, "a", "b"), "n": (1, 2, str(2**53), str(2**53 + 1)), "x": (1, 1, "1.5", "1.5")}


def test_stored_tables_by_notebook(spark, tmp_path):
    path = str(tmp_path / "runtime")
    assert catalogue.stored(spark, "runtime_events", path).count() == 0
    rows = spark.createDataFrame([], catalogue.SCHEMAS["runtime_events"]).unionByName(spark.sql("SELECT id AS event_id FROM range(6)"), allowMissingColumns=True)
    catalogue.append(rows.withColumn("notebook_hash", F.when(F.col("event_id") < 4, "aaaaaaaa").otherwise("bbbbbbbb")), path)
    mine = catalogue.stored(spark, "runtime_events", path, "bbbbbbbb")
    assert sorted(r.event_id for r in mine.collect()) == [4, 5]
    assert "PartitionFilters: [isnotnull(notebook_hash" in mine._jdf.queryExecution().toString()  # other notebooks' files aren't opened
    assert catalogue.incompatible(rows, catalogue.SCHEMAS["runtime_events"]) == []
    assert catalogue.incompatible(rows.select(F.col("event_id").cast("int"), F.lit("x").alias("duration_ms")), "event_id long, duration_ms double, cell_id string") == [("duration_ms", "string", "double"), ("cell_id", "none", "string")]
    found = guard.inspect_schema({"runtime_events": rows, "vw_x": rows}, with_views=False, samples=2).where("column_name = 'event_id'").first()
    assert (found.n_rows, found.nullable, found.samples, found.error) == (6, True, ["0", "1"], None)


def test_open_executions_meet_over_any_edge(spark, tmp_path):
    """An execution that runs for hours, one that never ends, and one without a start."""
    rows = [[("a", "cell_execution_start", "2024-01-01 00:09:59"), ("b", "cell_execution_start", "2024-01-01 00:10:00"), ("c", "cell_execution_end", "2024-01-01 00:10:00")], [("a", "cell_execution_end", "2024-01-01 05:00:00")], [("z", "cell_execution_start", "2024-01-09 00:00:00")], [("z", "cell_execution_end", "2024-01-09 00:00:01")]]
    for k, part in enumerate(rows):
        spark.createDataFrame(part, "execution_id string, event_type string, t string").selectExpr("execution_id", "event_type", "cast(t as timestamp) AS emitted_at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("execution_id string, event_type string, emitted_at timestamp").parquet(str(tmp_path / "in"))
        open_executions(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    got = {r.execution_id: (r.state, str(r.ended)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": ("closed", "2024-01-01 05:00:00"), "b": ("open", "None"), "c": ("unmatched", "2024-01-01 00:10:00"), "z": ("closed", "2024-01-09 00:00:01")}


def test_breaking_changes_of_rules():
    old = rules.RUNTIME
    assert rules.breaking(old, old) == [] and rules.breaking(rules.LINEAGE, rules.LINEAGE) == []
    new = rules.record({k: r for k, r in old.required.items() if k != "cell_id"} | {"event_type": rules.text(among=("cell_execution_start",)), "kernel": rules.text(), "cell_source_lines": rules.text()}, {"duration_ms": rules.number(1)}, True)
    assert set(rules.breaking(old, new)) == {
        ("$.cell_id", "no longer required"), ("$.cell_id", "additional"), ("$.end_memory_mb", "additional"), ("$.error_info", "additional"), ("$.kernel", "required"),
        ("$.event_type", "enum"), ("$.cell_source_lines", "type"), ("$.duration_ms", "minimum"),
    }


def test_unique_keys_keep_null_keys(spark):
    rows = spark.createDataFrame([(1, 3), (1, 2), (None, 5), (None, 6), (2, 1)], "k int, at int")
    kept, repeated = unique(rows, "k", "at")
    assert sorted(map(str, kept.collect())) == sorted(map(str, spark.createDataFrame([(1, 2), (None, 5), (None, 6), (2, 1)], "k int, at int").collect()))
    assert [tuple(r) for r in repeated.collect()] == [(1, 3)]
    assert unique(rows.limit(0), "k", "at")[0].count() == 0


def test_entry_is_imported_without_a_session():
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(), e.oracle_sql()"], cwd=home, timeout=120).returncode == 0
