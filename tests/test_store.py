"""Stored tables in the catalogue, sketches of files, recursive SQL, inspection of broken tables."""

import os

import pytest
from pyspark.sql import functions as F

from tests import compare
from tracelode.operators import executions, graph, guard, sketches, views
from tracelode.plans import registry as engine
from tracelode.sources import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["stored_catalogue", "incremental_profile", "session_summary", "recursive_reach"])
def test_query_equals_sql(spark, name):
    assert compare.spark_rows(engine.QUERIES[name](spark, SF)) == compare.sql_rows(SF, engine.SQL[name])


def test_another_session_finds_the_tables_and_joins_without_a_shuffle(spark, tmp_path):
    rows = spark.range(200).select(*(F.lit(None).cast(t).alias(c) if c not in ("event_id", "execution_id", "event_type") else {"event_id": F.col("id"), "execution_id": (F.col("id") % 50).cast("string"), "event_type": F.lit("cell_execution_end")}[c].alias(c) for c, t in (f.split() for f in catalogue.SCHEMAS["runtime_events"].split(", "))))
    runs = spark.range(30).select(*(F.lit(None).cast(t).alias(c) if c not in ("ol_event_id", "execution_id") else {"ol_event_id": F.col("id"), "execution_id": F.col("id").cast("string")}[c].alias(c) for c, t in (f.split() for f in catalogue.SCHEMAS["lineage_events"].split(", "))))
    catalogue.create(spark, "kept", str(tmp_path / "kept"), 4)
    catalogue.fill(spark, "kept", "runtime_events", rows, 4)
    catalogue.fill(spark, "kept", "lineage_events", runs, 4)
    other = spark.newSession()
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    r, l, f = catalogue.tables(other, "kept")
    view = views.performance_metrics(r, l)
    assert "Exchange" not in view._jdf.queryExecution().executedPlan().toString() and view.count() == 200 and view.where("ol_event_id is not null").count() == 120 and f.count() == 0
    size = {x.table_name: (x.n_rows, x.n_bytes > 0) for x in catalogue.sizes(spark, "kept").collect()}
    assert size == {"runtime_events": (200, True), "lineage_events": (30, True), "dataframe_lineage_events": (0, False)}
    # Dropped from the catalogue, the files stay, and creating finds them: what a later day's session does.
    for name in catalogue.SCHEMAS:
        spark.sql(f"DROP TABLE kept.{name}")
    catalogue.create(spark, "kept", str(tmp_path / "kept"), 4)
    assert [t.count() for t in catalogue.tables(spark, "kept")] == [200, 30, 0]


def test_sketches_read_new_files_only(spark, tmp_path, monkeypatch):
    table, store = str(tmp_path / "t"), str(tmp_path / "s")
    make = lambda a, b: spark.range(a, b).selectExpr("id", "id % 7 AS few", "IF(id % 10 = 0, NULL, concat('n', id)) AS name", "id / 3.0D AS x")
    make(0, 20_000).coalesce(2).write.parquet(table)
    columns = ["id", "few", "name", "x"]
    assert sketches.refresh(spark, table, store, columns) == 2 and sketches.refresh(spark, table, store, columns) == 0
    make(20_000, 30_000).coalesce(1).write.mode("append").parquet(table)
    assert sketches.refresh(spark, table, store, columns) == 1
    got = {r.column: r for r in sketches.profile(spark, store, table).collect()}
    assert [got[c].n for c in columns] == [30_000] * 4 and got["name"].null_count == 3000 and (got["id"].least, got["id"].most) == ("0", "29999")
    for c, exact in (("id", 30_000), ("few", 7), ("name", 27_000), ("x", 30_000)):
        assert abs(got[c].distinct_count - exact) <= 0.024 * exact
    for c, scale in (("id", 30_000), ("x", 10_000)):
        assert all(abs(got[c][q] / scale - s) <= 0.0133 for q, s in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)))
    assert got["name"].q50 is None
    # A file that is gone counts no longer; nothing is read for that.
    os.remove(next(str(p) for p in (tmp_path / "t").glob("part-*.parquet")))
    assert 0 < sketches.profile(spark, store, table).where("column = 'id'").first().n < 30_000
    assert sketches.profile(spark, str(tmp_path / "none")).count() == 0


def test_recursive_sql_equals_the_loop(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (None, 1), (6, None), (5, 5)], "source long, target long")
    seeds = spark.createDataFrame([(1,), (4,), (9,)], "node long")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(graph.closure_sql(e, seeds, 8)) == rows(graph.closure(e, seeds)) and rows(graph.closure_sql(e, seeds, 2)) == rows(graph.closure(e, seeds, 2))


def test_a_table_that_fails_while_read_leaves_the_others(spark, tmp_path):
    spark.range(4).coalesce(1).write.parquet(str(tmp_path / "broken"))
    part = next((tmp_path / "broken").glob("part-*.parquet"))
    part.write_bytes(part.read_bytes()[:20])
    broken = spark.read.schema("id long").parquet(str(tmp_path / "broken"))
    got = {r.table_name: r for r in guard.inspect_schema({"runtime_events": spark.range(3), "lineage_events": broken}, samples=1).collect()}
    assert got["runtime_events"].n_rows == 3 and got["runtime_events"].error is None and got["lineage_events"].n_rows is None and got["lineage_events"].error


def test_sessions_of_one_side_only(spark):
    r = spark.createDataFrame([("a", "x", "cell_execution_error")], "session_id string, execution_id string, event_type string")
    f = spark.createDataFrame([("b", '[{"variable_name":"u"}]', None), ("b", '[{"variable_name":"u"}]', '[{"variable_name":"v"}]')], "session_id string, input_dataframes string, output_dataframes string")
    assert sorted(map(tuple, executions.session_summary(r, f).collect())) == [("a", 1, 1, 0, 0), ("b", 0, 0, 2, 2)]
