"""One test a finding of the fourth round: each failed before its change."""

import pathlib

import pytest
from pyspark.sql import functions as F

from tests import compare
from tracelode.operators import graph, reach
from tracelode.plans import capture_queries, queries
from tracelode.streaming import ingest


def test_described_tables_fails_with_its_tables(spark, monkeypatch):
    """a table that couldn't be read was left out of the result."""
    broken = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("torn"))).otherwise(F.col("id")).alias("ol_event_id"))
    monkeypatch.setattr(capture_queries, "runtime", lambda *_: spark.range(5).withColumnRenamed("id", "event_id"))
    monkeypatch.setattr(capture_queries, "io", lambda *_: broken)
    with pytest.raises(RuntimeError, match="vw_lineage_io can't be read: .*torn"):
        capture_queries.described_tables(spark, "")
    monkeypatch.setattr(capture_queries, "io", lambda *_: spark.range(0).withColumnRenamed("id", "ol_event_id"))
    rows = capture_queries.described_tables(spark, "").collect()
    assert [(r.table_name, r.n_rows, r.samples) for r in rows] == [("runtime_events", 5, "0,1,2"), ("vw_lineage_io", 0, "")]


def test_closure_of_many_seeds_hands_lists_on(spark, monkeypatch):
    """each pair of seed and node was dealt over tasks and written, and a graph without edges had no levels to begin with."""
    pairs = [(s, 1000) for s in range(200)] + [(1000 + k, 1001 + k) for k in range(30)] + [(7, 1015), (500, 501), (501, 1000)]
    df = spark.createDataFrame(pairs, "source long, target long")
    written = []
    settled = graph.settled
    monkeypatch.setattr(graph, "settled", lambda d, name: written.append((name, settled(d, name))) or written[-1][1])
    seeds = spark.createDataFrame([(s,) for s in (*range(200), 1003, 1030, 9999)], "node long")
    want = {(s, 1000 + k): min(k + 1, k - 14 if s == 7 and k > 14 else k + 1) for s in range(200) for k in range(31)} | {(1003, 1003 + k): k for k in range(1, 28)}
    got = {(r.seed, r.node): r.depth for r in graph.closure(df, seeds).collect()}
    assert got == want and sum(d.count() for name, d in written if name == "found") < len(want) / 10
    monkeypatch.setattr(graph, "MOST_NODES", 8)
    assert {(r.seed, r.node): r.depth for r in graph.closure(df, seeds, 20).collect()} == {k: d for k, d in want.items() if d <= 20}
    assert graph.closure(df, spark.createDataFrame([(9998 + k,) for k in range(20)], "node long")).count() == 0
    assert graph.closure(df.limit(0), seeds).count() == 0


def test_lines_of_a_batch_are_neither_dealt_nor_cached(spark, tmp_path, monkeypatch):
    """every line, with all that was read of it, was brought together with its equals and cached, to number the few that come again."""
    line = '{{"event_type":"cell_execution_start","execution_id":"{:08x}","cell_id":"c","cell_source":"x","cell_source_lines":1,"start_memory_mb":1.0,"timestamp":"2024-01-01T00:00:00Z","session_id":"00000001","emitted_at":"2024-01-01T00:00:00Z"}}\n'
    table, bad = str(tmp_path / "t"), str(tmp_path / "bad")
    for n in range(2):
        with open(tmp_path / f"aaaaaaaa_{n}.jsonl", "w") as out:
            out.writelines([line.format(k) for k in (*range(20), 3, 3)] + ["{\n"] * (3 * n) + [line.format(99).replace(":1,", ":0,")])
    dealt, identified = [], ingest.identified
    monkeypatch.setattr(ingest, "identified", lambda df: dealt.append(df.count()) or identified(df))
    ingest.process_now(spark, "runtime", [str(tmp_path / "*.jsonl")], table, bad)
    assert dealt == [9] and not spark.sparkContext._jsc.getPersistentRDDs() and not list((tmp_path / "t" / "_aside").iterdir())
    rows = ingest.committed(spark, "runtime", table)
    assert rows.count() == rows.select("row_id").distinct().count() == rows.select("event_id").distinct().count() == 44
    gone = ingest.quarantined(spark, table, bad).collect()
    assert sorted((r.path[-7], r.reason) for r in gone) == [("0", "minimum"), *[("1", "json")] * 3, ("1", "minimum")] and len({r.row_id for r in gone}) == 5
    assert sorted(tuple(r)[1:] for r in ingest.statistics(spark, table, bad).collect()) == [(23, 22, 1), (26, 22, 4)]
    ids = {(r.row_id, r.event_id) for r in rows.collect()}
    ingest.process_now(spark, "runtime", [str(tmp_path / "*.jsonl")], table, bad)
    assert {(r.row_id, r.event_id) for r in ingest.committed(spark, "runtime", table).collect()} == ids


def test_streams_read_compressed_lines(spark, tmp_path):
    """the lines of all three kinds lay in plain text, more than all else that the query writes."""
    got = queries.ingest_statistics(spark, "/root/testdata/sf0.001").collect()
    newest = max(pathlib.Path(queries.shared_dir(spark)).glob("stream-*"), key=lambda p: p.stat().st_mtime)
    files = [p.name for p in newest.glob("in/*/part-*")]
    assert files and all(n.endswith(".lz4") for n in files)
    assert compare.canonical(["n_lines", "processed", "failed"], [tuple(r) for r in got]) == compare.sql_rows("/root/testdata/sf0.001", queries.SQL["ingest_statistics"])


def test_labels_send_no_table_by_way_of_the_driver(spark, capsys, monkeypatch):
    """sides of joins that grow with edges and pairs were collected by the driver and sent out whole, up to the threshold, in every round."""
    plans, settled = [], reach.settled

    def told(df):
        df.explain()
        return capsys.readouterr().out

    monkeypatch.setattr(reach, "settled", lambda df, name: plans.append(told(df)) or settled(df, name))
    edges = settled(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "e")], "source string, target string"), "edges")
    pairs = settled(spark.createDataFrame([("a", "e"), ("e", "a"), ("b", "c"), (None, "a")], "a string, b string"), "pairs")
    found = reach.reaches(edges, reach.labels(edges), pairs)
    plans.append(told(found))
    assert {(r.a, r.b): r.reaches for r in found.collect()} == {("a", "e"): True, ("e", "a"): False, ("b", "c"): True, (None, "a"): False}
    assert sum("Join" in p for p in plans) > 10 and not any("Broadcast" in p for p in plans)
