"""Commits of ingest, counters, keys, the guard's cap."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from tests import compare
from tracelode.functions.normalize import unique
from tracelode.operators import guard
from tracelode.plans import registry as engine
from tracelode.sources import jsonl
from tracelode.sources.commits import Log, current
from tracelode.streaming.ingest import committed, compact, open_executions, process_now, quarantined, start_ingest, statistics

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["execution_states_stream", "committed_ingest", "live_counters", "reprocessed_files", "landed_logs", "unique_keys", "guarded_query"])
def test_query_equals_sql(spark, name):
    assert compare.spark_rows(engine.QUERIES[name](spark, SF)) == compare.sql_rows(SF, engine.SQL[name])


def event(n):
    return json.dumps({"event_type": "cell_execution_start", "execution_id": f"{n:08x}", "cell_id": "c", "cell_source": "x", "cell_source_lines": 1, "start_memory_mb": 1.0, "timestamp": "2024-01-01T00:00:00Z", "session_id": "abcdef02", "emitted_at": "2024-01-01T00:00:00Z"})


@pytest.fixture
def logs(spark, tmp_path):
    """Three files: 40 good lines, 7 bad ones, a line that stands three times, blank ones."""
    root = tmp_path / "logs" / "runtime"
    root.mkdir(parents=True)
    for k in range(3):
        lines = [event(100 * k + i) for i in range(13 + (k == 0))] + ["{", "[]", *(["not json"] if k == 0 else [])] + ["", " "]
        (root / f"aaaaaaaa_n{k}.jsonl").write_text("\n".join(lines + ([event(5)] * 3 if k == 2 else [])) + "\n")
    return tmp_path


def told(spark, at):
    table, bad = f"{at}/table", f"{at}/bad"
    rows = committed(spark, "runtime", table)
    stats = {r.path.rsplit("_", 1)[1]: (r.n_lines, r.processed, r.failed) for r in statistics(spark, table, bad).collect()}
    q = quarantined(spark, table, bad)
    return rows.count(), rows.select("row_id").distinct().count(), q.count(), q.select("row_id").distinct().count(), stats


WANT = (43, 43, 7, 7, {"n0.jsonl": (17, 14, 3), "n1.jsonl": (15, 13, 2), "n2.jsonl": (18, 16, 2)})


def stream(spark, at, check="check"):
    return start_ingest(spark, "runtime", f"{at}/logs", f"{at}/table", f"{at}/bad", f"{at}/{check}", files_a_batch=1)


def test_stream_and_second_looks_count_once(spark, logs):
    stream(spark, logs).awaitTermination()
    assert told(spark, logs) == WANT
    files = f"{logs}/logs/runtime/*.jsonl"
    process_now(spark, "runtime", [files], f"{logs}/table", f"{logs}/bad")
    process_now(spark, "runtime", [f"{logs}/logs/runtime/aaaaaaaa_n1.jsonl"], f"{logs}/table", f"{logs}/bad")  # by another list
    stream(spark, logs, "another").awaitTermination()  # a checkpoint of its own
    assert told(spark, logs) == WANT
    # A file that has grown gives its new lines, and its new counts in place of the old.
    with open(f"{logs}/logs/runtime/aaaaaaaa_n1.jsonl", "a") as f:
        f.write(event(999) + "\n")
    process_now(spark, "runtime", [files], f"{logs}/table", f"{logs}/bad")
    assert told(spark, logs) == (44, 44, 7, 7, WANT[4] | {"n1.jsonl": (16, 14, 2)})
    assert compact(spark, "runtime", f"{logs}/table", f"{logs}/bad")
    assert told(spark, logs) == (44, 44, 7, 7, WANT[4] | {"n1.jsonl": (16, 14, 2)}) and len(current(Log(spark, f"{logs}/table").commits())) == 1


def test_writers_at_once(spark, logs):
    errors = []

    def look():
        try:
            process_now(spark, "runtime", [f"{logs}/logs/runtime/*.jsonl"], f"{logs}/table", f"{logs}/bad")
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=look) for _ in range(3)]
    query = stream(spark, logs)
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    query.awaitTermination()
    assert errors == [] and told(spark, logs) == WANT
    assert [c.number for c in Log(spark, f"{logs}/table").commits()] == list(range(1, 7))  # three batches, three looks


def test_what_is_not_committed_is_not_seen(spark, logs, monkeypatch):
    """A batch that breaks off before its entry, and runs again, leaves nothing twice; one whose entry is there does nothing."""
    real, calls = Log.add, []

    def broken(self, *args, **kw):
        calls.append(args[2])
        if len(calls) == 1:
            raise OSError("lost")
        return real(self, *args, **kw)

    monkeypatch.setattr(Log, "add", broken)
    with pytest.raises(Exception, match="lost"):
        stream(spark, logs).awaitTermination()
    assert told(spark, logs) == (0, 0, 0, 0, {})
    stream(spark, logs).awaitTermination()
    assert told(spark, logs) == WANT and calls[0] == calls[1]


def test_log_of_many_commits(spark, tmp_path):
    log = Log(spark, str(tmp_path / "t"))
    assert log.commits() == []
    seen = []
    for k in range(130):
        assert log.add(f"i{k}", f"d{k}", f"l{k}", seen)
        seen = log.commits()
        assert [c.number for c in seen] == list(range(1, k + 2))
    assert not log.add("x", "x", "x", seen[:-1]) and log.commits() == seen and [c.label for c in seen] == [f"l{k}" for k in range(130)]


def test_equal_lines_are_numbered_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(jsonl, "BLOCK", 10)
    lines = spark.createDataFrame([("f", "hot", 1)] * 95 + [("f", "b", 1), ("g", "hot", 2), ("g", "hot", 2)], "path string, value string, extra int")
    got = jsonl.identified(lines)
    again = {r.row_id for r in jsonl.identified(lines.repartition(7)).collect()}
    assert got.groupBy("path", "value", "extra").count().orderBy("path", "value").collect() == [("f", "b", 1, 1), ("f", "hot", 1, 95), ("g", "hot", 2, 2)]
    assert {r.row_id for r in got.collect()} == again and len(again) == 98


def test_unique_keeps_one_row_whatever_the_ties(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 5, "a"), (1, 5, "b"), (2, 1, "x"), (None, 1, "n"), (None, 1, "n")], "k int, at int, other string").repartition(3)
    kept, repeated = unique(rows, "k", "at")
    assert sorted(str(r.k) for r in kept.collect()) == ["1", "2", "None", "None"] and [r.k for r in repeated.collect()] == [1, 1]
    assert unique(rows, "k", "at")[0].where("k = 1").first() == kept.where("k = 1").first()


@pytest.mark.parametrize("text", ["SELECT id AS limit_x FROM runtime_events", "SELECT id FROM runtime_events LIMIT 4000", "SELECT id FROM runtime_events", "SELECT id FROM runtime_events WHERE 'limit' = 'limit'", "SELECT id FROM (runtime_events JOIN lineage_events USING (id))"])
def test_no_text_returns_over_the_cap(spark, text):
    spark.range(5000).createOrReplaceTempView("runtime_events")
    spark.range(5000).createOrReplaceTempView("lineage_events")
    assert guard.guarded_sql(spark, text, limit=5000).count() == guard.MOST_ROWS


@pytest.mark.parametrize("text", ["SELECT * FROM (runtime_events JOIN secrets)", "SELECT (SELECT max(id) FROM secrets) FROM runtime_events", "SELECT * FROM runtime_events WHERE id IN (SELECT id FROM (secrets))", "SELECT extract(YEAR FROM t) FROM secrets", "SELECT * FROM (range(9))", "SELECT id FROM nowhere_at_all", "SELECT FROM FROM"])
def test_the_plan_tells_foreign_tables(spark, text):
    spark.range(5).withColumn("t", F.current_timestamp()).createOrReplaceTempView("secrets")
    spark.range(5).createOrReplaceTempView("runtime_events")
    with pytest.raises(ValueError):
        guard.guarded_sql(spark, text)


def test_second_starts_and_ends(spark, tmp_path):
    """Told twice at once counts once; an execution that ends again later has a row for each end; an end before its start is none of it."""
    rows = [[("a", "cell_execution_start", "2024-01-01 00:00:00"), ("a", "cell_execution_start", "2024-01-01 00:00:01"), ("a", "cell_execution_end", "2024-01-01 00:01:00"), ("e", "cell_execution_end", "2024-01-01 00:00:00"), ("e", "cell_execution_start", "2024-01-01 00:00:05")], [("x", "cell_execution_start", "2024-01-01 03:00:00")], [("a", "cell_execution_error", "2024-01-01 04:00:00")], [("x", "cell_execution_end", "2024-01-09 00:00:00")]]
    for part in rows:
        spark.createDataFrame(part, "execution_id string, event_type string, t string").selectExpr("execution_id", "event_type", "cast(t as timestamp) AS emitted_at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("execution_id string, event_type string, emitted_at timestamp").parquet(str(tmp_path / "in"))
        open_executions(source).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.execution_id, r.state, str(r.ended)[11:16]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", "closed", "00:01"), ("a", "closed", "04:00"), ("e", "open", ""), ("e", "unmatched", "00:00"), ("x", "open", "")]
