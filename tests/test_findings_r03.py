"""One test a finding of the third round: each failed before its change."""

from dataclasses import replace

from pyspark.sql import functions as F

from tracelode.functions import rules
from tracelode.operators import graph, guard, sketches
from tracelode.plans.ingest_queries import NARROWER
from tracelode.streaming.ingest import committed, compact, process_now


def test_files_without_rows_are_read_once(spark, tmp_path):
    """a first task without rows leaves an empty file."""
    table, store = str(tmp_path / "t"), str(tmp_path / "s")
    spark.range(0, 100, 1, 2).where("id >= 50").write.parquet(table)
    assert sketches.refresh(spark, table, store, ["id"]) == 2
    assert sketches.refresh(spark, table, store, ["id"]) == 0
    row = sketches.profile(spark, store, table).first()
    assert (row.n, row.null_count, row.distinct_count, row.least, row.most) == (50, 0, 50, "50", "99")
    spark.range(0).write.mode("append").parquet(table)
    assert sketches.refresh(spark, table, store, ["id"]) == 1 and sketches.refresh(spark, table, store, ["id"]) == 0


def test_guarded_sql_gives_all_rows_to_a_table(spark):
    """1500 groups came as 1000."""
    spark.range(1500).selectExpr("cast(id AS string) AS session_id").createOrReplaceTempView("runtime_events")
    text = "SELECT session_id, count(*) AS n FROM runtime_events GROUP BY session_id"
    assert guard.guarded_sql(spark, text, limit=None).count() == 1500
    assert guard.guarded_sql(spark, text, limit=0).count() == guard.MOST_ROWS


def test_audit_makes_each_part_once(spark):
    """a report named the audit five times, and each the tables read."""
    plan = spark.createDataFrame([("select 1",)], "sql string").select(guard.syntax_report(F.col("sql")).alias("r")).select("r.*")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_extract_all") <= 3


def test_rules_kept_in_both_are_not_asked_again():
    """all of the new rule was walked for each event that the old one takes."""
    left = rules.beyond(rules.RUNTIME, NARROWER)
    assert set(left.required) == {"event_type", "start_memory_mb", "cell_source_lines"} and not left.optional and not left.closed
    fewer = replace(rules.RUNTIME, required={k: r for k, r in rules.RUNTIME.required.items() if k != "cell_id"})
    assert rules.beyond(rules.RUNTIME, fewer) == fewer  # closed to a field that old events have
    asked = replace(rules.RUNTIME, required={**rules.RUNTIME.required, "duration_ms": rules.number(0)})
    assert set(rules.beyond(rules.RUNTIME, asked).required) == {"duration_ms"}


def test_closure_of_many_seeds_reads_nothing_found_again(spark, monkeypatch):
    """each round compared its pairs with all that were found before."""
    pairs = [(c, c // 3) for c in range(1, 200)] + [(c, c // 5) for c in range(2, 200, 2)]
    df = spark.createDataFrame(pairs, "source long, target long").where("source > 2")
    edges = {(a, b) for a, b in pairs if a > 2}
    want = {}
    for seed in range(60, 200):
        front, depth = {seed}, 0
        while front := {b for a, b in edges if a in front}:
            depth += 1
            for b in front:
                want.setdefault((seed, b), depth)
    monkeypatch.setattr(graph, "_spread", None)
    seeds = spark.range(60, 200).selectExpr("id AS node")
    got = {(r.seed, r.node): r.depth for r in graph.closure(df, seeds).collect()}
    assert got == want
    assert {(r.seed, r.node): r.depth for r in graph.closure(df, seeds, 2).collect()} == {k: d for k, d in want.items() if d <= 2}


def test_new_files_are_stored_without_reading_the_rows_of_others(spark, tmp_path):
    """each batch was joined with all rows of its notebooks. Rows stored without the number of their file count as well."""
    line = '{{"event_type":"cell_execution_start","execution_id":"{:08x}","cell_id":"c","cell_source":"x","cell_source_lines":1,"start_memory_mb":1.0,"timestamp":"2024-01-01T00:00:00Z","session_id":"00000001","emitted_at":"2024-01-01T00:00:00Z"}}\n'
    table, bad, files = str(tmp_path / "t"), str(tmp_path / "bad"), [str(tmp_path / f"aaaaaaaa_{n}.jsonl") for n in range(3)]
    for n, name in enumerate(files):
        with open(name, "w") as out:
            out.writelines(line.format(10 * n + k) for k in range(n + 2))
    look = lambda *n: process_now(spark, "runtime", [files[k] for k in n], table, bad)
    count = lambda: [committed(spark, "runtime", table).agg(F.count("*"), F.count_distinct("row_id")).first()[k] for k in (0, 1)]
    look(0)
    parts = {p: p.read_bytes() for p in tmp_path.glob("t/commit=*/**/*.parquet")}
    for p in parts:
        p.write_bytes(b"none")
    look(1)  # opens nothing of the first file's
    for p, was in parts.items():
        p.write_bytes(was)
        (p.parent / f".{p.name}.crc").unlink(missing_ok=True)
        spark.read.parquet(str(p)).drop("file").write.parquet(str(tmp_path / "old" / p.name))
        p.write_bytes(b"".join(o.read_bytes() for o in (tmp_path / "old" / p.name).glob("*.parquet")))
    assert count() == [5, 5]
    look(0, 1, 2)
    assert count() == [9, 9]
    compact(spark, "runtime", table, bad)
    look(0, 1, 2)
    assert count() == [9, 9] and "file" not in committed(spark, "runtime", table).columns
