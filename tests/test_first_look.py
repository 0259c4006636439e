"""Most lines are checked and typed as they stand, without a variant, with the same rows and violations."""

import pytest
from pyspark.sql import functions as F

from tracelode.functions import normalize, rules
from tracelode.plans.ingest_queries import FRAME_CHANGES, RUN_CHANGES, _changed
from tracelode.sources import jsonl
from tracelode.sources.corpus import LINES
from tracelode.streaming import ingest

RUN = '{"event_type":"cell_execution_start","execution_id":"00000001","cell_id":"c","cell_source":"x","cell_source_lines":1,"start_memory_mb":1.0,"timestamp":"2024-01-01T00:00:00Z","session_id":"00000001","emitted_at":"2024-01-01T00:00:00Z"}'
EVENT = '{"eventType":"START","eventTime":"2024-01-01T00:00:00Z","run":{"runId":"00000000-0000-0000-0000-000000000001","facets":{"performance":{"_producer":"p","durationMs":7}}},"job":{"namespace":"n","name":"j","facets":{}},"inputs":[],"outputs":[{"namespace":"d","name":"o","facets":{"columnMetrics":{"_producer":"marimo-lineage-tracker","_schemaURL":"u","columnMetrics":{"a":{"nullCount":1},"b":{"min":1.5}}}}}],"producer":"marimo-lineage-tracker","schemaURL":"u","session_id":"s","emitted_at":"2024-01-01T00:00:00Z"}'
FRAME = '{"event_type":"dataframe_lineage","execution_id":"00000001","cell_id":"c","session_id":"00000001","timestamp":"1","emitted_at":"2","operation_type":"join","operation_method":"merge","operation_code":"x","operation_parameters":{"how":"left","on":["a","b"]},"input_dataframes":[{"variable_name":"v","shape":[1,2],"columns":["a"],"memory_usage_mb":1.50}],"output_dataframes":[{"variable_name":"v","shape":[1,2],"columns":["a"]}]}'
#: Lines that a look at types alone would take for valid, or for other rows.
CHANGES = {
    "runtime": (RUN, [(":1.0", ":1"), (":1.0", ":NaN"), (":1.0", ':"NaN"'), (":1.0", ':"Infinity"'), (":1.0", ":1e400"), (":1.0", ":-1.0"), (":1.0", ":null"), (":1,", ":1.0,"), (":1,", ":99999999999,"), (":1,", ':"1",'), ('"x"', "7"), ('"x"', '{"a":"b"}'), ('"x"', "'x'"), ('"x"', r'"\u0078"'), ('"x"', '"é\\n\\""'), ('"x"', '""'), ('"cell_id":"c",', '"cell_id":"c","cell_id":"c",'), ("}", "} x"), ("}", ',"error_info":{}}'), ("}", ',"error_info":{"traceback":"t","error_type":"e"}}'), ("}", ',"error_info":{"error_type":"e","error_message":"m"}}'), ("}", ',"error_info":{"error_type":"e","more":[1]}}'), (":", ": ")]),
    "lineage": (EVENT, [('"a":{"nullCount":1},', '"a":{"nullCount":1},"a":{"nullCount":1},'), ('"a":{"nullCount":1},', '"c":{"nullCount":1},'), ('"min":1.5', '"min":"1.5"'), ('"min":1.5', '"min":1.0'), (":7", ":7.5"), (":7", ":7.50"), (":7", ":-7"), (":7", ':"7"'), ('"facets":{}', '"facets":{"b":1,"a":[{"d":1,"c":2}]}'), ('"facets":{}', '"facets":{"a":1,"a":2}'), ('"facets":{}', '"facets":[]'), ("[]", "[null]"), ("[]", '[{"namespace":"d","name":"i","facets":{}},{"namespace":"d","name":"i"}]'), ("[]", '[{"namespace":"d","name":"i","facets":{"tags":{"a":1}}}]'), ('"outputs":[', '"outputs":[{"namespace":"e","name":"o","facets":{"columnMetrics":{"_producer":"marimo-lineage-tracker","_schemaURL":"v","columnMetrics":{}},"dataQualityMetrics":{"rowCount":3}}},'), ('"durationMs":7}', '"durationMs":7},"extra":{"x":1e2,"a":[null]}')]),
    "dataframe_lineage": (FRAME, [("[1,2]", "[1,2,3]"), ("[1,2]", "[1,null]"), ("[1,2]", "[1,-2]"), ("1.50", "1.5"), ("1.50", "3"), ("1.50", "-3"), ('["a","b"]', '"a"'), ('["a","b"]', "3"), ("}]}", '}],"column_lineage":{"column_mapping":{"o.b":["a.b"],"o.a":[]}}}'), ("}]}", '}],"column_lineage":{"column_mapping":{"o.a":["a.b"],"o.b":[]}}}'), ("}]}", '}],"performance":{"overhead_ms":0.25,"sampled":true}}'), ("}]}", '}],"performance":{"overhead_ms":"NaN"}}')]),
}


@pytest.mark.parametrize("kind, changes", [("runtime", ()), ("lineage", RUN_CHANGES), ("dataframe_lineage", FRAME_CHANGES)])
def test_lines_valid_as_they_stand_give_the_same_rows(spark, kind, changes):
    line, odd = CHANGES[kind]
    made = [(line,), *((line.replace(a, b, 1),) for a, b in odd), (line.replace('"x"', '"' + "x" * rules.LONGEST + '"'),)]
    lines = LINES[kind](spark, "/root/testdata/sf0.001").select("value")
    lines = lines.unionByName(_changed(LINES[kind](spark, "/root/testdata/sf0.001"), changes).select("value")).unionByName(spark.createDataFrame(made, "value string")).withColumn("key", F.xxhash64("value"))
    found = jsonl.checked(lines, kind)
    plain = rules.settle(lines, "v", F.try_parse_json("value"))
    plain = rules.settle(plain, "violations", rules.violations("v", kind))
    assert {r.key: r.violations for r in found.select("key", "violations").collect()} == {r.key: r.violations for r in plain.select("key", "violations").collect()}
    rows = lambda df: sorted(map(str, df.collect()))
    want = normalize.ROWS[kind](plain.where("size(violations) = 0")).withColumn("broken", normalize.constraint(kind)).where("broken IS NULL").drop("broken")
    assert rows(jsonl.split(found, kind, F.col("key"))[0]) == rows(want)
    # Valid lines of the usual writer aren't parsed further, and each odd one that breaks a rule is.
    n = found.where("size(violations) = 0").count()
    assert n * 0.6 < found.where("_first IS NOT NULL AND _v IS NULL").count() < n
    assert found.where("_first IS NOT NULL AND size(violations) > 0").count() == 0
    assert (found.where(F.col("value") == line).where("_first IS NOT NULL").count() > 0) == (kind != "dataframe_lineage")  # a number written as 1.50


def test_batches_of_a_stream_carry_no_variant_of_lines_valid_as_they_stand(spark, tmp_path):
    """a batch holds what the first look read, and its rows come of that."""
    (tmp_path / "aaaaaaaa_1.jsonl").write_text(RUN + "\n" + RUN.replace('":', '": ') + "\n{\n")
    seen, table, bad = [], str(tmp_path / "t"), str(tmp_path / "bad")
    was, ingest.ingest = ingest.ingest, lambda batch, *more: (seen.append(batch.columns), was(batch, *more))
    try:
        ingest.process_now(spark, "runtime", [str(tmp_path / "aaaaaaaa_1.jsonl")], table, bad)
    finally:
        ingest.ingest = was
    assert "v" not in seen[0] and {"_first", "_v"} <= set(seen[0])
    rows = [r.asDict() for r in ingest.committed(spark, "runtime", table).drop("event_id", "row_id").collect()]
    assert len(rows) == 2 and rows[0] == rows[1] and ingest.quarantined(spark, table, bad).count() == 1
