"""F16: of an event that isn't valid at first sight only the fields that aren't are walked, with the same rules found in the same order."""

import pytest
from pyspark.sql import functions as F

from tracelode.functions import rules
from tracelode.plans.ingest_queries import FRAME_CHANGES, RUN_CHANGES, _changed
from tracelode.sources import jsonl
from tracelode.sources.corpus import LINES

ODD = ["", "[]", "{", "{}", "3", "null", '{"inputs":null}', '{"inputs":[null,{"name":1}],"run":{"runId":"r","facets":{"extra":{"x":1}}},"job":[]}', '{"event_type":7,"cell_source_lines":1.5,"session_id":"00000001"}', '{"outputs":[{"namespace":"a","name":"b","facets":{"schema":1}}],"producer":"other"}', '{"performance":{"overhead_ms":-1},"input_dataframes":[{"shape":[1]}]}']


@pytest.mark.parametrize("kind, changes", [("dataframe_lineage", FRAME_CHANGES), ("lineage", RUN_CHANGES), ("runtime", ())])
def test_fields_that_are_right_are_not_walked(spark, kind, changes):
    lines = _changed(LINES[kind](spark, "/root/testdata/sf0.001"), changes).select("value").unionByName(spark.createDataFrame([(x,) for x in ODD], "value string"))
    found = rules.settle(jsonl.checked(lines, kind).drop("_kept"), "all", rules.violations("v", kind))
    assert found.where("violations <> all").count() == 0 and found.where("size(violations) > 0").count() > len(ODD)
    read = rules.settle(lines.withColumn("v", F.try_parse_json("value")), "r", rules.typed(F.to_json("v"), kind))
    kept = read.where("v IS NOT NULL").select(rules.plain_fields("v", "r", kind).alias("k"))
    # What a field keeps breaks nothing: where all fields but one are kept, only that one is left to look at.
    assert kept.where(F.size(F.filter(F.array("k.*"), lambda x: x)) == len(kept.schema["k"].dataType) - 1).count() > 0
