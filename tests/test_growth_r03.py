"""One test a finding of growth of the third round: each failed before its change."""

from pyspark.sql import functions as F

from tracelode.operators import components, guard
from tracelode.sources.corpus import LINES

SF = "/root/testdata/sf0.001"


def test_samples_of_a_view_are_made_for_their_rows_only(spark):
    """a view's columns were made for all rows, to show three."""
    made = lambda c, least: F.when(F.col("id") >= least, F.raise_error(F.lit("made"))).otherwise(F.col(c).cast("string"))
    told = lambda df: {r.column_name: r.samples for r in guard.inspect_schema({"t": df}, samples=3).where("error is null").collect()}
    rows = spark.range(100)
    assert told(rows.select("id", made("id", 3).alias("x"))) == {"id": ["0", "1", "2"], "x": ["0", "1", "2"]}
    some = rows.selectExpr("IF(id < 2, NULL, id) AS k", "id")
    assert told(some.select("k", made("id", 3).alias("x"))) == {"k": ["2"], "x": ["0", "1", "2"]}
    assert told(rows.where("id < 2").selectExpr("cast(NULL AS bigint) AS k", "cast(id AS string) AS x")) == {"k": [], "x": ["0", "1"]}
    assert told(rows.selectExpr("cast(id AS double) AS k")) == {"k": ["0.0", "1.0", "2.0"]}


def test_logs_are_in_the_order_of_their_times(spark):
    """wide typed rows were sorted after they were made, instead of few columns before."""
    for kind, at in (("runtime", "timestamp"), ("lineage", "eventTime")):
        lines = LINES[kind](spark, SF).select(F.spark_partition_id().alias("p"), F.coalesce(F.get_json_object("value", f"$.{at}"), F.lit("")).alias("t")).collect()
        parts = {}
        for r in lines:
            if r.t:
                parts.setdefault(r.p, []).append(r.t)
        assert len(parts) > 1 and all(x == sorted(x) for x in parts.values())


def test_components_send_no_table_by_way_of_the_driver(spark, capsys):
    """sides of joins that grow with the edges were collected and sent out whole, up to the threshold, in every round."""
    edges = components.settled(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a")], "source string, target string"), "edges")
    nodes = components.settled(edges.selectExpr("source AS node").where("node = 'x'"), "nodes")
    for df in (components._without(edges, nodes), components.strong_components(edges)):
        assert df.count() == 3
        df.explain()
        assert "Broadcast" not in capsys.readouterr().out
