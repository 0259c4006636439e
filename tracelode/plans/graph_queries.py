"""Registered queries on lineage as a graph of some depth: components, reach, impact of columns, costs of chains."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph, reach, views
from ..sources import jsonl
from ..sources.corpus import chained_frame_lines, chained_run_lines, load
from .queries import PM, perf, query, r6
from .scratch import settled


def _typed(lines, kind):
    return settled(jsonl.split(jsonl.checked(lines, kind), kind, F.col("key"))[0], kind)


def _frames(spark, sf_dir):
    return _typed(chained_frame_lines(spark, sf_dir), "dataframe_lineage")


def _runs(spark, sf_dir):
    return _typed(chained_run_lines(spark, sf_dir), "lineage")


# The same edges in SQL: op, operations on frames; rn, runs on datasets.
OP = "op AS (SELECT 'f' || c_custkey AS source, 'f' || (c_custkey // step) AS target, step, c_custkey AS c FROM customer, (VALUES (3), (5)) s(step) WHERE c_custkey > 0 AND (step = 3 OR c_custkey % 2 = 0))"
RN = "rn AS (SELECT 's' || p_partkey AS own, CASE WHEN p_partkey % 10 = 0 THEN 'f' || (p_partkey // 10) END AS frame, 's' || (p_partkey // 2) AS target FROM part WHERE p_partkey > 0)"
WHOLE = "wh AS (SELECT source, target FROM op UNION SELECT own, target FROM rn UNION SELECT frame, target FROM rn WHERE frame IS NOT NULL)"
COLUMNS = "cl AS (SELECT source AS sn, 'value' AS sc, target AS tn, 'value' AS tc FROM op UNION SELECT source, 'id', target, 'value' FROM op WHERE step = 5 UNION SELECT own, 'total', target, 'total' FROM rn UNION SELECT own, 'key', target, 'key' FROM rn UNION SELECT frame, 'value', target, 'total' FROM rn WHERE frame IS NOT NULL)"


@query("SELECT 'c' || c_custkey AS node, min('c' || c_custkey) OVER (PARTITION BY c_custkey // 100) AS component FROM customer")
def strong_components(spark, sf_dir):
    """Customers in rings of a hundred keys each, into which orders flow by way of a chain of days."""
    block = Window.partitionBy(F.expr("c_custkey div 100"))
    after = F.coalesce(F.lead("c_custkey").over(block.orderBy("c_custkey")), F.min("c_custkey").over(block))
    edges = load(spark, sf_dir, "customer").select("c_custkey", after.alias("next")).selectExpr("concat('c', c_custkey) AS source", "concat('c', next) AS target")
    o = load(spark, sf_dir, "orders")
    days = o.selectExpr("concat('d', datediff(o_orderdate, DATE'1970-01-01')) AS source", "concat('d', 1 + datediff(o_orderdate, DATE'1970-01-01')) AS target")
    return graph.in_cycles(edges.unionByName(o.selectExpr("concat('d', datediff(o_orderdate, DATE'1970-01-01')) AS source", "concat('c', o_custkey) AS target")).unionByName(days))


@query(f"WITH RECURSIVE {OP}, {RN}, {WHOLE}, re AS (SELECT source AS seed, target AS node, 1 AS depth FROM wh WHERE source NOT IN (SELECT target FROM wh) UNION SELECT re.seed, wh.target, re.depth + 1 FROM re JOIN wh ON re.node = wh.source WHERE wh.source <> wh.target) SELECT seed, node, CAST(min(depth) AS INTEGER) AS depth FROM re GROUP BY seed, node")
def lineage_reach(spark, sf_dir):
    """What each dataset or frame that nothing flows into reaches, by lineage events of both kinds."""
    edges = settled(graph.dataset_edges(_runs(spark, sf_dir)).select("source", "target").unionByName(graph.frame_edges(_frames(spark, sf_dir))).distinct(), "edges")
    return graph.closure(edges, graph.degrees(edges).where("role = 'root'"))


@query(f"WITH RECURSIVE {OP}, {RN}, {WHOLE}, {COLUMNS}, ed AS (SELECT *, 1 AS w FROM cl UNION SELECT tn, tc, tn, '', 0 FROM cl UNION SELECT source, '', target, '', 1 FROM wh), re AS (SELECT sn AS seed_name, sc AS seed_column, tn AS name, tc AS \"column\", 1 AS depth FROM cl WHERE (sn, sc) NOT IN (SELECT (tn, tc) FROM cl) UNION SELECT re.seed_name, re.seed_column, ed.tn, ed.tc, re.depth + ed.w FROM re JOIN ed ON re.name = ed.sn AND re.\"column\" = ed.sc WHERE (ed.sn, ed.sc) <> (ed.tn, ed.tc)) SELECT seed_name, seed_column, name, \"column\", CAST(min(depth) AS INTEGER) AS depth FROM re GROUP BY ALL")
def column_impact(spark, sf_dir):
    """All columns, datasets and frames that each column that is made of no other can alter."""
    frames, runs = _frames(spark, sf_dir), _runs(spark, sf_dir)
    columns = graph.column_edges(runs).unionByName(graph.frame_column_edges(frames))
    source, target = (columns.select(F.col(c).alias("name"), F.col(f"{c}_column").alias("column")) for c in ("source", "target"))
    return graph.column_impact(runs, frames, source.distinct().join(target, ["name", "column"], "left_anti"))


@query(f"WITH RECURSIVE {PM}, {OP}, ex AS (SELECT execution_id, max(runtime_duration_ms) AS ms, max(memory_delta_mb) AS mb FROM pm GROUP BY execution_id), al AS (SELECT source, target, coalesce(ms, 0) + (c % 40) / 8.0 AS t, 100 + c % 400 AS i, (100 + c % 400) // (step - 1) AS o, mb FROM op LEFT JOIN ex ON format('{{:08x}}', c % 4096) = execution_id), ed AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY t DESC, i DESC, o DESC) = 1), wy AS (SELECT source AS seed, target AS node, 1 AS length, i, o, CAST(o AS DOUBLE) / i AS r, CAST(t AS DOUBLE) AS t, mb FROM ed WHERE source NOT IN (SELECT target FROM ed) UNION ALL SELECT wy.seed, ed.target, wy.length + 1, wy.i, ed.o, wy.r * (CAST(ed.o AS DOUBLE) / ed.i), wy.t + CAST(ed.t AS DOUBLE), greatest(wy.mb, ed.mb) FROM wy JOIN ed ON wy.node = ed.source) SELECT seed, node, CAST(length AS INTEGER) AS length, CAST(i AS BIGINT) AS rows_in, CAST(o AS BIGINT) AS rows_out, round(r, 6) AS retention, round(t, 6) AS time_ms, mb AS memory_mb FROM wy QUALIFY row_number() OVER (PARTITION BY seed, node ORDER BY t DESC, length DESC, r DESC) = 1")
def chain_costs(spark, sf_dir):
    """The slowest way from each frame that nothing flows into to every frame made of it, with times of executions."""
    costs = settled(graph.operation_costs(views.dataframe_lineage(_frames(spark, sf_dir)), perf(spark, sf_dir)), "costs")
    found = graph.chain_costs(costs, graph.degrees(costs.select("source", "target")).where("role = 'root'"))
    return found.withColumns({c: r6(F.col(c)) for c in ("retention", "time_ms")})


@query(f"WITH RECURSIVE {OP}, {RN}, {WHOLE}, re AS (SELECT source AS seed, target AS node, 1 AS depth FROM wh WHERE source NOT IN (SELECT target FROM wh) UNION SELECT re.seed, wh.target, re.depth + 1 FROM re JOIN wh ON re.node = wh.source WHERE wh.source <> wh.target) SELECT seed, node, CAST(min(depth) AS INTEGER) AS depth FROM re GROUP BY seed, node HAVING min(depth) <= 6")
def recursive_reach(spark, sf_dir):
    """The same reach up to six steps by one recursive statement."""
    edges = settled(graph.dataset_edges(_runs(spark, sf_dir)).select("source", "target").unionByName(graph.frame_edges(_frames(spark, sf_dir))).distinct(), "edges")
    return graph.closure_sql(edges, graph.degrees(edges).where("role = 'root'"), 6)


_ASKED = "ps AS (SELECT 's' || p_partkey AS a, 's' || (p_partkey // 16) AS b FROM part UNION ALL SELECT 's' || p_partkey, 's' || (p_partkey // 16 + 1) FROM part UNION ALL SELECT 'f' || (p_partkey % 100), 's' || (p_partkey // 7) FROM part)"


@query(f"WITH RECURSIVE {OP}, {RN}, {WHOLE}, {_ASKED}, re AS (SELECT source AS seed, target AS node FROM wh UNION SELECT re.seed, wh.target FROM re JOIN wh ON re.node = wh.source) SELECT a, b, re.seed IS NOT NULL AS reaches, count(*) AS n FROM ps LEFT JOIN re ON a = seed AND b = node GROUP BY ALL")
def labelled_reach(spark, sf_dir):
    """For pairs of datasets and frames made from parts whether one is made of the other, by stored labels and narrowed searches."""
    edges = settled(graph.dataset_edges(_runs(spark, sf_dir)).select("source", "target").unionByName(graph.frame_edges(_frames(spark, sf_dir))).distinct(), "edges")
    p = load(spark, sf_dir, "part")
    pairs = p.selectExpr("inline(array(struct(concat('s', p_partkey) AS a, concat('s', p_partkey div 16) AS b), struct(concat('s', p_partkey) AS a, concat('s', p_partkey div 16 + 1) AS b), struct(concat('f', p_partkey % 100) AS a, concat('s', p_partkey div 7) AS b)))")
    return reach.reaches(edges, settled(reach.labels(edges), "labels"), pairs).groupBy("a", "b", "reaches").agg(F.count("*").alias("n"))
