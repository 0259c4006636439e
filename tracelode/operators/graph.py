"""Lineage as a graph of datasets and of columns."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..plans.scratch import settled, shared_dir
from .components import bypassed, chain_links, strong_components
from .views import names_of


def dataset_edges(lineage: DataFrame) -> DataFrame:
    """source, target, job_name, execution_id: each input of a run to each output."""
    rows = lineage.select("job_name", "execution_id", names_of(F.col("inputs_json")).alias("i"), names_of(F.col("outputs_json")).alias("o"))
    return rows.withColumn("source", F.explode("i")).withColumn("target", F.explode("o")).select("source", "target", "job_name", "execution_id")


def column_edges(lineage: DataFrame) -> DataFrame:
    """From columnLineage facets: source, source_column, target, target_column."""
    facet = "map<string,struct<fields:map<string,struct<inputFields:array<struct<namespace:string,name:string,field:string>>>>>>"
    rows = lineage.where("column_lineage_json is not null").select(F.explode(F.from_json("column_lineage_json", facet)).alias("target", "f"))
    rows = rows.select("target", F.explode("f.fields").alias("target_column", "g")).select("target", "target_column", F.explode("g.inputFields").alias("x"))
    return rows.select(F.col("x.name").alias("source"), F.col("x.field").alias("source_column"), "target", "target_column")


def frame_column_edges(frames: DataFrame) -> DataFrame:
    """From column mappings of DataFrame operations: keys and values are frame.column."""
    rows = frames.where("column_lineage is not null").select(F.explode(F.from_json("column_lineage", "struct<column_mapping:map<string,array<string>>>")["column_mapping"]).alias("t", "s"))
    rows = rows.select("t", F.explode("s").alias("s"))
    part = lambda c, k: F.get(F.split(c, r"\."), F.lit(k))
    return rows.select(part("s", 0).alias("source"), part("s", 1).alias("source_column"), part("t", 0).alias("target"), part("t", 1).alias("target_column"))


def frame_edges(frames: DataFrame) -> DataFrame:
    """source, target: each input frame of an operation to each output frame."""
    named = "array<struct<variable_name:string>>"
    rows = frames.select(F.from_json("input_dataframes", named)["variable_name"].alias("i"), F.from_json("output_dataframes", named)["variable_name"].alias("o"))
    return rows.select(F.explode("i").alias("source"), "o").select("source", F.explode("o").alias("target"))


#: Rounds of an edge each before chains are passed in one.
SHALLOW = 12


def _spread(found: list[DataFrame], edges: DataFrame, max_depth: int | None, rounds: int | None) -> tuple[list[DataFrame], DataFrame]:
    """Follows edges (source, target, weight) from the last of `found` (seed, node, depth), a written table a round that holds what is new or nearer than before. Returns all of them, and the last that was written."""
    front, turn = found[-1], 0
    while rounds is None or turn < rounds:
        near = front.join(edges, front["node"] == edges["source"]).select("seed", F.col("target").alias("node"), (F.col("depth") + F.col("weight")).alias("depth"))
        near = near.where(F.col("depth") <= max_depth) if max_depth is not None else near
        near = near.groupBy("seed", "node").agg(F.min("depth").alias("depth"))
        known = reduce(DataFrame.unionByName, found).groupBy("seed", "node").agg(F.min("depth").alias("known"))
        front = settled(near.join(known, ["seed", "node"], "left").where("known is null or depth < known").select("seed", "node", "depth"), "found")
        if not front.limit(1).count():
            return found, front
        found, turn = [*found, front], turn + 1
    return found, front


#: With a seed to this many edges or more of them, pairs are made by level of the node, if the graph has levels.
EDGES_A_SEED = 20
#: Levels that are looked for at most; a round that takes off less than a hundredth of the edges ends the search, too.
LEVELS = 64


def _levels(edges: DataFrame) -> list[DataFrame] | None:
    """edges: source, target. Nodes with edges out by level (edges of the longest way to them), a written table (node) each, none for no edges; None for graphs with cycles, and for those that are too deep."""
    left, found = edges.select("source", "target"), []
    n = left.count()
    while n:
        ready = settled(left.select(F.col("source").alias("node")).distinct().join(left.select(F.col("target").alias("node")), "node", "left_anti"), "level")
        left = settled(left.join(ready.select(F.col("node").alias("source")), "source", "left_anti").select("source", "target"), "left")
        found, before, n = [*found, ready], n, left.count()
        if n and (len(found) == LEVELS or n * 100 > before * 99):
            return None
    return found


#: Nodes of a set of what a node reaches that may stand in one row; of larger graphs sets are in more rows.
MOST_NODES = 1 << 20


def _of_seeds(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Edges of a graph without cycles that a way from a seed goes over: nodes without edges in that are no seeds go, until there are none."""
    while True:
        lost = settled(edges.select("source").distinct().join(edges.select(F.col("target").alias("source")), "source", "left_anti").join(start.select(F.col("seed").alias("source")), "source", "left_anti"), "lost")
        if not lost.limit(1).count():
            return edges
        edges = settled(edges.join(lost, "source", "left_anti").select("source", "target", "weight"), "edges")


def _by_level(edges: DataFrame, start: DataFrame, levels: list[DataFrame], max_depth: int | None) -> DataFrame:
    """closure over a graph without cycles. From the last level to the first: what a node reaches is a list, made once when all nodes after it have theirs, and goes
    as a whole against each edge to the node before, where it waits in a folder of that node's level. So pairs aren't dealt over tasks one by one, and nothing found before is read again. Nodes without edges in come last; their pairs are never in lists."""
    spark, path = edges.sparkSession, f"{shared_dir(edges.sparkSession)}/ways-{uuid.uuid4().hex}"
    kinds = {f.name: f.dataType for f in edges.schema}
    edges = _of_seeds(edges, start)
    edges = edges if max_depth is None else edges.where(F.col("weight") <= max_depth)
    n = edges.count()
    if not n:
        return edges.select(F.col("source").alias("seed"), F.col("target").alias("node"), F.col("weight").alias("depth"))
    # Nodes without edges out, at -1, lead nowhere.
    level = settled(reduce(DataFrame.unionByName, (df.withColumn("at", F.lit(k)) for k, df in enumerate(levels))), "levels")
    into = edges.join(level.withColumnRenamed("node", "source"), "source").join(level.withColumnsRenamed({"node": "target", "at": "from"}), "target", "left").withColumn("from", F.coalesce("from", F.lit(-1)))
    into.select("source", "target", "weight", "at", "from").write.partitionBy("from").parquet(f"{path}/edges")
    of_edges = StructType([StructField("source", kinds["source"]), StructField("target", kinds["target"]), StructField("weight", IntegerType()), StructField("at", IntegerType())])
    one = StructType([StructField("node", kinds["target"]), StructField("depth", IntegerType())])
    of_ways = StructType([StructField("source", kinds["source"]), StructField("part", IntegerType()), StructField("more", IntegerType()), StructField("nodes", ArrayType(one))])
    part = F.pmod(F.xxhash64("target"), F.lit(1 + n // MOST_NODES)).cast("int").alias("part")
    first = spark.read.schema(of_edges.add("from", IntegerType())).parquet(f"{path}/edges")
    first.select("source", part, F.col("weight").alias("more"), F.array(F.struct(F.col("target").alias("node"), F.lit(0).alias("depth"))).alias("nodes"), "at").write.partitionBy("at").parquet(f"{path}/ways/to=first")

    def nearest(k: int) -> DataFrame | None:
        """source, part, node, depth of nodes of a level; rows of the same source and part are in one task."""
        try:
            came = spark.read.schema(of_ways).parquet(f"{path}/ways/to=*/at={k}")
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return None
        came = came.repartition("source", "part") if k else came.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(came.inputFiles())), "source", "part")
        one_by_one = came.select("source", "part", "more", F.explode("nodes").alias("x")).select("source", "part", F.col("x.node").alias("node"), (F.col("x.depth") + F.col("more")).alias("depth"))
        return (one_by_one if max_depth is None else one_by_one.where(F.col("depth") <= max_depth)).groupBy("source", "part", "node").agg(F.min("depth").alias("depth"))

    found = []
    for k in range(len(levels) - 1, 0, -1):
        here = nearest(k)
        if here is None:  # no seed leads there
            continue
        here = settled(here.groupBy(F.col("source").alias("target"), "part").agg(F.collect_list(F.struct("node", "depth")).alias("nodes")), "found")
        found.append(here.join(start.select(F.col("seed").alias("target")), "target", "left_semi").select(F.col("target").alias("seed"), F.inline("nodes")))
        to = first.where(F.col("from") == k)
        here.join(to, "target").select("source", "part", F.col("weight").alias("more"), "nodes", "at").write.partitionBy("at").parquet(f"{path}/ways/to={k}")
    last = nearest(0)
    found = found if last is None else [*found, last.select(F.col("source").alias("seed"), "node", "depth")]
    return reduce(DataFrame.unionByName, found)


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """seeds: node. Returns seed, node, depth for all that edges (source, target; weight, if there, else 1 each) reach; depth is the shortest way. Cycles end by themselves. max_depth: how far to look (None: all the way).

    Only what the seeds reach is written, a table a round. Each round reads the edges, so give a stored table. Ways of more than SHALLOW
    edges go on over a graph whose chains (nodes with one edge in and one out) are single edges, found by pointer doubling over those nodes;
    what lies inside the chains that were passed is added in the end. So rounds grow with the branchings on a way, not with its length.

    Of many seeds in a graph without cycles and not too deep, pairs are made by level instead."""
    named = edges.select("source", "target", (F.col("weight") if "weight" in edges.columns else F.lit(1)).cast("int").alias("weight")).where("source is not null and target is not null")
    start = seeds.select(F.col("node").alias("seed")).distinct()
    if start.count() * EDGES_A_SEED >= named.count():
        start, single = settled(start, "seeds"), settled(named.groupBy("source", "target").agg(F.min("weight").alias("weight")), "edges")
        levels = _levels(single)
        if levels is not None:
            return _by_level(single, start, levels, max_depth)
    first = start.join(named, start["seed"] == named["source"]).groupBy("seed", F.col("target").alias("node")).agg(F.min("weight").alias("depth"))
    found, front = _spread([settled(first if max_depth is None else first.where(F.col("depth") <= max_depth), "found")], named, max_depth, SHALLOW)
    if front.limit(1).count():
        one = settled(named.where("source <> target").groupBy("source", "target").agg(F.min("weight").alias("weight")), "edges")
        links = chain_links(one, front.select("node").distinct())
        # Steps count nodes; weights need the way's sum, so only chains of edges of weight one are passed at once.
        uneven = one.where("weight <> 1").select(F.explode(F.array("source", "target")).alias("node")).join(links, "node").select("last").distinct()
        links = links.where("ended").join(uneven, "last", "left_anti")
        chain = settled(bypassed(one, links).withColumn("all", F.col("steps") + 2), "chains")
        inner = settled(links.join(chain.select("last", "u", F.col("steps").alias("whole")), "last").select("node", "u", (1 + F.col("whole") - F.col("steps")).cast("int").alias("far")), "inside")
        gone = inner.select(F.col("node").alias("source"))
        plain = one.join(gone, "source", "left_anti").join(gone.select(F.col("source").alias("target")), "target", "left_anti").select("source", "target", "weight")
        short = settled(plain.unionByName(chain.select(F.col("u").alias("source"), F.col("w").alias("target"), F.col("all").cast("int").alias("weight"))), "edges")
        found, _ = _spread(found, short, max_depth, None)
        passed = reduce(DataFrame.unionByName, found).join(inner.select("u", F.col("node").alias("inside"), "far"), F.col("node") == F.col("u")).select("seed", F.col("inside").alias("node"), (F.col("depth") + F.col("far")).alias("depth"))
        found = [*found, passed if max_depth is None else passed.where(F.col("depth") <= max_depth)]
    return reduce(DataFrame.unionByName, found).groupBy("seed", "node").agg(F.min("depth").alias("depth"))


def closure_sql(edges: DataFrame, seeds: DataFrame, max_depth: int = 50) -> DataFrame:
    """closure by one recursive SQL statement, for shallow graphs: ways of up to max_depth edges are listed, cycles gone round until then. Nothing is written between rounds, but a node that many ways lead to comes once for each depth at which it is met."""
    spark = edges.sparkSession
    sql = """WITH RECURSIVE r(seed, node, depth) MAX RECURSION LEVEL {levels} AS (
 SELECT DISTINCT s.node, e.target, 1 FROM {seeds} s JOIN {edges} e ON s.node = e.source
 UNION ALL SELECT r.seed, e.target, r.depth + 1 FROM r JOIN {edges} e ON r.node = e.source WHERE r.depth < {most})
 SELECT seed, node, min(depth) AS depth FROM r GROUP BY seed, node LIMIT ALL"""
    own = edges.select("source", "target").where("source is not null and target is not null").distinct()
    return spark.sql(sql, levels=max_depth + 1, most=max_depth, seeds=seeds.select("node").distinct(), edges=own)


def upstream(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    return closure(edges.select(F.col("target").alias("source"), F.col("source").alias("target")), seeds, max_depth)


def impact(edges: DataFrame, changed: DataFrame, max_depth: int | None = None) -> DataFrame:
    """How many nodes lie downstream of each changed one, and how far."""
    return closure(edges, changed, max_depth).groupBy("seed").agg(F.count("*").alias("n_nodes"), F.max("depth").alias("max_depth"))


def column_graph(lineage: DataFrame, frames: DataFrame) -> DataFrame:
    """source, target (structs of name and column; column is empty for a dataset or frame as a whole) and weight: columns to the columns made of them, columns to what holds them (no step), and datasets and frames to those made of them."""
    node = lambda name, column: F.struct(F.col(name).alias("name"), (F.col(column) if column else F.lit("")).alias("column"))
    columns = column_edges(lineage).unionByName(frame_column_edges(frames))
    steps = columns.select(node("source", "source_column").alias("source"), node("target", "target_column").alias("target"), F.lit(1).alias("weight"))
    holds = columns.select(node("target", "target_column").alias("source"), node("target", None).alias("target"), F.lit(0).alias("weight"))
    whole = dataset_edges(lineage).select("source", "target").unionByName(frame_edges(frames)).select(node("source", None).alias("source"), node("target", None).alias("target"), F.lit(1).alias("weight"))
    return steps.unionByName(holds).unionByName(whole).distinct()


def column_impact(lineage: DataFrame, frames: DataFrame, changed: DataFrame, max_depth: int | None = None) -> DataFrame:
    """changed: name, column. What a changed column can alter: seed_name, seed_column, name, column (empty: a dataset or frame as a whole) and depth in steps.

    Columns are followed by column lineage; a dataset is touched if it holds a column that is, or is made of a dataset that is."""
    graph = settled(column_graph(lineage, frames), "columns")
    reached = closure(graph, changed.select(F.struct("name", "column").alias("node")), max_depth)
    return reached.select(F.col("seed.name").alias("seed_name"), F.col("seed.column").alias("seed_column"), "node.name", "node.column", "depth")


def in_cycles(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves, and the component (named by its least node) in which all reach each other."""
    return strong_components(edges)


def degrees(edges: DataFrame) -> DataFrame:
    """node, n_in, n_out and role (root: nothing flows in; leaf: nothing flows out; inner) over distinct edges."""
    e = edges.select("source", "target").distinct()
    both = e.select(F.col("source").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(e.select(F.col("target").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    out = both.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    return out.withColumn("role", F.when(F.col("n_in") == 0, "root").when(F.col("n_out") == 0, "leaf").otherwise("inner"))


def chain_metrics(reached: DataFrame, frames_view: DataFrame) -> DataFrame:
    """Rows, time and size along what each seed reaches, by the operations that made those frames."""
    ops = frames_view.select(F.col("output_variable").alias("node"), "input_rows", "output_rows", "overhead_ms", "df_size_mb")
    out = reached.select("seed", "node").join(ops, "node").groupBy("seed").agg(F.count("*").alias("n_operations"), F.sum("input_rows").alias("rows_in"), F.sum("output_rows").alias("rows_out"), F.sum("overhead_ms").alias("overhead_ms"), F.max("df_size_mb").alias("max_mb"))
    return out.withColumn("retention", F.when(F.col("rows_in") > 0, F.col("rows_out") / F.col("rows_in")))


def operation_costs(frames_view: DataFrame, performance: DataFrame) -> DataFrame:
    """Operations of W3 with what W2 knows of their executions: source, target, rows_in, rows_out, time_ms (the execution's and the operation's own) and memory_mb. Of several operations between two frames the slowest stands."""
    runs = performance.groupBy("execution_id").agg(F.max("runtime_duration_ms").alias("ms"), F.max("memory_delta_mb").alias("memory_mb"))
    ops = frames_view.where("input_variable is not null and output_variable is not null").join(runs, "execution_id", "left")
    cost = F.struct((F.coalesce("ms", F.lit(0.0)) + F.coalesce("overhead_ms", F.lit(0.0))).alias("time_ms"), F.col("input_rows").alias("rows_in"), F.col("output_rows").alias("rows_out"), "memory_mb")
    return ops.groupBy(F.col("input_variable").alias("source"), F.col("output_variable").alias("target")).agg(F.max(cost).alias("c")).select("source", "target", "c.*")


def chain_costs(costs: DataFrame, seeds: DataFrame) -> DataFrame:
    """The slowest way from each seed (node) to each node that it reaches: seed, node, length, rows_in (of its first operation), rows_out (of its last), retention (product of rows out by rows in; null where an input was empty), time_ms (sum) and memory_mb (greatest).

    Programming by topological level: a node's ways are made when all nodes before it have theirs, so each pair is made once and no way is listed.
    Ways don't go round cycles: edges inside a strongly connected component are left out. Rounds grow with the longest way."""
    parts = settled(strong_components(costs.select("source", "target")), "components")
    a, b = (parts.select(F.col("node").alias(c), F.col("component").alias(f"in_{c}")) for c in ("source", "target"))
    edges = costs.join(a, "source", "left").join(b, "target", "left").where("in_source is null or in_target is null or in_source <> in_target").drop("in_source", "in_target")
    edges = settled(edges.withColumn("kept", F.expr("CASE WHEN rows_in > 0 THEN rows_out / rows_in END")), "edges")
    start = settled(seeds.select("node").distinct(), "seeds")
    left, ways = edges.select("source", "target"), []
    best = lambda: reduce(DataFrame.unionByName, ways).groupBy("seed", "node").agg(F.max("w").alias("w"))
    while True:
        # Nodes of this level: they have edges left, but none into them, so all their ways are made.
        ready = settled(left.select(F.col("source").alias("node")).distinct().join(left.select(F.col("target").alias("node")), "node", "left_anti"), "level")
        if not ready.limit(1).count():
            break
        out = edges.join(ready, edges["source"] == ready["node"]).drop("node")
        fresh = out.join(start, out["source"] == start["node"]).select(F.col("source").alias("seed"), "target", F.struct("time_ms", F.lit(1).alias("length"), F.col("kept").alias("retention"), "rows_in", "rows_out", "memory_mb").alias("w"))
        if ways:
            longer = best().join(ready, "node").join(out.select("source", "target", F.struct("time_ms", "kept", "rows_out", "memory_mb").alias("e")), F.col("node") == F.col("source"))
            grown = F.struct((F.col("w.time_ms") + F.col("e.time_ms")).alias("time_ms"), (F.col("w.length") + 1).alias("length"), (F.col("w.retention") * F.col("e.kept")).alias("retention"), F.col("w.rows_in").alias("rows_in"), F.col("e.rows_out").alias("rows_out"), F.greatest("w.memory_mb", "e.memory_mb").alias("memory_mb"))
            fresh = fresh.unionByName(longer.select("seed", "target", grown.alias("w")))
        ways.append(settled(fresh.groupBy("seed", F.col("target").alias("node")).agg(F.max("w").alias("w")), "ways"))
        left = settled(left.join(ready.select(F.col("node").alias("source")), "source", "left_anti").select("source", "target"), "left")
    if not ways:  # no edge
        none = F.struct(*(F.lit(None).cast(t).alias(c) for c, t in (("time_ms", "double"), ("length", "int"), ("retention", "double"), ("rows_in", "long"), ("rows_out", "long"), ("memory_mb", "double"))))
        ways.append(start.select(F.col("node").alias("seed"), "node", none.alias("w")).limit(0))
    return best().select("seed", "node", "w.length", "w.rows_in", "w.rows_out", "w.retention", "w.time_ms", "w.memory_mb")
