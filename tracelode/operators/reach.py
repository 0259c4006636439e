"""Reachability labels: stored once for a graph, they answer for any number of pairs whether one node reaches the other.

Nodes of a strongly connected component share a label; over components edges go one way only. A label holds the height
(edges of the longest way to an end) and, for each of HASHES hash functions, the least hash of all that the node reaches and
of itself. Who reaches another is higher than it, and holds no greater least hash, as it reaches all that the other does.
Pairs that fail this are told at once; for the others a search runs from the first node that goes on only over nodes whose
labels may reach the second.

Labels are made from the ends upwards, a written table a height, so rounds grow with the longest way between components.
Sides of joins follow the edges or the pairs, so both are dealt over tasks, as for components.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import settled
from .components import _dealt, strong_components

HASHES = 4
_LEAST = [f"least{k}" for k in range(HASHES)]


def labels(edges: DataFrame) -> DataFrame:
    """node, component (null off cycles), height and least hashes of every node of edges (source, target). Null ends count for nothing."""
    every = settled(edges.select("source", "target").where("source is not null and target is not null").distinct(), "edges")
    parts = settled(strong_components(every), "components")
    nodes = every.select(F.col("source").alias("node")).union(every.select("target")).distinct().join(_dealt(parts), "node", "left").withColumn("name", F.coalesce("component", "node"))
    nodes = settled(nodes, "nodes")
    of = lambda end: nodes.select(F.col("node").alias(end), F.col("name").alias(f"of_{end}"))
    up = every.join(_dealt(of("source")), "source").join(_dealt(of("target")), "target").where("of_source <> of_target").select(F.col("of_source").alias("source"), F.col("of_target").alias("target")).distinct()
    up = settled(up, "upwards")
    own = nodes.groupBy("name").agg(F.lit(0).alias("height"), *(F.min(F.xxhash64("node", F.lit(k))).alias(c) for k, c in enumerate(_LEAST)))
    own = settled(own.join(_dealt(up.select(F.col("source").alias("name")).distinct().withColumn("up", F.lit(True))), "name", "left").withColumn("n_open", F.when(F.col("up"), 1).otherwise(0)).drop("up"), "names")
    last, waiting, left, done = own.where("n_open = 0").drop("n_open"), own.where("n_open > 0"), up, []
    while True:
        done.append(last)
        # Edges to those labelled last bring what these reach; who has no other edge left is labelled next.
        met = settled(left.join(_dealt(last.withColumnRenamed("name", "target")), "target", "left").select("source", "target", "height", *_LEAST), "met")
        come = met.select(F.col("source").alias("name"), (F.col("height") + 1).alias("height"), *_LEAST, F.col("height").isNull().cast("int").alias("n_open"))
        known = waiting.withColumn("n_open", F.lit(0)).unionByName(come).groupBy("name").agg(F.max("height").alias("height"), *(F.min(c).alias(c) for c in _LEAST), F.sum("n_open").alias("n_open"))
        known = settled(known, "waiting")
        last, waiting, left = known.where("n_open = 0").drop("n_open"), known.where("n_open > 0"), met.where("height is null").select("source", "target")
        if not last.limit(1).count():
            break
    return nodes.join(_dealt(reduce(DataFrame.unionByName, done)), "name").select("node", "component", "height", *_LEAST)


def _may(a: str, b: str) -> Column:
    """Whether the labels of a (a column's prefix) let it reach b, another component."""
    return reduce(Column.__and__, (F.col(f"{a}_{c}") <= F.col(f"{b}_{c}") for c in _LEAST), F.col(f"{a}_height") > F.col(f"{b}_height"))


def reaches(edges: DataFrame, known: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs: a, b. Adds reaches: whether edges lead from a to b, by one edge at least. known: labels of the edges. Pairs with unknown or null ends don't."""
    named = lambda side: known.select(F.col("node").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("component", "height", *_LEAST)))
    asked = settled(pairs.select("a", "b").distinct().join(_dealt(named("a")), "a").join(_dealt(named("b")), "b"), "asked")
    same = F.coalesce(F.col("a_component") == F.col("b_component"), F.lit(False))
    found = [asked.where(same).select("a", "b")]
    to = [f"b_{c}" for c in ("component", "height", *_LEAST)]
    front = settled(asked.where(~same & _may("a", "b")).select("a", "b", F.col("a").alias("node"), *to), "front")
    seen = [front.select("a", "b", "node")]
    e = edges.select(F.col("source").alias("node"), F.col("target").alias("n")).where("node is not null and n is not null")
    e = settled(e.join(_dealt(named("n")), "n"), "edges")
    while front.limit(1).count():
        met = front.join(_dealt(e), "node").select("a", "b", *to, F.col("n").alias("node"), *(c for c in e.columns if c not in ("node", "n")))
        there = (F.col("node") == F.col("b")) | F.coalesce(F.col("n_component") == F.col("b_component"), F.lit(False))
        # Nodes of the component of the node before are as high as it, and lie on the way, too.
        onward = met.where(~there & _may("n", "b")).select("a", "b", "node", *to).distinct().join(_dealt(reduce(DataFrame.unionByName, seen)), ["a", "b", "node"], "left_anti")
        arrived = settled(met.where(there).select("a", "b").distinct(), "arrived")
        front = settled(onward.join(_dealt(arrived), ["a", "b"], "left_anti"), "front")
        found, seen = [*found, arrived], [*seen, front.select("a", "b", "node")]
    yes = reduce(DataFrame.unionByName, found).distinct().select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.lit(True).alias("_yes"))
    return pairs.join(_dealt(yes), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left").select(*pairs.columns, F.coalesce("_yes", F.lit(False)).alias("reaches"))
