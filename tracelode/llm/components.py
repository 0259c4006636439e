"""Connected components of an edge table by alternating large and small stars, a written table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _least(edges: DataFrame) -> DataFrame:
    """k, a node, and m, the least of its neighbours. The node is an aggregate, too, so that a join on it exchanges both of its sides: Spark can then split a node that holds many edges."""
    return edges.groupBy("a").agg(F.min("a").alias("k"), F.min("b").alias("m")).select("k", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.where("b > a").join(_least(both), F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.least("k", "m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down)
    moved = down.join(least, F.col("a") == F.col("k")).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b of any ordered type, a != b. Returns node and root (the least node of its component) for every node that has an edge.

    A round's cost is in proportion to the edges; rounds grow with the logarithm of the longest path. Nothing but a digest of the edges passes the driver."""
    now, before = edges, None
    while True:
        now = materialise(_small_star(_large_star(now)), "stars")
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
