"""Lineage as a graph, against plain searches in Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests import compare
from tracelode.operators import graph, reach
from tracelode.operators.components import strong_components
from tracelode.plans import registry as engine

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["strong_components", "lineage_reach", "column_impact", "chain_costs", "labelled_reach"])
def test_query_equals_sql(spark, name):
    assert compare.spark_rows(engine.QUERIES[name](spark, SF)) == compare.sql_rows(SF, engine.SQL[name])


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "source long, target long")


def reached(pairs, seed):
    out, front, depth = {}, [seed], 0
    after = defaultdict(set)
    for a, b in pairs:
        after[a].add(b)
    while front:
        depth += 1
        front = sorted({y for x in front for y in after[x]} - set(out))
        out |= dict.fromkeys(front, depth)
    return out


def components(pairs):
    far = {a: reached(pairs, a) for a in {a for a, _ in pairs}}
    return {a: min(b for b in far[a] if a in far.get(b, ())) for a in far if a in far[a]}


CHAINS = [(100 + i, 101 + i) for i in range(15)] + [(115, 3), (5, 100)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(300, 300), (400, 401), (401, 400), (401, 402), (402, 403), (403, 402)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_graphs(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randrange(30), r.randrange(30)) for _ in range(33)] + CHAINS
    df = edges(spark, pairs + pairs[:5] + [(None, 1), (2, None)])
    assert {x.node: x.component for x in strong_components(df).collect()} == components(pairs)


def test_components_of_a_long_ring_beside_trunks(spark):
    """No closure: a ring of 10^5 nodes, a chain as long out of it, and a trunk of 10^4 nodes with a twig at each."""
    n = 100_000
    ring = spark.range(n).selectExpr("id AS source", f"(id + 1) % {n} AS target")
    tail = spark.range(n).selectExpr("id + 200000 AS source", "id + 200001 AS target")
    trunk = spark.range(10_000).selectExpr("inline(array(struct(id + 400000 AS source, id + 400001 AS target), struct(id + 400000 AS source, id + 500000 AS target)))")
    df = ring.unionByName(tail).unionByName(trunk).unionByName(edges(spark, [(7, 200_000), (500_000, 3)]))
    assert strong_components(df).groupBy("component").count().collect() == [(0, n)]


def test_components_of_nothing(spark):
    assert strong_components(edges(spark, [])).count() == 0 and strong_components(edges(spark, [(1, 2), (2, 3)])).count() == 0


@pytest.mark.parametrize("depth", [None, 21])
def test_closure_over_chains_and_cycles(spark, depth):
    r = random.Random(5)
    pairs = [(r.randrange(40), r.randrange(40)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)] + [(140, 3), (5, 100), (120, 120)] + [(200 + i, 201 + i) for i in range(30)] + [(110, 200), (230, 110)]
    seeds = [0, 5, 105, 200]
    got = {(x.seed, x.node): x.depth for x in graph.closure(edges(spark, pairs), spark.createDataFrame([(s,) for s in seeds], "node long"), depth).collect()}
    assert got == {(s, n): d for s in seeds for n, d in reached(pairs, s).items() if depth is None or d <= depth}


def test_closure_with_weights(spark):
    """A longer way of lesser weight wins, though it comes later."""
    df = spark.createDataFrame([(1, 2, 5), (1, 3, 1), (3, 4, 0), (4, 2, 1), (2, 5, 1)] + [(5 + i, 6 + i, 2 if i == 7 else 1) for i in range(30)], "source long, target long, weight int")
    got = {x.node: x.depth for x in graph.closure(df, spark.createDataFrame([(1,)], "node long")).collect()}
    assert got == {3: 1, 4: 1, 2: 2, 5: 3} | {6 + i: 4 + i + (i >= 7) for i in range(30)}


def test_closure_writes_what_its_seed_reaches(spark, monkeypatch):
    """One seed in a graph of 10^6 edges: no more rows are written than it reaches."""
    n = 250_000
    df = spark.range(n).selectExpr("inline(transform(sequence(1, 4), k -> struct(id AS source, id * 4 + k AS target)))")
    written = []
    settled = graph.settled
    monkeypatch.setattr(graph, "settled", lambda d, name: written.append(settled(d, name)) or written[-1])
    got = graph.closure(df, spark.createDataFrame([(20_000,)], "node long")).count()
    assert df.count() == 4 * n and got == len(reached([(a, a * 4 + k) for a in (20_000, *range(80_001, 80_005)) for k in range(1, 5)], 20_000)) == sum(w.count() for w in written)


def test_chain_costs_take_the_slowest_way(spark):
    """Two ways of which the one with more operations is slower; a cycle is not gone round; an empty input has no retention."""
    rows = [("a", "b", 10, 5, 1.0, 2.0), ("b", "d", 5, 4, 1.0, None), ("a", "c", 10, 9, 5.0, 1.0), ("c", "d", 9, 9, 0.5, 7.0), ("d", "e", 0, 3, 1.0, 1.0), ("e", "f", 3, 3, 1.0, 1.0), ("f", "e", 3, 3, 9.0, 1.0), ("f", "g", 3, 1, 1.0, 1.0)]
    costs = spark.createDataFrame(rows, "source string, target string, rows_in long, rows_out long, time_ms double, memory_mb double")
    seed = spark.createDataFrame([("a",), ("nowhere",)], "node string")
    got = {(r.seed, r.node): tuple(r)[2:] for r in graph.chain_costs(costs, seed).collect()}
    assert got[("a", "d")] == (2, 10, 9, 0.9, 5.5, 7.0) and got[("a", "b")] == (1, 10, 5, 0.5, 1.0, 2.0) and got[("a", "e")] == (3, 10, 3, None, 6.5, 7.0)
    assert set(got) == {("a", x) for x in "bcde"}  # what comes after lies on the cycle, or behind it
    assert graph.chain_costs(costs.limit(0), seed).count() == 0


def test_labels_tell_all_pairs(spark):
    """Every pair of a random graph with cycles, chains and loops; pairs of unknown nodes and nulls reach nothing."""
    r = random.Random(3)
    pairs = [(r.randrange(24), r.randrange(24)) for _ in range(26)] + [(100 + i, 101 + i) for i in range(4)] + [(104, 3), (5, 100), (300, 300), (400, 401), (401, 400), (401, 402)]
    nodes = sorted({x for p in pairs for x in p})
    df = edges(spark, pairs + [(None, 1)])
    asked = spark.createDataFrame([(a, b) for a in nodes for b in nodes] + [(1, 999), (None, 1), (1, None)], "a long, b long")
    got = {(x.a, x.b): x.reaches for x in reach.reaches(df, reach.labels(df), asked).collect()}
    far = {a: reached(pairs, a) for a in nodes}
    assert got == {(a, b): b in far[a] for a in nodes for b in nodes} | {(1, 999): False, (None, 1): False, (1, None): False}
