"""Strongly connected components of an edge table (source, target), without any closure.

Nodes without edges in or out lie on no cycle and are trimmed; so are trees that hang from them, of any depth. A chain, nodes with one edge in and one out, is replaced by
one edge from the node before it to the node after it; where it ends is found by pointer doubling, so its length costs only
its logarithm in rounds, and a ring that is nothing but a chain is told by the least node that doubling has met. What is
left is coloured: each node takes the greatest node that reaches it, and those that reach their colour's node inside the
colour are a component of it. Components go, and all starts anew. In the end chains are put back, the last one first: their
nodes belong to a component if the nodes before and after belong to the same one.

A round's cost is in proportion to the edges left. Rounds grow with the logarithm of chains and with the longest way through
what trimming and chains leave, as colours and frontiers move by an edge a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import settled


def _dealt(df: DataFrame) -> DataFrame:
    """A side of a join whose size follows the edges: both sides are dealt over tasks, and none is collected by the driver to be sent out whole."""
    return df.hint("merge")


def _ends(edges: DataFrame) -> DataFrame:
    """node, n_in, n_out of distinct edges."""
    both = edges.select(F.col("source").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("target").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return both.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def chain_links(edges: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
    """edges: distinct, no loops. A row for each node with one edge in and one out (but for `fixed`, node): node, last (of its chain), steps to it, least node met, ended (false: on a ring of such nodes)."""
    inner = _ends(edges).where("n_in = 1 and n_out = 1").select("node")
    inner = settled(inner if fixed is None else inner.join(_dealt(fixed), "node", "left_anti"), "inner")
    after = edges.join(_dealt(inner), edges["source"] == inner["node"]).select("node", "target").join(_dealt(inner.select(F.col("node").alias("next"))), F.col("target") == F.col("next"), "left")
    links = after.select("node", F.coalesce("next", "node").alias("last"), F.col("next").isNotNull().cast("long").alias("steps"), F.least("node", F.coalesce("next", "node")).alias("least"), F.col("next").isNull().alias("ended"))
    links, reach = settled(links, "links"), 1
    going = links.where("not ended").count()
    while going:
        far = links.select(F.col("node").alias("at"), F.col("last").alias("to"), F.col("steps").alias("more"), F.col("least").alias("other"), F.col("ended").alias("end"))
        moved = links.where("not ended").join(_dealt(far), F.col("last") == F.col("at")).select("node", F.col("to").alias("last"), (F.col("steps") + F.col("more")).alias("steps"), F.least("least", "other").alias("least"), F.col("end").alias("ended"))
        links, reach = settled(links.where("ended").unionByName(moved), "links"), reach * 2
        before, going = going, links.where("not ended").count()
        if going == before and reach >= going:  # rings, gone round once
            break
    return links


def bypassed(edges: DataFrame, links: DataFrame) -> DataFrame:
    """last, first, u, w, steps: each chain's nodes at its ends, the nodes before and after it, and the steps from first to last."""
    on = links.where("ended")
    begin = edges.join(_dealt(links.select(F.col("node").alias("source"))), "source", "left_anti").join(_dealt(on), F.col("target") == F.col("node")).select("last", F.col("node").alias("first"), F.col("source").alias("u"), "steps")
    stop = edges.join(_dealt(on.where("node = last").select("last")), F.col("source") == F.col("last")).select("last", F.col("target").alias("w"))
    return begin.join(_dealt(stop), "last")


def _without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that touch none of the nodes."""
    return edges.join(_dealt(nodes.select(F.col("node").alias("source"))), "source", "left_anti").join(_dealt(nodes.select(F.col("node").alias("target"))), "target", "left_anti").select("source", "target")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges whose source has an edge in and whose target has one out: no other lies on a cycle."""
    kept = edges.join(_dealt(edges.select(F.col("source").alias("target"))), "target", "left_semi").join(_dealt(edges.select(F.col("target").alias("source"))), "source", "left_semi")
    return settled(kept.select("source", "target"), "edges")


def _dangling(edges: DataFrame) -> DataFrame:
    """Nodes from which the way back, over nodes with one edge in, ends at a node with none: they lie on no cycle, however many edges lead out of them. Found by pointer doubling, so long trunks cost few rounds."""
    ends = settled(_ends(edges).where("n_in < 2").select("node", "n_in"), "ends")
    back = ends.join(_dealt(edges), ends["node"] == edges["target"], "left").join(_dealt(ends.select(F.col("node").alias("next"))), F.col("source") == F.col("next"), "left")
    links = settled(back.select("node", F.coalesce("next", "node").alias("last"), (F.col("n_in") == 0).alias("dead"), F.col("next").isNull().alias("ended")), "links")
    going, reach = links.where("not ended").count(), 1
    while going:
        far = links.select(F.col("node").alias("at"), F.col("last").alias("to"), F.col("dead").alias("gone"), F.col("ended").alias("end"))
        moved = links.where("not ended").join(_dealt(far), F.col("last") == F.col("at")).select("node", F.col("to").alias("last"), F.col("gone").alias("dead"), F.col("end").alias("ended"))
        links, reach = settled(links.where("ended").unionByName(moved), "links"), reach * 2
        before, going = going, links.where("not ended").count()
        if going == before and reach >= going:
            break
    return links.where("dead").select("node")


def _coloured(edges: DataFrame) -> DataFrame:
    """node and colour: the greatest node that reaches it, itself included."""
    colour, changed = settled(_ends(edges).select("node", F.col("node").alias("colour")), "colours"), 1
    while changed:
        come = edges.join(_dealt(colour), edges["source"] == colour["node"]).groupBy(F.col("target").alias("node")).agg(F.max("colour").alias("come"))
        step = settled(colour.join(_dealt(come), "node", "left").select("node", F.greatest("colour", F.coalesce("come", "colour")).alias("colour"), (F.col("come") > F.col("colour")).alias("changed")), "colours")
        colour, changed = step.select("node", "colour"), step.where("changed").limit(1).count()
    return colour


def _rooted(edges: DataFrame, colour: DataFrame) -> DataFrame:
    """node and colour of what reaches its colour's node inside the colour: whole components, those of one node included."""
    a, b = colour.select(F.col("node").alias("source"), "colour"), colour.select(F.col("node").alias("target"), F.col("colour").alias("same"))
    inside = settled(edges.join(_dealt(a), "source").join(_dealt(b), "target").where("colour = same").select("source", "target"), "inside")
    found = front = settled(colour.where("node = colour"), "rooted")
    while True:
        come = inside.join(_dealt(front.select(F.col("node").alias("target"), "colour")), "target").select(F.col("source").alias("node"), "colour").distinct()
        front = settled(come.join(_dealt(found), ["node", "colour"], "left_anti"), "front")
        if not front.limit(1).count():
            return found
        found = settled(found.unionByName(front), "rooted")


def strong_components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) of all nodes that lie on a cycle; an edge from a node to itself is one. Null ends count for nothing."""
    every = settled(edges.select("source", "target").where("source is not null and target is not null").distinct(), "edges")
    loop = lambda df, c: df.select(F.col(c).alias("node"))
    now, known, phases = every.where("source <> target"), [], [(None, None, loop(every.where("source = target"), "source"))]
    n = now.count()
    while n:
        now = _trimmed(_trimmed(now))
        links = chain_links(now)
        if links.limit(1).count():
            known.append(links.where("not ended").select("node", F.col("least").alias("component")))
            chain = settled(bypassed(now, links), "chains")
            phases.append((links.where("ended").select("node", "last"), chain, loop(chain.where("u = w"), "u").distinct()))
            now = settled(_without(now, links).unionByName(chain.where("u <> w").select(F.col("u").alias("source"), F.col("w").alias("target"))).distinct(), "edges")
        before, n = n, now.count()
        if n * 10 > before * 9:  # neither helps much: cut off trees, along their edges and against them
            turned = now.select(F.col("target").alias("source"), F.col("source").alias("target"))
            now = settled(_without(_without(now, _dangling(now)), _dangling(turned)), "edges")
            before, n = n, now.count()
        if n * 10 > before * 9:  # nor does that: find components
            rooted = settled(_rooted(now, _coloured(now)), "rooted")
            many = rooted.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1").select("colour")
            known.append(rooted.join(_dealt(many), "colour").select("node", F.col("colour").alias("component")))
            now = settled(_without(now, rooted), "edges")
            n = now.count()
    found = every.select(F.col("source").alias("node"), F.col("source").alias("component")).limit(0)
    for part in known:
        found = found.unionByName(part)
    for nodes, chain, loops in reversed(phases):
        found = found.unionByName(loops.join(_dealt(found), "node", "left_anti").select("node", F.col("node").alias("component")))
        if nodes is not None:
            found = settled(found, "components")
            u, w = (found.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in ("u", "w"))
            same = chain.join(_dealt(u), "u").join(_dealt(w), "w").where("of_u = of_w").select("last", F.col("of_u").alias("component"))
            found = found.unionByName(nodes.join(_dealt(same), "last").select("node", "component"))
    found = settled(found, "components")
    name = found.groupBy("component").agg(F.min("node").alias("least"))
    return found.join(_dealt(name), "component").select("node", F.col("least").alias("component"))
