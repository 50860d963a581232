"""Strongly connected groups of a directed edge list."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.operators.graph import connected_components
from tessera.scratch import materialize

SMALL, TRIMS = 500_000, 5


def _reach(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """(node, colour, low): smallest node of the same colour that reaches each node along the edges.

    What reaches a node's smallest reaches the node, so each round also takes that one's smallest: long paths take few rounds.
    """
    inside = edges.join(colours.select(F.col("node").alias("src"), F.col("colour").alias("cs")), "src").join(
        colours.select(F.col("node").alias("dst"), F.col("colour").alias("cd")), "dst"
    )
    inside = materialize(inside.where("cs = cd").select("src", "dst"), "inside")
    low = materialize(colours.withColumn("low", F.col("node")), "low")
    while True:
        step = inside.join(low.select(F.col("node").alias("src"), "low"), "src").groupBy("dst").agg(F.min("low").alias("near"))
        step = low.join(step.withColumnRenamed("dst", "node"), "node", "left").select("node", "colour", F.least("low", "near").alias("near"), "low")
        jump = low.select(F.col("node").alias("near"), F.col("low").alias("far"))
        step = materialize(step.join(jump, "near").select("node", "colour", F.least("near", "far").alias("new"), "low"), "low")
        low = step.select("node", "colour", F.col("new").alias("low"))
        if step.where("new <> low").isEmpty():
            return low


def _loops(ways: DataFrame) -> DataFrame:
    """(node, component) of the loops among nodes with one way in, of (node, up): the only node with an edge to each.

    A round doubles the steps of ``up`` and keeps the nodes that are still above another, so paths halve and what hangs on a loop is gone in few
    rounds, each on fewer rows. ``low`` is the smallest node on the way; where all nodes are kept and none changes, it has gone round.
    """
    table = materialize(ways.withColumn("low", F.col("node")), "ways")
    size = table.count()
    while True:
        above = table.join(table.select(F.col("up").alias("node")).distinct(), "node", "left_semi")
        jump = table.select(F.col("node").alias("up"), F.col("up").alias("far"), F.col("low").alias("beyond"))
        step = above.join(jump, "up").select("node", F.col("far").alias("up"), F.least("low", "beyond").alias("low"), (F.col("beyond") < F.col("low")).alias("lower"))
        step = materialize(step, "ways")
        before, size = size, step.count()
        if size == before and step.where("lower").isEmpty():
            return step.select("node", F.col("low").alias("component"))
        table = step.drop("lower")


def _tarjan(table: pa.Table) -> pa.Table:
    """(node, component) of the strongly connected groups of two or more nodes, of all edges at once."""
    onward: dict[int, list[int]] = {}
    for u, v in zip(table["src"].to_pylist(), table["dst"].to_pylist(), strict=True):
        onward.setdefault(u, []).append(v)
    order, low, held, stack, out = {}, {}, set(), [], []
    for start in onward:
        if start in order:
            continue
        work = [(start, iter(onward[start]))]
        order[start] = low[start] = len(order)
        stack.append(start)
        held.add(start)
        while work:
            node, rest = work[-1]
            for n in rest:
                if n not in order:
                    order[n] = low[n] = len(order)
                    stack.append(n)
                    held.add(n)
                    work.append((n, iter(onward.get(n, ()))))
                    break
                if n in held:
                    low[node] = min(low[node], order[n])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == order[node]:
                    group = [stack.pop()]
                    while group[-1] != node:
                        group.append(stack.pop())
                    held.difference_update(group)
                    if len(group) > 1:
                        out += [(n, min(group)) for n in group]
    return pa.table({"node": pa.array([n for n, _ in out], pa.int64()), "component": pa.array([c for _, c in out], pa.int64())})


def cycle_groups(edges: DataFrame) -> DataFrame:
    """(node, component) of nodes in groups of two or more that reach each other; component = smallest node.

    Edges to nodes without an edge out are left out first. Nodes with one way in lie on loops of such nodes, found by doubling steps, or on cycles
    with nodes of several ways in; only if there are any of these, the rest is looked at. Its edges
    whose ends have no edge in or no edge out are trimmed, some rounds. What is left falls into parts that no edge joins,
    whatever its direction. Parts of at most ``SMALL`` edges, counted, are settled one by one in tasks; in larger ones each colour is split by the smallest
    node that reaches a node forwards and the smallest it can reach, until no colour splits, with nodes that stand alone put
    aside. All rounds are joins on written tables.
    """
    edges = materialize(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src <> dst"), "given")
    edges = materialize(edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst").distinct(), "directed")
    ways = materialize(edges.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("up"), F.max("src").alias("last")), "ways_in")
    loops = _loops(ways.where("up = last").select("node", "up"))
    if ways.where("up <> last").isEmpty():
        return loops
    edges = materialize(edges.join(loops.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"), "rest")
    left = -1
    for _ in range(TRIMS):
        ends = edges.select(F.col("src").alias("dst")).distinct()
        starts = edges.select(F.col("dst").alias("src")).distinct()
        edges = materialize(edges.join(ends, "dst", "left_semi").join(starts, "src", "left_semi").select("src", "dst"), "trimmed")
        now = edges.count()
        if now == left:
            break
        left = now
    labels = connected_components(edges, "src", "dst").select(F.col("node").alias("src"), F.col("component").alias("part"))
    edges = materialize(edges.join(labels, "src").select("src", "dst", "part"), "parts")
    large = materialize(edges.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > SMALL).select("part"), "large_parts")
    settled = edges.join(large, "part", "left_anti").groupBy("part").applyInArrow(_tarjan, "node long, component long").unionByName(loops)
    if large.isEmpty():
        return settled
    return settled.unionByName(_split(materialize(edges.join(large, "part", "left_semi").select("src", "dst"), "large_edges")))


def _split(edges: DataFrame) -> DataFrame:
    """(node, component) as ``cycle_groups``, by rounds of joins."""
    nodes = edges.select(F.col("src").alias("node")).intersect(edges.select(F.col("dst").alias("node")))
    colours = nodes.withColumn("colour", F.lit("0"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    groups = -1
    while True:
        down = _reach(edges, colours).select("node", "colour", F.col("low").alias("f"))
        up = _reach(back, colours).select("node", F.col("low").alias("b"))
        split = materialize(down.join(up, "node").select("node", F.sha2(F.concat_ws("|", "colour", "f", "b"), 256).alias("colour")), "split")
        together = split.groupBy("colour").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1")
        colours = materialize(split.join(together, "colour").select("node", "colour", "component"), "colours")
        found = colours.select("colour").distinct().count()
        if found == groups:
            return colours.select("node", "component")
        groups = found
        colours = colours.select("node", "colour")
