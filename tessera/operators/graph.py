"""Graph operators: connected components, cycle groups and chains as DataFrame loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.scratch import materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an undirected edge list; component = smallest node reachable.

    Minimum-label propagation with hooking and pointer jumping: a label's own node takes the smallest label that any node of that
    label is next to, so whole regions merge and long paths take few rounds. Every round is written and re-read, so lineage stays
    short and a lost executor costs one round; nothing is collected but one flag per round. A hub's edges
    meet its label in a plain join that AQE can split, and minima are combined before the shuffle.
    Self loops give their node a component; null ends are ignored; no edges give no rows.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    both = materialize(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l")), "labels")
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        step = materialize(near.join(labels, "u").select("u", "l", F.least("m", "l").alias("m")), "near")
        if step.where("m <> l").isEmpty():
            return labels.select(F.col("u").alias("node"), F.col("l").alias("component"))
        hooks = step.where("m <> l").groupBy(F.col("l").alias("u")).agg(F.min("m").alias("h"))
        step = step.join(hooks, "u", "left").select("u", "l", F.least("m", "h").alias("m"))
        root = labels.select(F.col("u").alias("m"), F.col("l").alias("r"))
        labels = materialize(step.join(root, "m").select("u", F.least("m", "r").alias("l")), "labels")
