"""Pointer chains: every node's last ancestor and depth, by doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.scratch import materialize


def chain_ends(links: DataFrame, max_doublings: int = 40) -> DataFrame:
    """(node, root, depth) following ``next`` pointers (one each); a cycle ends after ``max_doublings`` rounds.

    Each round doubles the distance covered, so a chain of length d takes log2(d) joins.
    """
    state = materialize(links.select("node", F.col("next").alias("root"), F.lit(1).cast("long").alias("depth")), "chain")
    for _ in range(max_doublings):
        onward = state.select(F.col("node").alias("root"), F.col("root").alias("r2"), F.col("depth").alias("d2"))
        step = state.join(onward, "root", "left")
        moved = materialize(step.select("node", F.coalesce("r2", "root").alias("root"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), F.col("r2").isNotNull().alias("moved")), "chain")
        state = moved.select("node", "root", "depth")
        if moved.where("moved").isEmpty():
            break
    return state
