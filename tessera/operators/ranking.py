"""Ranks within groups of any size: rows are put in order over all tasks, and each task's rows are counted on from those before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.scratch import materialize

_PLACE = (1 << 33) - 1  # monotonically_increasing_id has the place in the task in its low 33 bits


def ranked(rows: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """``rows`` with their rank from 1 within ``group`` in the column ``name``; ``order`` should leave no ties.

    Unlike a window over the group, a group that most rows have is ranked by as many tasks as its rows need: the order is a range partitioning of
    (group, order), and only the counts of each task and group are added up.
    """
    keys = [F.col(g).asc_nulls_first() for g in group]
    placed = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed.withColumns({"_task": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit(_PLACE))}), "ordered")
    counts = placed.groupBy("_task", *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col("_task").alias("_t"), *[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_offset"))
    same = F.col("_task") == F.col("_t")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    return placed.join(offsets, same).select(*rows.columns, (F.col("_at") + F.col("_offset")).cast("int").alias(name))
