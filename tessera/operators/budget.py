"""Budgets: layered accumulation, max-min fair shares, proportional slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def within_budget(rows: DataFrame, partition: list[str], order: list, cost: str, budget: Column, at_least_one: bool) -> DataFrame:
    """Rows in order while the running cost stays within ``budget``; optionally the first row always."""
    w = Window.partitionBy(*partition).orderBy(*order)
    held = rows.withColumns({"used": F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0)), "place": F.row_number().over(w)})
    fits = F.col("used") <= budget
    return held.where(fits | (F.col("place") == 1) if at_least_one else fits)


def fair_shares(rows: DataFrame, group: str, size: str, budget: int, *ties: str) -> DataFrame:
    """Adds ``share``: max-min fair parts of ``budget`` in each group (whole units; sizes of zero get none).

    By rising size, a row is satisfied while its size is at most the rest divided by the rows left; from the first row that is not,
    all get that quotient. Satisfying small rows only raises the quotient, so this equals satisfying in rounds.
    """
    w = Window.partitionBy(group).orderBy(size, *ties)
    p = rows.where(F.col(size) > 0).withColumns(
        {
            "before": F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "left": F.count("*").over(Window.partitionBy(group)) - F.row_number().over(w) + 1,
        }
    )
    p = p.withColumn("quotient", F.floor((F.lit(budget) - F.col("before")) / F.col("left")))
    first = F.min(F.when(F.col(size) > F.col("quotient"), F.struct(size, *ties, "quotient"))).over(Window.partitionBy(group))
    p = p.withColumn("stop", first)
    share = F.when(F.col("stop").isNull() | (F.struct(size, *ties) < F.struct(f"stop.{size}", *[f"stop.{t}" for t in ties])), F.col(size)).otherwise(F.col("stop.quotient"))
    return p.withColumn("share", share.cast("long")).drop("before", "left", "quotient", "stop")


def slots(counts: DataFrame, name: str, n: str, budget: int) -> DataFrame:
    """(name, n, slots): one slot each and the rest in proportion, never more than ``n``; spare slots go round by falling ``n``.

    With fewer slots than names the largest get one each. Spare slots are ranked as (round, -n, name); as many as are free count.
    """
    total = counts.where(F.col(n) > 0).agg(F.sum(n).alias("total"), F.count("*").alias("names"))
    c = counts.where(F.col(n) > 0).crossJoin(F.broadcast(total))  # one row
    seat = F.row_number().over(Window.orderBy(F.col(n).desc(), name))
    base = F.when(F.col("names") >= budget, (seat <= budget).cast("long")).otherwise(
        F.least(F.col(n), 1 + F.floor(F.col(n) / F.col("total") * (F.lit(budget) - F.col("names"))))
    )
    c = c.withColumn("base", base)
    free = F.broadcast(c.agg((F.lit(budget) - F.sum("base")).alias("free")))  # one row
    room = F.least(F.col(n) - F.col("base"), F.col("free"))
    spare = c.crossJoin(free).where((F.col("free") > 0) & (room > 0) & (F.col("names") < budget))
    spare = spare.withColumn("round", F.explode(F.sequence(F.lit(1).cast("long"), room)))
    given = spare.withColumn("turn", F.row_number().over(Window.orderBy("round", F.col(n).desc(), name))).where("turn <= free").groupBy(name).agg(F.count("*").alias("extra"))
    return c.join(given, name, "left").select(name, n, (F.col("base") + F.coalesce("extra", F.lit(0))).cast("long").alias("slots"))
