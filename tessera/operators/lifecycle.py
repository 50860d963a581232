"""Record lifecycle: pruning, demotion, caps, purge, value scores. All return the table with a decision column; nothing is mutated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.scores import DAY, cosine
from tessera.operators.ranking import ranked
from tessera.operators.vectors import nearest
from tessera.scratch import materialize

# Fixed values.
PROTECTED_TAGS = ("seed", "community", "synthesized")
SCOPE_LIMITS = {"global": 200, "org": 100, "project": 500, "session": 50}


def protected() -> Column:
    return F.arrays_overlap("tags", F.array(*map(F.lit, PROTECTED_TAGS))) | (F.size("supporting_episode_ids") > 0)


def prunable(now: float) -> Column:
    """Never validated, old enough for its class, and of low confidence unless independent or on probation."""
    probation, independent = F.array_contains("tags", "probation"), F.array_contains("tags", "independent")
    age = F.when(probation, 3 * DAY).when(independent, 7 * DAY).otherwise(14 * DAY)
    low = independent | probation | (F.col("confidence") < 0.4)
    ordinary = F.col("is_valid") & (F.col("kind") != "constraint") & (F.col("success_count") <= 0) & ~protected()
    return ordinary & low & (F.lit(now) - F.col("created_at") >= age)


def demoted(facts: DataFrame, now: float) -> DataFrame:
    """Adds new_confidence and action: invalidate, demote, boost or keep."""
    eligible = F.col("is_valid") & (F.col("kind") != "constraint") & ~protected()
    eligible &= (F.lit(now) - F.col("created_at") >= 7 * DAY) & (F.col("access_count") >= 5)
    none, hits = F.col("success_count") == 0, F.col("success_count") / F.col("access_count")
    ceiling = F.least(F.lit(0.9), 0.6 + 0.1 * F.col("success_count"))
    raised = F.least(F.lit(1.0), ceiling, F.col("confidence") + 0.05)
    action = (
        F.when(eligible & none & (F.col("access_count") >= 10), "invalidate")
        .when(eligible & none, "demote")
        .when(eligible & (F.col("success_count") > 0) & (hits >= 0.3) & (raised > F.col("confidence")), "boost")
        .otherwise("keep")
    )
    new = F.when(F.col("action") == "demote", F.greatest(F.lit(0.1), F.col("confidence") - 0.1)).when(F.col("action") == "boost", raised)
    return facts.withColumn("action", action).withColumn("new_confidence", new.otherwise(F.col("confidence")))


def quality(confidence: Column, access: Column, success: Column) -> Column:
    return F.when((access > 0) & (success > 0), confidence * 0.5 + success / access * 0.5).otherwise(confidence)


def evicted(facts: DataFrame, limits: dict[str, int] = SCOPE_LIMITS) -> DataFrame:
    """Rows to evict: the lowest eviction scores of each scope beyond its limit; constraints and protected rows stand outside.

    Ranks are counted over all tasks, so a scope, or a score, that most rows have is no one task's work.
    """
    limit = F.coalesce(F.create_map(*[F.lit(x) for k, v in limits.items() for x in (k, v)])[F.col("scope")], F.lit(1 << 60))
    rows = facts.where(F.col("is_valid") & (F.col("kind") != "constraint") & ~protected())
    rows = rows.withColumn("eviction_score", F.round(quality(F.col("confidence"), F.col("access_count"), F.col("success_count")), 6)).select("fact_id", "scope", "eviction_score")
    sizes = rows.groupBy("scope").agg((F.count("*") - limit).alias("excess")).where("excess > 0")
    full = materialize(rows.join(sizes, "scope"), "full_scopes")
    return ranked(full, ["scope"], [F.col("eviction_score"), F.col("fact_id")], "place").where("place <= excess").select("fact_id", "scope", "eviction_score")


def newest_beyond(rows: DataFrame, keep: int, partition: list[str]) -> DataFrame:
    """Rows beyond the newest ``keep`` of each partition, with ``age_rank``."""
    return ranked(rows, partition, [F.col("created_at").desc(), F.col("fact_id")], "age_rank").where(F.col("age_rank") > keep)


def purgeable(now: float) -> Column:
    kept = F.coalesce(F.col("invalidation_reason") == "repeated_attributed_contradiction", F.lit(False))
    return ~F.col("is_valid") & (F.lit(now) - F.col("last_accessed") >= 30 * DAY) & ~kept


def memory_level(facts: DataFrame) -> DataFrame:
    """One row: 1 - 1 / (1 + quality / reference), reference = max(50, a fifth of the loaded scopes' capacity)."""
    q = quality(F.col("confidence"), F.col("access_count"), F.col("success_count")) * (0.9 + 0.1 * F.least(F.lit(1.0), F.col("access_count") / 10))
    limit = F.coalesce(F.create_map(*[F.lit(x) for k, v in SCOPE_LIMITS.items() for x in (k, v)])[F.col("scope")], F.lit(200))
    per = facts.groupBy("scope").agg(F.sum(F.when(F.col("is_valid"), q)).alias("q"), F.first(limit).alias("capacity"))
    total = per.agg(F.coalesce(F.sum("q"), F.lit(0.0)).alias("quality"), F.greatest(F.lit(50.0), F.sum("capacity") * 0.2).alias("reference"))
    return total.select("quality", "reference", (1 - 1 / (1 + F.col("quality") / F.col("reference"))).alias("level"))


def value_scores(facts: DataFrame, vectors: DataFrame) -> DataFrame:
    """(fact_id, value): .30 novelty + .20 validation + .35 task + .15 repetition.

    Novelty compares a vector with the others of its ``label`` (the blocking column); the active corpus is the mean of
    the 20 vectors accessed last.
    """
    rows = facts.where("is_valid").join(vectors.select(F.col("vec_id").alias("fact_id"), "embedding", "label"), "fact_id")
    near = nearest(rows.select(F.col("fact_id").cast("long").alias("id"), F.col("label").alias("grp"), F.col("embedding").alias("vector")))
    near = near.select(F.col("id").alias("fact_id"), F.col("similarity").alias("nearest"))
    active = rows.orderBy(F.col("last_accessed").desc(), "fact_id").limit(20)
    mean = active.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centroid = mean.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))  # one vector
    top = facts.agg(F.max("access_count").alias("most"))
    joined = rows.join(near, "fact_id", "left").crossJoin(F.broadcast(centroid)).crossJoin(F.broadcast(top))
    value = (
        0.30 * F.greatest(F.lit(0.0), 1 - F.coalesce("nearest", F.lit(0.5)))
        + 0.20 * F.least(F.lit(1.0), F.col("success_count") / (F.col("access_count") + 1))
        + 0.35 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(F.col("embedding"), F.col("centroid"), 0.5)))
        + 0.15 * F.least(F.lit(1.0), F.col("access_count") / (F.col("most") + 1))
    )
    return joined.select("fact_id", F.round(value, 6).alias("value"))


def forgetting_threshold(scores: DataFrame, target: int = 2000) -> DataFrame:
    """One row: mean - deviation * (n / target), within [0.05, 1]."""
    theta = F.avg("value") - F.stddev_pop("value") * (F.count("*") / target)
    return scores.agg(F.greatest(F.lit(0.05), F.least(F.lit(1.0), theta)).alias("threshold"), F.count("*").alias("n"))
