"""Table readers and the fact table that the lifecycle operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _pick(values: list[str], index) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def facts(events: DataFrame) -> DataFrame:
    """One fact for each user of ``events``: counters from the events, other fields by rule from the id."""
    kinds = ["constraint", "pattern", "review", "failure", "decision", "architecture", "known_unknown", "episode"]
    of = lambda *kinds: F.count(F.when(F.col("event_type").isin(*kinds), 1))
    seconds = lambda c: F.unix_micros(c) / 1e6
    u = F.col("fact_id")
    none = F.array().cast("array<string>")
    tags = F.when(u % 6 == 0, F.array(F.lit("seed"))).when(u % 6 == 1, F.array(F.lit("independent"))).when(u % 6 == 2, F.array(F.lit("probation")))
    tags = tags.when(u % 6 == 3, F.array(F.lit("attempt"), F.lit("observed-outcome"))).otherwise(none)
    grouped = events.groupBy(F.col("user_id").alias("fact_id")).agg(
        F.count("*").alias("access_count"),
        of("purchase").alias("success_count"),
        of("error").alias("error_count"),
        seconds(F.min("ts").cast("timestamp")).alias("created_at"),
        seconds(F.max("ts").cast("timestamp")).alias("last_accessed"),
        of("purchase", "error").alias("effectiveness_n"),
    )
    return grouped.withColumns(
        {
            "confidence": F.round(0.1 + (u % 9) * 0.1, 1),
            "kind": _pick(kinds, u % 8),
            "scope": _pick(["global", "org", "project", "session"], u % 4),
            "tags": tags,
            "provenance": _pick(["structural", "observed", "inferred"], u % 3),
            "is_valid": u % 7 != 6,
            "last_recall_ts": F.when(u % 2 == 0, F.col("last_accessed")),
            "g_n": (1.0 + u % 3).cast("double"),
            "effectiveness_c": F.col("success_count") * 1.5 - F.col("error_count") * 0.5,
            "supporting_episode_ids": F.when(u % 10 == 0, F.array(F.concat(F.lit("e"), u.cast("string")))).otherwise(none),
        }
    )
