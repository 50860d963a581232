"""Suggestions joined with what happens in the time after them; those that nothing follows lapse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.scratch import kept_path, read_written
from tessera.streaming.runs import fed


def correlated(spark: SparkSession, parts: list[DataFrame], key: str, window: str, delay: str) -> DataFrame:
    """(suggestion, episode, similarity, state) of suggestions, each ``matched`` with the best later episode of its ``key`` or ``lapsed``.

    Rows are (id, key, ts, value, suggested), in parts as they arrive; ``suggested`` tells suggestions from episodes. A stream-stream outer
    join holds a suggestion for as long as an episode within ``window`` of it may come, and gives it without one when the
    watermark (``delay`` behind the latest time) has passed its window; its state goes then. A suggestion whose window is still
    open has no row yet. The best episode is the nearest in value, then the latest, then the largest id; a repeated row is one.
    Rows of a null id, key or time are no suggestion and no episode; a null value is no nearer than any.

    Rows meet by key and slot of time, as long as the window: a suggestion waits in its own slot and the next, so a key that most rows have
    is spread over its slots and is not compared with itself as a whole. A batch writes one row a suggestion, its best so far, not its pairs; its
    path holds its number, so a batch that runs again replaces its own output. A suggestion has lapsed if neither of its slots ever matched.
    """
    target = kept_path(spark, "correlated")
    length = spark.sql(f"select unix_micros(timestamp_micros(0) + interval {window}) as us").first().us
    slot = lambda ts: F.floor(F.unix_micros(ts) / length)

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("suggestion").agg(F.max("b").alias("b")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    def start(rows: DataFrame, checkpoint: str):
        known = rows.where(F.col(key).isNotNull() & F.col("ts").isNotNull() & F.col("id").isNotNull())
        timed = known.withColumn("ts", F.col("ts").cast("timestamp"))
        left = timed.where("suggested").select(F.col("id").alias("suggestion"), F.col(key).alias("whose"), F.col("ts").alias("since"), F.col("value").alias("wanted"), F.explode(F.array(slot("ts"), slot("ts") + 1)).alias("waits"))
        right = timed.where("not suggested").select(F.col("id").alias("episode"), F.col(key).alias("who"), F.col("ts").alias("at"), "value", slot("ts").alias("slot"))
        left, right = left.withWatermark("since", delay), right.withWatermark("at", delay)
        on = (F.col("whose") == F.col("who")) & (F.col("waits") == F.col("slot")) & (F.col("at") >= F.col("since")) & (F.col("at") <= F.col("since") + F.expr(f"interval {window}"))
        near = F.round(1 / (1 + F.abs(F.col("value") - F.col("wanted"))), 6)
        hit = F.struct(F.coalesce(near, F.lit(0.0)).alias("similarity"), F.unix_micros("at").alias("at"), "episode")
        found = left.join(right, on, "left_outer").select("suggestion", F.when(F.col("episode").isNotNull(), hit).alias("b"))
        return found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

    fed(spark, parts, "correlated", start)
    best = read_written(spark, target, "suggestion long, b struct<similarity: double, at: long, episode: long>").groupBy("suggestion").agg(F.max("b").alias("b"))
    return best.select("suggestion", "b.episode", "b.similarity", F.when(F.col("b").isNull(), "lapsed").otherwise("matched").alias("state"))
