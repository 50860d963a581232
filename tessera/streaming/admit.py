"""Structured Streaming: exactly-once admission of appended rows, windowed counts and interval correlation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tessera.scratch import kept_path, read_written


def admit(
    spark: SparkSession, source: str, schema: StructType, key: list[str], prepare: Callable[[DataFrame], DataFrame], time: str, expiry: str, name: str = "admitted", files_per_batch: int = 1, target: str | None = None
) -> DataFrame:
    """Read every file under ``source`` once, in micro-batches, into a written table; the rows admitted.

    ``prepare`` gives rows with the ``key`` and the timestamp ``time``. Keys that were admitted are held in the state store until the
    watermark, ``expiry`` behind the latest time, passes them: a key comes through once within ``expiry``, later rows than that
    are not admitted. A batch writes its new keys only. The checkpoint holds what has been consumed, a batch's path holds its number, so a
    batch that runs again replaces its own output (effectively once). A ``target`` that was given goes on where it stopped.
    """
    target = target or kept_path(spark, name)
    rows = prepare(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source))
    fresh = rows.withWatermark(time, expiry).dropDuplicatesWithinWatermark(key)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/rows/batch={number}")

    query = fresh.writeStream.foreachBatch(write).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return read_written(spark, f"{target}/rows", rows.schema).drop("batch")


def windowed_counts(spark: SparkSession, source: str, schema: StructType, time: str, late: str, width: str, by: str, value: str) -> DataFrame:
    """Counts and sums of event-time windows under a watermark, complete after all files."""
    target, checkpoint = kept_path(spark, "windows"), kept_path(spark, "windows-checkpoint")
    rows = spark.readStream.schema(schema).parquet(source).withColumn(time, F.col(time).cast("timestamp"))
    counts = rows.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total"))
    flat = counts.select(F.unix_seconds(F.col("window.start")).alias("start"), by, "n", "total")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("seen", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = flat.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    latest = F.max(F.struct("seen", "n", "total")).alias("v")
    return spark.read.parquet(target).groupBy("start", by).agg(latest).select("start", by, "v.n", "v.total")
