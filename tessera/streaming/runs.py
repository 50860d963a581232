"""Streams fed by parts of a table that arrive one after another: each part is a run on the same checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.scratch import kept_path


def fed(spark: SparkSession, parts: list[DataFrame], name: str, start: Callable[[DataFrame, str], StreamingQuery], files_per_batch: int = 1000) -> None:
    """For each part: add its files to a new folder and run the stream over the folder until all that is there is consumed.

    ``start`` gets the stream of the folder's rows and the checkpoint, and starts the query with an availableNow trigger. Every run
    begins from the checkpoint of the one before, as after a restart.
    """
    folder, checkpoint = kept_path(spark, f"{name}-files"), kept_path(spark, f"{name}-checkpoint")
    for part in parts:
        part.write.mode("append").parquet(folder)
        rows = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
        start(rows, checkpoint).awaitTermination()
