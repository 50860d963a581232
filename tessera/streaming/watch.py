"""A listener that keeps what running streams report, and an incremental scan of prompts."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import StructType

from tessera.functions.prompts import signals, structural_key
from tessera.scratch import kept_path


class Watch(StreamingQueryListener):
    """Starts, batches and ends of streams, in order; ``stalled`` names those that have not reported a batch for a time."""

    def __init__(self):
        self.events: list[tuple[str, str, float]] = []
        self._lock = threading.Lock()

    def _keep(self, kind: str, run: str, value: float = 0.0) -> None:
        with self._lock:
            self.events.append((kind, str(run), value))

    def onQueryStarted(self, event):
        self._keep("started", event.runId)

    def onQueryProgress(self, event):
        self._keep("batch", event.progress.runId, float(event.progress.numInputRows))

    def onQueryIdle(self, event):
        self._keep("idle", event.runId)

    def onQueryTerminated(self, event):
        self._keep("failed" if event.exception else "ended", event.runId)

    def rows(self, run: str) -> float:
        with self._lock:
            return sum(v for k, r, v in self.events if k == "batch" and r == str(run))


def scan_prompts(spark: SparkSession, source: str, schema: StructType, bar: float = 0.3, least: int = 5) -> DataFrame:
    """(key, samples, effectiveness) of prompt patterns from conversations that arrive as files (whole ones): scores above ``bar``, at ``least`` samples.

    Every file is scored once, in micro-batches; a batch that runs again replaces its own output.
    """
    target, checkpoint = kept_path(spark, "prompt-scores"), kept_path(spark, "prompt-checkpoint")

    def score(batch: DataFrame, number: int) -> None:
        scored = signals(batch).select("conv_id", "turn", structural_key(F.col("text")).alias("key"), "score")
        scored.write.mode("overwrite").parquet(f"{target}/batch={number}")

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    rows.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    good = spark.read.parquet(target).where(F.col("score") > bar)
    return good.groupBy("key").agg(F.count("*").alias("samples"), F.avg("score").alias("effectiveness")).where(F.col("samples") >= least)
