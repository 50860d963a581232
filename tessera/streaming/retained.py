"""Sessions that wait for a change: kept in state until it comes, dropped by a timer when their time is over."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tessera.scratch import kept_path, read_written
from tessera.streaming.runs import fed

HOUR = 3_600_000_000
#: Groups of keys: a call of the processor and a few reads and writes of state serve all keys of one. Fixed, as a checkpoint keeps them.
BUCKETS = 256
_CHANGES = "key long, at timestamp, opens boolean, session long, first long, last long"
_OUT = "key long, session long, state string"


def _by_hour(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sessions as they are; of changes only the first and last of each key and hour, which answer every question about a window of hours (at the later one's time)."""
    names = ["key", "at", "opens", "session", "first", "last"]
    for batch in batches:
        table = pa.Table.from_batches([batch])
        change = table["session"].is_null()
        changes = table.filter(change)
        hour = pa.array(changes["us"].to_numpy() // HOUR, pa.int64())
        grouped = pa.table({"key": changes["key"], "hour": hour, "us": changes["us"], "at": changes["at"]}).group_by(["key", "hour"]).aggregate([("us", "min"), ("us", "max"), ("at", "max")])
        opened = table.filter(pa.compute.invert(change))
        flags = lambda rows, value: pa.array(np.full(len(rows), value), pa.bool_())
        yield from pa.table([grouped["key"], grouped["at_max"], flags(grouped, False), pa.array(np.zeros(len(grouped), np.int64)), grouped["us_min"], grouped["us_max"]], names).to_batches()
        yield from pa.table([opened["key"], opened["at"], flags(opened, True), opened["session"], opened["us"], opened["us"]], names).to_batches()


class Retained(StatefulProcessor):
    """For one bucket of keys: open sessions (since when) and the changes of a key by hour, as columns; both end by timers.

    A change resolves every session of its key that opened at or before it and no more than ``keep`` microseconds earlier, in whatever order both arrive.
    A session that the watermark leaves behind by ``keep`` expires. Changes are kept while a session that opened before them may still arrive.
    A bucket has a timer at the first time at which any of its rows ends, and then all that have ended go.
    """

    OPEN, CHANGES = ["key", "session", "since"], ["key", "hour", "first", "last"]

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        columns = lambda names: ", ".join(f"{n} array<bigint>" for n in names)
        self.open = handle.getValueState("open", columns(self.OPEN))
        self.changes = handle.getValueState("changes", columns(self.CHANGES))

    def _held(self) -> tuple[pd.DataFrame, pd.DataFrame]:
        read = lambda state, names: pd.DataFrame(dict(zip(names, state.get() or [[]] * len(names))), dtype=np.int64)
        return read(self.open, self.OPEN), read(self.changes, self.CHANGES)

    def _keep(self, opened: pd.DataFrame, changes: pd.DataFrame) -> None:
        """Both tables as the state from now on, and a timer for what ends first."""
        for state, rows in ((self.open, opened), (self.changes, changes)):
            if len(rows):
                state.update(tuple(rows[c].tolist() for c in rows))
            else:
                state.clear()
        ends = [*(opened["since"] + self.keep).nsmallest(1), *((changes["hour"] + 1) * HOUR).nsmallest(1)]
        if ends:
            self.handle.registerTimer(int(min(ends)) // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        opened, changes = self._held()
        batch = pd.concat(rows)
        came, seen = batch[batch["opens"]], batch[~batch["opens"]]
        opened = pd.concat([opened, came.rename(columns={"first": "since"})[self.OPEN]]).groupby(["key", "session"], as_index=False)["since"].min()
        changes = pd.concat([changes, seen.assign(hour=seen["first"] // HOUR)[self.CHANGES]]).groupby(["key", "hour"], as_index=False).agg({"first": "min", "last": "max"})
        times = pd.concat([changes[["key", end]].set_axis(["key", "time"], axis=1) for end in ("first", "last")]).sort_values("time")
        # The next change of the key: an hour's first or last is in the window if any is, as the window is longer than an hour.
        met = pd.merge_asof(opened.sort_values("since"), times, left_on="since", right_on="time", by="key", direction="forward", tolerance=self.keep)
        done = met["time"].notna()
        self._keep(met.loc[~done, self.OPEN], changes)
        if done.any():
            yield met.loc[done, ["key", "session"]].assign(state="resolved")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        opened, changes = self._held()
        gone = opened["since"] + self.keep < now
        self._keep(opened[~gone], changes[(changes["hour"] + 1) * HOUR >= now])
        if gone.any():
            yield opened.loc[gone, ["key", "session"]].assign(state="expired")


def retained(spark: SparkSession, parts: list[DataFrame], days: int, delay: str) -> tuple[DataFrame, str]:
    """((key, session, state) of every session that was ``resolved`` or has ``expired``, the last checkpoint); open ones have no row.

    Rows are (key, ts, session), in parts as they arrive: a session opens at ts, or, where ``session`` is null, the key changes. A session
    is resolved by a change from its opening to ``days`` later; ``delay`` is how late rows may come. A session that comes again
    counts from its first opening in state, and is resolved if it ever was. Rows of a null key or time are left out. Changes are combined by hour before they are
    shuffled, and in state, so a key that most rows have sends and holds little. State is held by buckets of keys: calls and timers are as many as
    buckets, not keys, and a batch writes the state of its keys' buckets anew.
    """
    target, places = kept_path(spark, "retained"), []
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)

    def start(rows: DataFrame, checkpoint: str):
        places.append(checkpoint)
        at = F.col("ts").cast("timestamp")
        known = rows.where("key is not null and ts is not null").select(F.col("key").cast("long").alias("key"), at.alias("at"), F.col("session").cast("long").alias("session"), F.unix_micros(at).alias("us"))
        keyed = known.mapInArrow(_by_hour, _CHANGES).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS))).withWatermark("at", delay).groupBy("bucket")
        out = keyed.transformWithStateInPandas(Retained(days * 24 * HOUR), StructType.fromDDL(_OUT), "append", "eventTime")
        return out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        fed(spark, parts, "retained", start)
    finally:
        spark.conf.set(setting, before)
    states = read_written(spark, target, _OUT).groupBy("key", "session").agg(F.max("state").alias("state"))
    return states, places[-1] if places else ""
