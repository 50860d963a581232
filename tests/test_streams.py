"""Streams with state against plain Python, the sinks and their replays."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.streaming.admit import admit
from tessera.streaming.lapse import correlated
from tessera.streaming.retained import retained
from tessera.streaming.rolling import RollingWriter, committed, read_rolled, sink
from tessera.streaming.runs import fed


def at(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


def arrivals(rows, time, parts, late, seed):
    """Rows dealt to parts by their time and up to ``late`` hours later."""
    rng = random.Random(seed)
    keyed = sorted(((r[time] or at(0)) + dt.timedelta(hours=rng.random() * late), k) for k, r in enumerate(rows))
    size = -(-len(rows) // parts)
    return [[rows[k] for _, k in keyed[a : a + size]] for a in range(0, len(rows), size)]


def test_sessions_are_retained_until_they_end(spark):
    rng = random.Random(4)
    rows = []
    for i in range(220):
        key = rng.choice([7, 7, 7, 1, 2, 3, 4, None])  # one key has most rows
        hours = rng.randint(0, 60 * 24) + rng.random()
        rows.append((key, at(hours) if i % 40 else None, i if rng.random() < 0.7 else None))
    rows += rows[:6] + [(5, at(0), 900), (5, at(48), None), (6, at(10), 901), (6, at(10 + 48), None), (6, at(10 + 48.001), None)]
    end = at(200 * 24)
    parts = [spark.createDataFrame(p, "key long, ts timestamp, session long") for p in [*arrivals(rows, 1, 4, 20, 1), [(99, end, None)]]]
    got, checkpoint = retained(spark, parts, days=2, delay="1 day")
    want = {}
    for key, ts, session in rows:
        if key is not None and ts is not None and session is not None:
            state = any(k == key and s is None and t is not None and dt.timedelta(0) <= t - ts <= dt.timedelta(days=2) for k, t, s in rows)
            want[key, session] = "resolved" if state else "expired"
    assert {(r.key, r.session): r.state for r in got.collect()} == want
    assert got.count() == len(want)
    held = {v: spark.read.format("statestore").option("path", checkpoint).option("stateVarName", v).load().count() for v in ("open", "changes")}
    assert held == {"open": 0, "changes": 1}  # the last change alone


def test_sessions_of_many_keys_share_state(spark):
    from tessera.streaming.retained import BUCKETS

    us, big, end = dt.timedelta(microseconds=1), 2**60, at(100)
    rows = [(k, at(90), k) for k in range(2 * BUCKETS)]  # open at the end
    rows += [(-1, at(1), big), (-1, at(2), big + 1), (-1, at(2) + 48 * dt.timedelta(hours=1), None)]  # ids that differ in their last bit
    rows += [(-2, at(1) + 500 * us, 1), (-2, at(1) + 400 * us, None), (-3, at(1) + 400 * us, 1), (-3, at(1) + 500 * us, None)]  # within a millisecond
    mark = end - dt.timedelta(hours=24)
    rows += [(-4, mark - dt.timedelta(hours=48), 1), (-5, mark - dt.timedelta(hours=48) - dt.timedelta(milliseconds=1), 1), (-6, end, None)]  # not yet behind the watermark, and behind it
    got, checkpoint = retained(spark, [spark.createDataFrame(rows, "key long, ts timestamp, session long")], days=2, delay="1 day")
    assert {(r.key, r.session): r.state for r in got.collect()} == {(-1, big): "expired", (-1, big + 1): "resolved", (-2, 1): "expired", (-3, 1): "resolved", (-5, 1): "expired"}
    states = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "open").load()
    assert 0 < states.count() <= BUCKETS


def test_suggestions_match_or_lapse(spark):
    rng = random.Random(5)
    rows = []
    for i in range(260):
        rows.append((i, rng.choice([1, 1, 1, 2, 3, None]), at(rng.random() * 300) if i % 50 else None, rng.choice([None, 1.0, 2.5, 2.5, 9.0]), rng.random() < 0.4))
    rows += rows[:5] + [(900, 3, at(299.9), 1.0, True), (901, 8, at(20), 1.0, True), (902, 8, at(22), 1.0, False)]
    parts = [spark.createDataFrame(p, "id long, who long, ts timestamp, value double, suggested boolean") for p in arrivals(rows, 2, 3, 10, 2)]
    got = {r.suggestion: (r.episode, r.similarity, r.state) for r in correlated(spark, parts, "who", "2 hours", "1 day").collect()}
    good = [r for r in rows if r[1] is not None and r[2] is not None]
    mark = min(max(r[2] for r in good if r[4]), max(r[2] for r in good if not r[4])) - dt.timedelta(days=1)
    want = {}
    for i, who, ts, value, suggested in good:
        if suggested:
            near = lambda v: 0.0 if v is None or value is None else round(1 / (1 + abs(v - value)), 6)
            hits = [(near(v), t, j) for j, w, t, v, s in good if not s and w == who and dt.timedelta(0) <= t - ts <= dt.timedelta(hours=2)]
            if hits:
                want[i] = (max(hits)[2], max(hits)[0], "matched")
            elif ts + dt.timedelta(hours=2) < mark:
                want[i] = (None, None, "lapsed")
    assert got == want
    assert {"matched", "lapsed"} == {s for _, _, s in got.values()} and 900 not in got


def test_suggestions_write_no_pairs(spark, tmp_path, monkeypatch):
    from tessera.streaming import lapse

    monkeypatch.setattr(lapse, "kept_path", lambda spark, name: f"{tmp_path}/{name}")
    us = dt.timedelta(microseconds=1)
    rows = [(i, 1, at(2 + i / 100), 1.0, True) for i in range(20)] + [(100 + i, 1, at(2.5 + i / 100), float(i), False) for i in range(120)]  # one key has most rows
    rows += [(20, 2, at(4) - us, 1.0, True), (300, 2, at(6) - us, 9.0, False), (21, 3, at(4), 1.0, True), (301, 3, at(6), 9.0, False)]  # at the end of the window, slots apart
    rows += [(22, 4, at(4), 1.0, True), (302, 4, at(6) + us, 1.0, False), (23, 5, at(5), 1.0, True), (303, 5, at(5) - us, 1.0, False)]  # beside it
    rows += [(900, 9, at(200), 1.0, True), (901, 8, at(200), 1.0, False)]
    got = {r.suggestion: (r.episode, r.state) for r in correlated(spark, [spark.createDataFrame(rows, "id long, who long, ts timestamp, value double, suggested boolean")], "who", "2 hours", "1 day").collect()}
    assert got == {i: (101, "matched") for i in range(20)} | {20: (300, "matched"), 21: (301, "matched"), 22: (None, "lapsed"), 23: (None, "lapsed")}
    written = spark.read.parquet(f"{tmp_path}/correlated")
    assert written.count() <= 2 * 24  # a row a suggestion and batch


def test_streams_of_nothing(spark):
    none = spark.createDataFrame([], "key long, ts timestamp, session long")
    assert retained(spark, [none], 14, "1 day")[0].count() == 0
    assert correlated(spark, [spark.createDataFrame([], "id long, who long, ts timestamp, value double, suggested boolean")], "who", "2 hours", "1 day").count() == 0


def test_admission_holds_keys_in_state(spark, tmp_path):
    source, target = f"{tmp_path}/source", f"{tmp_path}/target"
    schema = "key string, at timestamp, n int"
    put = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    run = lambda: admit(spark, source, spark.createDataFrame([], schema).schema, ["key"], lambda df: df.select("key", "at", "n"), "at", "1 hour", target=target)
    put(("a", at(0), 1), ("a", at(0.1), 1), ("b", at(0.2), 1))
    assert sorted(r.key for r in run().collect()) == ["a", "b"]
    put(("a", at(0.3), 2), ("c", at(0.4), 2), (None, at(0.4), 2), (None, at(0.5), 2))
    assert sorted(str(r.key) for r in run().collect()) == ["None", "a", "b", "c"]
    batches = sorted(os.listdir(f"{target}/rows"))
    assert [r.key for r in spark.read.parquet(f"{target}/rows/{[b for b in batches if b.startswith('batch=')][-1]}").collect()].count("a") == 0
    assert sorted(str(r.key) for r in run().collect()) == ["None", "a", "b", "c"]  # nothing new
    put(("z", at(9), 3))
    run()
    put(("a", at(9.1), 4))  # its key has expired
    assert sorted(str(r.key) for r in run().collect()) == ["None", "a", "a", "b", "c", "z"]


def test_rolled_files(spark, tmp_path):
    place = f"{tmp_path}/rolled"
    rows = [(["a", "b", "c", None][i % 4], i, "é" * (i % 90)) for i in range(900)] + [("a", -1, "x" * 5000)]
    parts = [spark.createDataFrame(rows[k::3], "event string, n long, message string").repartition(2) for k in range(3)]
    fed(spark, parts, "rolled", lambda df, checkpoint: sink(df, "rolling", place, checkpoint, max_bytes=4000, profile="minimal", events="a,c"))
    got = sorted((r.event, r.n, r.message) for r in read_rolled(spark, place, "event string, n long, message string").collect())
    assert got == sorted(r for r in rows if r[0] in ("a", "c"))
    sizes = [os.path.getsize(f) for f in committed(spark, place)]
    assert len(sizes) > 10 and sorted(sizes)[-2] <= 4000 < 5000 < max(sizes)


def test_a_batch_that_is_written_again_replaces_itself(spark, tmp_path):
    from pyspark.sql import Row

    place = f"{tmp_path}/rolled"
    writer = RollingWriter({"path": place, "max_bytes": "60", "profile": "standard"})
    some = [Row(event="a", n=i) for i in range(9)]
    writer.commit([writer.write(iter(some[:4])), writer.write(iter(some[4:6])), None], 0)
    lost = writer.write(iter(some))  # a task whose batch never commits
    writer.commit([writer.write(iter(some[:6]))], 0)
    writer.commit([writer.write(iter(some[6:]))], 1)
    failed = writer.write(iter(some))
    writer.abort([failed, None], 2)
    read = lambda: sorted(r.n for r in read_rolled(spark, place, "event string, n long").collect())
    assert read() == list(range(9))
    there = set(os.listdir(f"{place}/rows"))
    assert not set(failed.files) & there and set(lost.files) <= there
    assert all(os.path.getsize(f"{place}/rows/{f}") <= 60 for f in there)
    assert [json.loads(x)["batch"] for x in open(f"{place}/commits/{0:012}.jsonl")] == [0] * 3
    off = RollingWriter({"path": place, "profile": "off"})
    assert off.write(iter(some)).files == []
    with pytest.raises(ValueError, match="profile"):
        RollingWriter({"path": place, "profile": "loud"})
    assert read_rolled(spark, f"{tmp_path}/none", "event string").count() == 0


def test_sinks_in_memory_and_for_nothing(spark, tmp_path):
    part = spark.range(20).select(F.col("id"), F.lit("a").alias("event"))
    for kind in ("memory", "null"):
        fed(spark, [part], kind, lambda df, checkpoint, kind=kind: sink(df, kind, f"kept_{kind}", checkpoint))
    assert spark.table("kept_memory").count() == 20
    with pytest.raises(ValueError, match="sink"):
        sink(part, "printer", "", "")
