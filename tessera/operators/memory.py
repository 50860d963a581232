"""The write side of a fact table, as tables of changes: adding, invalidating, feedback, contradictions, counters, peers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.text import generalize
from tessera.operators.graph import connected_components
from tessera.operators.lifecycle import PROTECTED_TAGS
from tessera.operators.vectors import linking_edges
from tessera.scratch import materialize

#: Steps of an outcome from no confidence to full; more steps than any entry has.
STEPS, FAR = 10, 1 << 60
# Ranks of provenance.
PROVENANCE = {"structural": 2, "observed": 1, "inferred": 0}


def load_scopes(*scopes: DataFrame) -> DataFrame:
    """Facts of several scopes as one table; columns that one lacks are null."""
    out = scopes[0]
    for s in scopes[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def on_probation(kind: Column, provenance: Column, tags: Column, supporting: Column) -> Column:
    """Tags of a new fact: curated ones stay as they are, others get ``probation``."""
    curated = kind.isin("constraint", "architecture") | (provenance == "structural") | F.arrays_overlap(tags, F.array(*map(F.lit, PROTECTED_TAGS))) | (F.size(supporting) > 0)
    return F.when(curated | F.array_contains(tags, "probation"), tags).otherwise(F.concat(tags, F.array(F.lit("probation"))))


def invalidated(facts: DataFrame, gone: DataFrame) -> DataFrame:
    """``facts`` after those of ``gone`` (fact_id) became invalid: flag, no vector, no text; facts that depend on them need review."""
    ids = materialize(gone.select("fact_id").where("fact_id is not null").distinct(), "gone")
    needing = facts.where("is_valid").select("fact_id", F.explode("depends_on").alias("on")).join(ids.withColumnRenamed("fact_id", "on"), "on", "left_semi")
    marked = facts.join(ids.withColumn("_gone", F.lit(True)), "fact_id", "left").join(needing.select("fact_id").distinct().withColumn("_review", F.lit(True)), "fact_id", "left")
    gone_, review = F.coalesce("_gone", F.lit(False)), F.coalesce("_review", F.lit(False))
    blank = {c: F.when(~gone_, F.col(c)).cast(t) for c, t in facts.dtypes if c in ("embedding", "body")}
    return marked.withColumns({**blank, "is_valid": F.col("is_valid") & ~gone_, "needs_review": F.col("needs_review") | (review & ~gone_)}).drop("_gone", "_review").select(facts.columns)


def added(stored: DataFrame, incoming: DataFrame, bar: float = 0.85) -> DataFrame:
    """What adding ``incoming`` in order of ``seq`` to the valid rows of ``stored`` does, a row for each incoming fact.

    Both have fact_id, subject, kind, scope, confidence, provenance, event_time, embedding; ``incoming`` also seq. Result: fact_id,
    action (``added``, ``bumped``), twin (the row that a bump goes to), superseded (the row that it replaces) and
    confidence. A fact whose scope and canonical subject exist already only bumps that row's counters. Another replaces
    the oldest valid row (then of the lowest provenance, then of the lowest cosine) of its scope and kind with a cosine over
    ``bar``, and takes its confidence plus 0.05 if that is more. Episodes do neither. The order matters only between rows that
    chains of such cosines connect, so each connected group is folded on its own, in one task; equal rows bump and form none.
    """
    canonical = F.when(F.col("kind") != "episode", F.concat_ws("|", "scope", generalize(F.coalesce("subject", F.lit("")))))
    rank = F.coalesce(F.create_map(*[F.lit(x) for k, v in PROVENANCE.items() for x in (k, v)])[F.col("provenance")], F.lit(0))
    columns = ["fact_id", "kind", "scope", "confidence", "event_time", "embedding"]
    old = stored.where("is_valid").select(*columns, F.lit(None).cast("long").alias("seq"), canonical.alias("canonical"), rank.alias("rank"))
    rows = materialize(old.unionByName(incoming.select(*columns, "seq", canonical.alias("canonical"), rank.alias("rank"))), "write_rows")
    known = rows.where("canonical is not null").groupBy("canonical").agg(F.min(F.struct(F.coalesce("seq", F.lit(-1)).alias("seq"), "fact_id")).alias("head"))
    twins = rows.where("seq is not null").join(materialize(known, "heads"), "canonical").where("head.fact_id <> fact_id").select("fact_id", F.col("head.fact_id").alias("twin"))
    twins = materialize(twins, "twins")
    fresh = rows.join(twins.select("fact_id"), "fact_id", "left_anti").where("kind <> 'episode'")
    vectors = fresh.select(F.col("fact_id").cast("long").alias("id"), F.concat_ws("|", "scope", "kind").alias("grp"), F.col("embedding").alias("vector"))
    labels = connected_components(linking_edges(vectors, bar), "a", "b").withColumnRenamed("node", "fact_id")
    groups = fresh.join(labels, "fact_id").select("component", "fact_id", "seq", "confidence", "event_time", "rank", "embedding")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["seq", "fact_id"], na_position="first", ignore_index=True)
        x = np.array([np.asarray(v, np.float64) for v in pdf["embedding"]])
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        ids, conf, when, level = (pdf[c].to_numpy() for c in ("fact_id", "confidence", "event_time", "rank"))
        conf, valid, out = conf.astype(float), np.zeros(len(pdf), bool), []
        for i, seq in enumerate(pdf["seq"]):
            best = None
            if not np.isnan(seq):
                near = x[:i] @ x[i]
                some = np.flatnonzero(valid[:i] & (near > bar))
                if len(some):
                    best = some[np.lexsort((near[some], level[some], when[some]))[0]]
                    valid[best] = False
                    conf[i] = max(conf[i], min(1.0, conf[best] + 0.05))
                out.append((ids[i], None if best is None else ids[best], conf[i]))
            valid[i] = True
        return pd.DataFrame(out, columns=["fact_id", "superseded", "confidence"]).astype({"superseded": "Int64"})

    folded = materialize(groups.groupBy("component").applyInPandas(fold, "fact_id long, superseded long, confidence double"), "folded")
    new = incoming.select("fact_id", F.col("confidence").alias("own"))
    out = new.join(twins, "fact_id", "left").join(folded, "fact_id", "left")
    return out.select(
        "fact_id", F.when(F.col("twin").isNotNull(), "bumped").otherwise("added").alias("action"), "twin", "superseded", F.coalesce("confidence", "own").alias("confidence")
    )


def feedback(facts: DataFrame, outcomes: DataFrame, links: DataFrame, arch: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(changes, reviews) of a batch of outcomes (ordinal, path, type, used, candidate_id) by the links (path, fact_id).

    A path finds its fact as it is spelled, without a leading ``./``, without or with a leading slash. A fact changes at most once
    in a batch, by the first outcome that touches it: an accepted one adds 0.2 (and a success), a modified or regressed one takes 0.2, each moved by
    the architecture's 0.1; facts that were only used gain a success or lose 0.05. Outcomes without a valid linked fact become review
    rows, but for accepted ones of a candidate and unverified ones.
    """
    shift = F.lit(0.0) if arch is None else F.when(arch == "regression", -0.1).when(arch == "improvement", 0.1).otherwise(0.0)
    bare = F.regexp_replace("path", r"^(?:\./)+", "")
    spelled = links.select("path", "fact_id").unionByName(links.select(bare.alias("path"), "fact_id")).groupBy("path").agg(F.min("fact_id").alias("fact_id"))
    spelled = materialize(spelled, "spellings")
    tries = F.array("path", bare, F.when(F.startswith("path", F.lit("/")), F.ltrim(F.col("path"), F.lit("/"))).otherwise(F.concat(F.lit("/"), F.col("path"))))
    tried = outcomes.select("ordinal", F.posexplode(tries).alias("place", "path")).join(spelled, "path")
    found = tried.groupBy("ordinal").agg(F.min(F.struct("place", "fact_id")).alias("hit")).select("ordinal", F.col("hit.fact_id").alias("linked"))
    valid = facts.where("is_valid").select(F.col("fact_id").alias("linked")).withColumn("alive", F.lit(True))
    o = materialize(outcomes.join(found, "ordinal", "left").join(valid, "linked", "left").withColumn("alive", F.coalesce("alive", F.lit(False))), "outcomes")
    moving = F.col("type").isin("accepted", "modified", "regression")
    direct = o.where(moving & F.col("alive")).select("ordinal", F.lit(1).alias("phase"), F.lit(0).alias("place"), F.col("linked").alias("fact_id"), "type")
    used = o.where(moving).select("ordinal", F.lit(0).alias("phase"), "type", F.posexplode(F.array_distinct("used")).alias("place", "fact_id"))
    used = used.join(links.select("fact_id").distinct(), "fact_id", "left_anti").select("ordinal", "phase", "place", "fact_id", "type")
    touch = direct.unionByName(used).groupBy("fact_id").agg(F.min(F.struct("ordinal", "phase", "place", "type")).alias("t"))
    touched = materialize(touch.select("fact_id", "t.ordinal", "t.phase", "t.type"), "touched")
    good, linked = F.col("type") == "accepted", F.col("phase") == 1
    up = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence") + F.greatest(F.lit(-0.05), 0.2 + shift)))
    down = F.greatest(F.lit(0.1), F.col("confidence") + F.least(F.lit(-0.05), -0.2 + shift))
    new = F.when(linked & good, up).when(linked, down).when(good, F.col("confidence")).otherwise(F.greatest(F.lit(0.1), F.col("confidence") - 0.05))
    changes = facts.where("is_valid").join(touched, "fact_id").select(
        "fact_id", "ordinal", F.when(linked, F.when(good, "reinforce").otherwise("demote")).otherwise(F.when(good, "credit_used").otherwise("demote_used")).alias("operation"),
        new.alias("confidence"), (F.col("success_count") + good.cast("int")).alias("success_count"),
        (F.col("effectiveness_c") + F.when(good, 1.5).otherwise(-0.5)).alias("effectiveness_c"), (F.col("effectiveness_n") + 1).alias("effectiveness_n"),
    )
    lone = o.where(((F.col("type") == "accepted") & ~F.col("alive") & (F.coalesce("candidate_id", F.lit("")) == "")) | (F.col("type").isin("modified", "regression")) | (F.col("type") == "independent"))
    again = touched.where("phase = 1").select(F.col("fact_id").alias("linked"), F.col("ordinal").alias("first"))
    lone = lone.join(again, "linked", "left").where("not alive or type = 'independent' or first = ordinal")
    confidence = F.when(F.col("type") == "accepted", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("suggested") + 0.1 + shift))).when(F.col("type") == "independent", 0.2).otherwise(0.4)
    return changes, lone.select("ordinal", F.concat(F.lit("outcome:"), "type", F.lit(" "), "path").alias("subject"), confidence.alias("confidence"))


def contradicted(facts: DataFrame, reports: DataFrame) -> DataFrame:
    """(fact_id, episodes, confidence, effectiveness_c, effectiveness_n, is_valid) of facts that ``reports`` (fact_id, episode_id) contradict.

    Each episode that the fact does not name yet takes 0.2 (down to 0.1) and half a point; at two distinct episodes the fact is invalid.
    """
    new = reports.where("fact_id is not null and episode_id is not null").select("fact_id", "episode_id").distinct().join(
        facts.select("fact_id", F.explode("contradicting_episode_ids").alias("episode_id")), ["fact_id", "episode_id"], "left_anti"
    )
    counted = new.groupBy("fact_id").agg(F.count("*").alias("n"))
    total = F.size("contradicting_episode_ids") + F.col("n")
    return facts.join(counted, "fact_id").select(
        "fact_id", total.cast("long").alias("episodes"), F.greatest(F.lit(0.1), F.col("confidence") - 0.2 * F.col("n")).alias("confidence"),
        (F.col("effectiveness_c") - 0.5 * F.col("n")).alias("effectiveness_c"), (F.col("effectiveness_n") + F.col("n")).alias("effectiveness_n"),
        (F.col("is_valid") & (total < 2)).alias("is_valid"),
    )


def retracted(candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """``candidates`` (candidate_id, episode_id, signature, promoted_fact_id, status) after the support of rolled-back ``facts`` (fact_id, signature, supporting_episode_ids) is taken back."""
    gone = facts.where("signature <> ''").select(F.col("fact_id").alias("_fact"), "signature", F.explode("supporting_episode_ids").alias("episode_id")).distinct()
    own = F.col("promoted_fact_id").isNull() | (F.col("promoted_fact_id") == F.col("_fact"))
    hit = candidates.join(gone, ["signature", "episode_id"]).where(F.col("status").isin("supported_once", "durable") & own).select("candidate_id").distinct()
    marked = candidates.join(hit.withColumn("_hit", F.lit(True)), "candidate_id", "left")
    return marked.withColumn("status", F.when(F.col("_hit"), "contradicted").otherwise(F.col("status"))).select(candidates.columns)


def resolved(identifiers: DataFrame, facts: DataFrame) -> DataFrame:
    """(identifier, status, fact_id, matches): an exact id, else the one id that begins so; ``missing`` or ``ambiguous`` (up to five ids) otherwise.

    Ids and identifiers meet on their first four characters, so shorter identifiers than that match exactly only.
    """
    key = lambda c: F.substring(c, 1, 4)
    near = identifiers.select("identifier").distinct().join(facts.select("fact_id"), key(F.col("identifier")) == key(F.col("fact_id"))).where(F.startswith("fact_id", F.col("identifier")))
    # The five smallest suffice: more than one is ambiguous already.
    place = F.row_number().over(Window.partitionBy("identifier").orderBy("fact_id"))
    found = near.where((F.length("identifier") >= 4) | (F.col("identifier") == F.col("fact_id"))).withColumn("place", place).where("place <= 5")
    per = found.groupBy("identifier").agg(F.sort_array(F.collect_list("fact_id")).alias("ids"))
    out = identifiers.select("identifier").distinct().join(per, "identifier", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    exact, n = F.array_contains("ids", F.col("identifier")), F.size("ids")
    status = F.when(exact, "exact").when(n == 1, "prefix").when(n == 0, "missing").otherwise("ambiguous")
    one = F.when(exact, F.col("identifier")).when(n == 1, F.try_element_at("ids", F.lit(1)))
    return out.select("identifier", status.alias("status"), one.alias("fact_id"), F.when(status == "ambiguous", F.array_join("ids", ", ")).otherwise("").alias("matches"))


def _clamped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Outcomes in order -> for each run of an entry: what its steps do to any confidence, counted in steps.

    Steps compose: x -> min(high, max(low, x + shift)) after another such is one again, so a run is three numbers.
    """
    out: list[list] = []
    for batch in batches:
        for entry, success in zip(batch.column("entry_id").to_pylist(), batch.column("success").to_pylist(), strict=True):
            if not out or out[-1][0] != entry:
                out.append([entry, 0, -FAR, FAR, 0, 0])
            run, step = out[-1], 1 if success else -1
            run[1] += step
            run[2], run[3] = min(STEPS, max(0, run[2] + step)), min(STEPS, max(0, run[3] + step))
            run[4 if success else 5] += 1
        done, out = out[:-1], out[-1:]
        yield _runs(done)
    yield _runs(out)


def _runs(rows: list[list]) -> pa.RecordBatch:
    names = ["entry_id", "shift", "low", "high", "wins", "losses"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(6)], names)


def recorded(entries: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(entry_id, success_signals, failure_signals, confidence) after ``outcomes`` (entry_id, at, success): 0.1 up or down each, within [0, 1], in order; of equal times failures come first.

    Outcomes are put in order over all tasks, so those of one entry may lie in many; each task sends on one row for an entry, and those are composed in order.
    """
    known = outcomes.where("entry_id is not null and success is not null").select(F.col("entry_id").cast("long").alias("entry_id"), "at", "success")
    ordered = known.repartitionByRange("entry_id", "at", "success").sortWithinPartitions("entry_id", "at", "success")
    runs = ordered.mapInArrow(_clamped, "entry_id long, shift long, low long, high long, wins long, losses long").withColumn("task", F.spark_partition_id())
    parts = runs.groupBy("entry_id").agg(F.sum("wins").alias("wins"), F.sum("losses").alias("losses"), F.array_sort(F.collect_list(F.struct("task", "shift", "low", "high"))).alias("parts"))  # one for each task that has the entry
    tenth = lambda n: n / F.lit(float(STEPS))
    fold = F.aggregate("parts", F.col("confidence").cast("double"), lambda c, p: F.least(tenth(p["high"]), F.greatest(tenth(p["low"]), c + tenth(p["shift"]))))
    return entries.join(parts, "entry_id").select("entry_id", F.col("wins").alias("success_signals"), F.col("losses").alias("failure_signals"), fold.alias("confidence"))


def buckets(outcomes: DataFrame, keep: int = 50) -> DataFrame:
    """(entry_id, bucket, successes, total): counts by context, from all three parts down to one; the ``keep`` largest of an entry.

    ``outcomes``: entry_id, task, error, ext, success; empty parts make no bucket of their own. In one batch the least used go at the end.
    """
    t, e, x = F.col("task"), F.col("error"), F.col("ext")
    some = lambda *cs: F.when(_all_set(cs), F.concat_ws("/", *cs))
    any_task = F.lit("*")
    names = F.array(some(t, e, x), some(t, e), some(any_task, e, x), some(any_task, e), some(t))
    rows = outcomes.select("entry_id", "success", F.explode(F.filter(names, lambda n: n.isNotNull())).alias("bucket"))
    counted = rows.groupBy("entry_id", "bucket").agg(F.sum(F.col("success").cast("long")).alias("successes"), F.count("*").alias("total"))
    place = F.row_number().over(Window.partitionBy("entry_id").orderBy(F.col("total").desc(), "bucket"))
    return counted.withColumn("place", place).where(F.col("place") <= keep).drop("place")


def _all_set(columns) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & (F.coalesce(c, F.lit("")) != "")
    return out


def contrast(results: DataFrame) -> DataFrame:
    """(cluster, entry_id, wins, losses, boost) from ``results`` (cluster, entry_id, problem, success): 0.4 times the win rate over peers less one half.

    A win is a peer that failed where the entry succeeded, a loss the reverse: counts a problem, no pairs.
    """
    per = results.groupBy("cluster", "problem").agg(F.sum(F.col("success").cast("long")).alias("ok"), F.sum((~F.col("success")).cast("long")).alias("bad"))
    joined = results.join(materialize(per, "problems"), ["cluster", "problem"])
    sums = joined.groupBy("cluster", "entry_id").agg(F.sum(F.when(F.col("success"), F.col("bad")).otherwise(0)).alias("wins"), F.sum(F.when(F.col("success"), 0).otherwise(F.col("ok"))).alias("losses"))
    n = F.col("wins") + F.col("losses")
    return sums.withColumn("boost", F.when(n == 0, 0.0).otherwise((F.col("wins") / F.nullif(n, F.lit(0)) - 0.5) * 0.4))


def with_peers(hits: DataFrame, episodes: DataFrame, most: int = 2) -> DataFrame:
    """(rank, place, fact_id): hits in order, each episode followed by up to ``most`` others of its prompt, the earliest first, none twice.

    ``hits``: rank, fact_id, kind, prompt; ``episodes``: fact_id, prompt, event_time (valid ones). The hits of one prompt take turns, so only the first
    ``most`` times that many peers of a prompt are looked at.
    """
    asked = hits.where("kind = 'episode' and prompt <> ''")
    turn = asked.withColumn("turn", F.row_number().over(Window.partitionBy("prompt").orderBy("rank")) - 1)
    order = F.row_number().over(Window.partitionBy("prompt").orderBy("event_time", "fact_id")) - 1
    peers = episodes.join(hits.select("fact_id"), "fact_id", "left_anti").join(asked.select("prompt").distinct(), "prompt", "left_semi").withColumn("at", order)
    given = peers.withColumn("turn", F.floor(F.col("at") / most)).join(turn.select("prompt", "turn", "rank"), ["prompt", "turn"])
    return hits.select("rank", F.lit(0).cast("long").alias("place"), "fact_id").unionByName(given.select("rank", (F.col("at") % most + 1).cast("long").alias("place"), "fact_id"))


def observations(facts: DataFrame, mined: DataFrame) -> DataFrame:
    """(fact_id, kind, authority): topics that recurred (fact_id), for valid facts only; nothing about the facts changes."""
    live = facts.where("is_valid").select("fact_id")
    return mined.join(live, "fact_id", "left_semi").select("fact_id", F.lit("topic_recurrence").alias("kind"), F.lit("observation_only").alias("authority"))


def batch_change(sessions: DataFrame, current: DataFrame) -> DataFrame:
    """One row a project: differences of ``current`` (project, god_files, cycles, depth, covered, files) from the oldest unprocessed session's snapshot.

    ``sessions``: project, ts and the same columns, null without a snapshot. Projects without one, or with no files on either side, have no row.
    """
    fields = ["god_files", "cycles", "depth", "covered", "files"]
    first = sessions.where("files is not null").groupBy("project").agg(F.min(F.struct("ts", *fields)).alias("b"))
    both = current.join(first, "project").where((F.col("files") > 0) & (F.col("b.files") > 0))
    return both.select("project", *[(F.col(c) - F.col(f"b.{c}")).alias(c) for c in fields[:3]], (F.col("covered") & F.col("b.covered")).alias("covered"))
