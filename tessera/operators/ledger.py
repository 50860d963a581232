"""Sessions, suggestions and roots as tables: pending work, untrackable outcomes, rewrites of logs, aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.rules import is_untrackable
from tessera.operators.patches import unified_diff  # noqa: F401

PENDING_SECONDS, SKEW_SECONDS = 14 * 86400, 2


def pending(sessions: DataFrame, changed: DataFrame, now: float) -> DataFrame:
    """(session, ts, waiting, scanned_through) of sessions that still wait on a suggested path.

    ``sessions``: session, ts, path, resolved, normalized; ``changed``: path of files changed since. A suggestion waits unless its path changed, is
    resolved or can never show up in a diff; a session older than 14 days is abandoned. The watermark backs off by two seconds.
    """
    seen = changed.select(F.col("path").alias("normalized")).distinct()
    open_ = sessions.where((F.col("ts") >= now - PENDING_SECONDS) & ~F.col("resolved") & ~is_untrackable(F.col("path"), F.col("normalized"))).join(seen, "normalized", "left_anti")
    return open_.groupBy("session", "ts").agg(F.count("*").alias("waiting")).withColumn("scanned_through", F.lit(now - SKEW_SECONDS))


def unverified(sessions: DataFrame) -> DataFrame:
    """(session, path): outcomes of suggestions that no diff can confirm."""
    return sessions.where(is_untrackable(F.col("path"), F.col("normalized"))).select("session", "path").distinct()


def rewritten(log: DataFrame, loaded: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """A log after its ``loaded`` records were processed: those ``kept`` and what peers appended since."""
    return log.join(loaded.select(key).distinct(), key, "left_anti").unionByName(kept)


def changed_since(commits: DataFrame, working: DataFrame, since: float) -> DataFrame:
    """Distinct paths of commits (ts, path) from ``since`` on and of the working tree (path)."""
    return commits.where(F.col("ts") >= since).select("path").union(working.select("path")).distinct()


def first_spelling(files: DataFrame) -> DataFrame:
    """Of files (ordinal, path, device, inode) that are one file under several names: adds ``canonical``, the first name."""
    first = files.groupBy("device", "inode").agg(F.min(F.struct("ordinal", "path")).alias("f"))
    return files.join(first.select("device", "inode", F.col("f.path").alias("canonical")), ["device", "inode"])


def first_asks(episodes: DataFrame) -> DataFrame:
    """Of episodes (ordinal, ask) the first of each ask, white space at the ends and case aside."""
    sign = F.lower(F.regexp_replace("ask", r"(?U)^\s+|\s+$", ""))
    return episodes.groupBy(sign.alias("sign")).agg(F.min(F.struct("ordinal", "ask")).alias("f"), F.count("*").alias("copies")).select("f.ordinal", "f.ask", "copies")


def project_roots(paths: DataFrame) -> DataFrame:
    """Distinct roots (path) that contain no other root, sorted. Each root names its own ancestors, so no pairs are compared."""
    roots = paths.select(F.regexp_replace("path", r"(?<=.)/+$", "").alias("path")).where("path <> ''").distinct()
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    holders = roots.select("path", F.explode(above).alias("root")).where("root <> path").select(F.col("root").alias("path")).distinct()
    return roots.join(holders, "path", "left_anti").orderBy("path")


def by_signature(candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """(candidate_id, fact_id): valid facts that were minted under the candidate's canonical signature, the smallest id if there are several."""
    live = facts.where("is_valid and signature <> ''").groupBy("signature").agg(F.min("fact_id").alias("fact_id"))
    return candidates.join(live, "signature").select("candidate_id", "fact_id")


def relinked(candidates: DataFrame, promoted: DataFrame, cleared: DataFrame) -> DataFrame:
    """Candidates (candidate_id, promoted_fact_id, ...) with the links of ``promoted`` (candidate_id, fact_id) set and links to ``cleared`` (fact_id) taken off."""
    new = promoted.groupBy("candidate_id").agg(F.min("fact_id").alias("_new"))
    gone = cleared.select(F.col("fact_id").alias("_link")).distinct().withColumn("_gone", F.lit(True))
    linked = candidates.join(new, "candidate_id", "left").withColumn("_link", F.coalesce("_new", "promoted_fact_id")).join(gone, "_link", "left")
    return linked.withColumn("promoted_fact_id", F.when(F.col("_gone").isNull(), F.col("_link"))).select(candidates.columns)


def ordered_union(*lists: Column) -> Column:
    """Distinct values of several lists, by first appearance."""
    return F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))
