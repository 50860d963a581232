"""Prompt analysis, effectiveness entries, prevention patterns and structural metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.prompts import FLAGS, WEIGHTS
from tessera.operators.code import python_symbols
from tessera.operators.cycles import cycle_groups
from tessera.operators.index import import_edges

GOD_LINES, GOD_FUNCTIONS = 800, 30


def analysis(scored: DataFrame, most: int = 5) -> DataFrame:
    """(signal, prompts): how often each negative signal occurs among scored prompts (the flags of ``signals``), the ``most`` frequent."""
    negative = [f for f in FLAGS if WEIGHTS[f] < 0]
    sums = scored.agg(*[F.count(F.when(F.col(f), 1)).alias(f) for f in negative])
    pairs = sums.select(F.explode(F.array(*[F.struct(F.lit(f).alias("signal"), F.col(f).alias("prompts")) for f in negative])).alias("p")).select("p.*")
    return pairs.where("prompts > 0").orderBy(F.col("prompts").desc(), "signal").limit(most)


def effectiveness_entries(scored: DataFrame, *order: str) -> DataFrame:
    """(prompt_hash, score, samples, confidence, signals, iterations): one entry for each prompt text: mean score, 0.5 and 0.1 more a sample
    up to 0.95, the signals of all, the last's iterations."""
    held = F.filter(F.array(*[F.when(F.col(f), F.lit(f)) for f in FLAGS]), lambda x: x.isNotNull())
    rows = scored.select(F.sha2("text", 256).alias("prompt_hash"), "score", "iterations", held.alias("held"), F.struct(*order).alias("at"))
    per = rows.groupBy("prompt_hash").agg(
        F.avg("score").alias("score"), F.count("*").alias("samples"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("held")))).alias("signals"), F.max_by("iterations", "at").alias("iterations")
    )
    return per.select("prompt_hash", "score", "samples", F.least(F.lit(0.95), 0.5 + 0.1 * (F.col("samples") - 1)).alias("confidence"), "signals", "iterations")


def entry_counts(entries: DataFrame) -> DataFrame:
    """(entry_type, entries, projects) of a knowledge base."""
    return entries.groupBy("entry_type").agg(F.count("*").alias("entries"), F.countDistinct("project").alias("projects"))


def pattern_store(patterns: DataFrame) -> DataFrame:
    """(category, size, keywords, confidence, examples) from patterns (ordinal, category, keywords, rule, mistake, confidence, example).

    Patterns without keywords, a rule or a mistake (stars aside) are rejected. Equal category and number of keywords make one: the first's
    keywords, confidence moved halfway to each later one's, all examples in order.
    """
    said = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^[\s*]+|[\s*]+$", "") != ""
    good = patterns.where((F.size("keywords") > 0) & said(F.col("rule")) & said(F.col("mistake")))
    per = good.groupBy("category", F.size("keywords").alias("size")).agg(F.sort_array(F.collect_list(F.struct("ordinal", "keywords", F.col("confidence").cast("double").alias("confidence"), "example"))).alias("all"))
    rest = F.slice("all", F.lit(2), F.greatest(F.size("all") - 1, F.lit(0)))
    folded = F.aggregate(rest, F.col("all")[0]["confidence"], lambda c, p: (c + p["confidence"]) / 2)
    return per.select("category", "size", F.col("all")[0]["keywords"].alias("keywords"), folded.alias("confidence"), F.transform("all", lambda p: p["example"]).alias("examples"))


def applicable(texts: DataFrame, text: Column, store: DataFrame, most: int = 10_000) -> DataFrame:
    """``texts`` with ``category``, ``hits`` and ``confidence`` of every stored pattern of whose keywords the text holds half.

    The store has a row for each category and number of keywords; more than ``most`` are an error, as they are handed to each text as one literal.
    """
    rows = store.select("category", "keywords", "confidence").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} patterns")
    if not rows:
        return texts.withColumns({"category": F.lit(""), "hits": F.lit(0), "confidence": F.lit(0.0)}).where(F.lit(False))
    known = F.array(*[F.struct(F.lit(r.category).alias("category"), F.array(*map(F.lit, r.keywords)).alias("keywords"), F.lit(r.confidence).alias("confidence")) for r in rows])
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.transform(known, lambda p: F.struct(p["category"].alias("category"), F.size(F.filter(p["keywords"], lambda k: F.contains(low, k))).alias("hits"), F.size(p["keywords"]).alias("n"), p["confidence"].alias("confidence")))
    hit = F.filter(found, lambda p: p["hits"] * 2 >= p["n"])
    return texts.select("*", F.explode(hit).alias("_p")).select(*texts.columns, "_p.category", "_p.hits", "_p.confidence")


def structural_metrics(files: DataFrame) -> DataFrame:
    """One row of Python files (path, module, text): files, god_files (over 800 lines or 30 functions), max_depth and import cycles (groups of modules)."""
    symbols = python_symbols(files).groupBy("path").agg(F.count(F.when(F.col("kind") == "function", 1)).alias("functions"), F.max("depth").alias("depth"), F.max((F.col("kind") == "unreadable").cast("int")).alias("bad"))
    lines = files.select("path", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("lines"))
    per = lines.join(symbols, "path", "left").where("coalesce(bad, 0) = 0").agg(
        F.count("*").alias("files"), F.count(F.when((F.col("lines") > GOD_LINES) | (F.coalesce("functions", F.lit(0)) > GOD_FUNCTIONS), 1)).alias("god_files"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth")
    )
    node = lambda c: F.xxhash64(c)
    edges = import_edges(files.select("module", "text")).select(node("source").alias("src"), node("target").alias("dst"))
    cycles = cycle_groups(edges).agg(F.countDistinct("component").alias("cycles"))
    return per.crossJoin(F.broadcast(cycles))  # one row each
