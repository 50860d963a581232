"""File selection for a prompt: named and included files first, then content, boosts, caps and fair shares of a budget."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.rules import explicit_paths, names_path, suffix, targets_tests
from tessera.functions.text import code_tokens, is_test_path
from tessera.operators.budget import fair_shares
from tessera.operators.ignore import ignored
from tessera.operators.retrieval import bm25, normalized
from tessera.operators.structure import definitions, edges
from tessera.scratch import materialize

# Fixed values.
DOCUMENTS, ARCHIVES = ["readme", "architecture", "design", "claude.md", "contributing", "docs/"], ["archive", "old", "deprecated"]
ENTRIES = ["main", "app", "server", "index", "login", "auth", "__init__"]
BROAD = ["readme", "main", "app", "__init__", "index", "setup", "config"]
BAR, NAMED, CONTENT, PINNED_SHARE, TESTS = 0.2, 10.0, 3.0, 0.5, 0.4
SYMBOL_CHARS, SYMBOL_FILES = 50_000, 50


def _some(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda k: F.contains(text, k))


def matches_any(path: Column, globs: list[str]) -> Column:
    """Shell patterns whose ``*`` spans slashes."""
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(fnmatch.translate(g).replace("(?s:", "(?s)(?:").replace(r")\z", r")$").replace(r")\Z", r")$"))
    return out


def file_score(path: Column, content: Column, tokens: list[str], recent: Column, demote_tests: Column) -> Column:
    """Documentation, archives, content, file-name hits, recency, entry points and depth; tests are ranked down, never out."""
    low = F.lower(path)
    hits = sum((F.contains(low, F.lit(t)).cast("int") for t in tokens), F.lit(0))
    name = F.substring_index(low, "/", -1)
    entry = F.exists(F.array(*map(F.lit, ENTRIES)), lambda e: F.startswith(name, e))
    base = (
        F.when(_some(low, DOCUMENTS), 0.8).otherwise(0.0) - F.when(_some(low, ARCHIVES), 0.5).otherwise(0.0) + CONTENT * content + 0.15 * F.least(F.lit(3), hits)
        + F.when(recent, 0.3).otherwise(0.0) + F.when(entry, 0.2).otherwise(0.0)
    )
    demoted = is_test_path(path) & demote_tests
    score = F.when(demoted, base * 0.4).otherwise(base) - 0.05 * (F.size(F.split(path, "/")) - 1)
    forfeited = F.when(demoted, base * 0.6).otherwise(0.0)
    kept = F.when((forfeited != 0) & (score + forfeited >= BAR), F.greatest(score, F.lit(BAR))).otherwise(score)
    return F.greatest(F.lit(0.0), kept)


def boosted(scored: DataFrame, *boosts: DataFrame) -> DataFrame:
    """(path, score) with every boost (path, boost) added; a path that only a boost names enters at its boost."""
    out = scored.select("path", "score")
    for b in boosts:
        per = b.groupBy("path").agg(F.sum("boost").alias("boost"))
        out = out.join(per, "path", "full_outer").select("path", (F.coalesce("score", F.lit(0.0)) + F.coalesce("boost", F.lit(0.0))).alias("score"))
    return out


def _held(term: Column) -> Column:
    return F.exists("names", lambda n: F.contains(n, term) | F.contains(term, n))


def semantic_boost(hits: DataFrame, demote_tests: Column, weight: float = 1.0) -> DataFrame:
    """(path, boost): the best similarity of each file's chunks among ``hits`` (path, similarity), not below 0, times ``weight``; less for tests."""
    near = F.greatest(F.lit(0.0), F.col("similarity"))
    shown = F.when(is_test_path(F.col("path")) & demote_tests, near * TESTS).otherwise(near)
    return hits.groupBy("path").agg(F.max(shown * weight).alias("boost"))


def history_boost(facts: DataFrame) -> DataFrame:
    """(path, boost): 0.15 for each of ``facts`` (tags) that names a file in a tag ``file:<path>``, 0.5 at most."""
    named = facts.select(F.explode(F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.startswith(t, F.lit("file:")))).alias("tag"))
    return named.groupBy(F.substring("tag", 6, 1 << 30).alias("path")).agg(F.least(F.lit(0.5), F.count("*") * 0.15).alias("boost"))


def symbol_boost(files: DataFrame, terms: list[str]) -> DataFrame:
    """(path, boost): 0.4 for each of the ``terms`` of over three letters, three at most, that holds or is held by a name that the file (path, text) defines or imports.

    Names come from the first 50 000 characters, which is the feature.
    """
    head = materialize(files.select("path", F.substring("text", 1, SYMBOL_CHARS).alias("text")), "symbol_files")
    own = definitions(head).where("name is not null").select("path", "name")
    names = own.unionByName(edges(head).where("kind = 'imports'").select("path", F.col("target").alias("name")))
    known = names.groupBy("path").agg(F.collect_set(F.lower("name")).alias("names"))
    long = [t for t in terms if len(t) > 3]
    hits = sum((_held(F.lit(t)).cast("int") for t in long), F.lit(0))
    return known.select("path", (0.4 * F.least(hits, F.lit(3))).alias("boost")).where("boost > 0")


def select_files(
    files: DataFrame, prompt: str, limit: int, budget: int, includes: list[str] = (), excludes: list[str] = (), exts: list[str] = (), boosts: list[DataFrame] = ()
) -> DataFrame:
    """(path, pinned, score, size, share) of the files (path, size, text, recent) that a prompt gets.

    Files that the prompt names or an include matches are pinned and come first, with half of ``budget`` where others compete. The
    rest is ranked: keyword relevance of its content over the files that the flags admit, the file score, 10 for a named path. Scores of 0.2 and more
    stay (a prompt of up to five words keeps five architecture files besides; if none reaches 0.2, the ten best stay), boosts are added, the
    names in the code of the best ``max(50, 3 * limit)`` are met with the prompt, and the best ``limit`` share the budget max-min fair.
    Texts are read where they lie, for the keywords and for the names; what is written of a file is its path, size and marks.
    """
    spark = files.sparkSession
    asked = spark.range(1).select(explicit_paths(F.lit(prompt)).alias("p"), targets_tests(F.lit(prompt)).alias("t"), F.array_distinct(code_tokens(F.lit(prompt))).alias("w")).first()
    paths = F.array(*map(F.lit, asked.p)) if asked.p else F.array().cast("array<string>")
    admitted = ~ignored(F.col("path"), list(excludes)) if excludes else F.lit(True)
    in_exts = suffix(F.col("path")).isin(*exts) if exts else F.lit(True)
    included = matches_any(F.col("path"), list(includes)) if includes else F.lit(False)
    named = names_path(F.col("path"), paths)
    scan = in_exts & (included if includes else F.lit(True))
    pool = materialize(files.where(admitted).select("path", "size", "recent", (named | included).alias("pinned"), scan.alias("scan"), named.alias("named")), "candidates")
    terms = [t for t in asked.w if len(t) > 2]
    relevance = normalized(bm25(files.where(admitted & scan), "path", code_tokens(F.concat_ws(" ", "path", "path", "path", F.coalesce("text", F.lit("")))), terms))
    rows = pool.where("scan").join(relevance.select(F.col("doc").alias("path"), F.col("score").alias("content")), "path", "left").na.fill(0.0, ["content"])
    own = file_score(F.col("path"), F.col("content"), terms, F.col("recent"), F.lit(not asked.t)) + F.when(F.col("named"), NAMED).otherwise(0.0)
    scored = materialize(rows.select("path", F.round(own, 9).alias("score")).where("score > 0"), "scored")
    good = scored.where(F.col("score") >= BAR)
    if len(asked.w) <= 5:
        broad = scored.where(_some(F.lower("path"), BROAD)).orderBy(F.col("score").desc(), "path").limit(5)
        good = good.unionByName(broad).distinct()
    if good.isEmpty():
        good = scored.orderBy(F.col("score").desc(), "path").limit(10)
    eligible = boosted(good, *boosts).join(pool.where("pinned").select("path"), "path", "left_anti")
    best = materialize(eligible.orderBy(F.col("score").desc(), "path").limit(max(SYMBOL_FILES, 3 * limit)), "best")
    symbols = symbol_boost(files.where(admitted).join(F.broadcast(best.select("path")), "path", "left_semi"), terms)  # of at most max(50, 3 * limit) files
    ranked = materialize(boosted(best, symbols).orderBy(F.col("score").desc(), "path").limit(limit), "ranked")
    sizes = files.select("path", "size")
    pins = pool.where("pinned").select("path", F.lit(True).alias("pinned"), F.lit(None).cast("double").alias("score"), "size")
    rest = ranked.join(sizes, "path").select("path", F.lit(False).alias("pinned"), "score", "size")
    compete = not ranked.isEmpty()
    pinned = fair_shares(pins.withColumn("grp", F.lit(0)), "grp", "size", max(1, int(budget * PINNED_SHARE)) if compete else budget, "path")
    pinned = materialize(pinned.drop("grp"), "pinned")
    spent = pinned.agg(F.coalesce(F.sum("share"), F.lit(0)).alias("s")).first().s
    return pinned.unionByName(fair_shares(rest.withColumn("grp", F.lit(0)), "grp", "size", max(0, budget - spent), "path").drop("grp"))


def place_of(rows: DataFrame) -> DataFrame:
    """Adds ``place``: pinned files by path, then the others by score."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.col("pinned").desc(), F.col("score").desc_nulls_first(), "path")))
