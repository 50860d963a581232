"""Include patterns resolved against files: what each matched, what was rescued, refused or matched nothing.

A pattern first meets the files that a walk admits (not ignored, no link, of an extension asked for, not over ``WALK_BYTES``), as a
shell pattern whose ``*`` spans slashes. One that matches none of them is taken as the path of one file: that file is rescued past
the walk's limits on size and extension, but refused, with the reason, where it is a link, ignored or over ``RESCUE_BYTES``.

Exact patterns meet files by their path. Others meet the files below the folder that they begin with, by that folder, or else those
with the extension that they end in; only a pattern that fixes neither looks at all files. Patterns are broadcast if they are
counted few. Repeated patterns are one; null and empty ones match nothing.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.rules import suffix
from tessera.operators.ignore import ignored
from tessera.scratch import materialize

WALK_BYTES, RESCUE_BYTES, FEW = 512 * 1024, 64 * 1024 * 1024, 10_000


def _regexes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for patterns in batches:
        yield patterns.map(lambda p: "(?s)^" + fnmatch.translate(p or "").removeprefix("(?s:").removesuffix(r")\z").removesuffix(r")\Z") + "$")


def normal_path(pattern: Column, root: str) -> Column:
    """The relative path that a pattern spells: without ``root``, ``.``, and ``..`` after a folder; null if it leaves the root."""
    inside = F.when(F.startswith(pattern, F.lit(root.rstrip("/") + "/")), pattern.substr(F.lit(len(root.rstrip("/")) + 2), F.length(pattern))).otherwise(F.ltrim(pattern, F.lit("/")))
    parts = F.filter(F.split(inside, "/"), lambda p: ~p.isin("", "."))
    up = lambda held, p: F.when(p != "..", F.concat(held, F.array(p))).when(F.size(held) > 0, F.slice(held, F.lit(1), F.size(held) - 1)).otherwise(F.lit(None))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda held, p: F.when(held.isNull(), held).otherwise(up(held, p)))
    return F.when(F.size(folded) > 0, F.array_join(folded, "/"))


def _ancestors(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def _keys(how: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(how).alias("how"), v.alias("value")))


def resolve(files: DataFrame, patterns: DataFrame, rules: list[str] = (), exts: list[str] = (), root: str = "/") -> DataFrame:
    """(state, pattern, path, reason): one row for each file that is ``matched`` or ``rescued`` (under the first pattern that names it) and for each pattern that is ``refused`` or ``unmatched``.

    ``files``: path (relative), size, link; ``patterns``: ordinal, pattern.
    """
    folders = F.filter(_ancestors(F.col("path")), lambda a: a != F.col("path"))
    barred = F.exists(folders, lambda a: ignored(F.concat(a, F.lit("/\x01")), list(rules))) if rules else F.lit(False)
    files = files.select("path", "size", F.coalesce("link", F.lit(False)).alias("link"), barred.alias("barred"), (ignored(F.col("path"), list(rules)) if rules else F.lit(False)).alias("ignored"))
    walked = files.where(~F.col("link") & ~F.col("barred") & ~F.col("ignored") & (F.col("size") <= WALK_BYTES))
    walked = walked.where(suffix(F.col("path")).isin(*[e.lower().lstrip(".") for e in exts])) if exts else walked

    asked = patterns.where(F.coalesce("pattern", F.lit("")) != "").groupBy("pattern").agg(F.min("ordinal").alias("ordinal"))
    glob, p = F.col("pattern").rlike(r"[*?\[]"), F.col("pattern")
    literal = F.regexp_extract(p, r"^([^*?\[]*)/[^/]*", 1)
    ending = F.regexp_extract(p, r"[*?\]]\.?[^*?\[\]./]*\.([^*?\[\]./]+)$", 1)
    by = F.when(~glob, F.struct(F.lit("path").alias("how"), p.alias("value"))).when(literal != "", F.struct(F.lit("folder").alias("how"), literal.alias("value")))
    by = by.when(ending != "", F.struct(F.lit("suffix").alias("how"), F.lower(ending).alias("value"))).otherwise(F.struct(F.lit("all").alias("how"), F.lit("").alias("value")))
    asked = materialize(asked.select("ordinal", "pattern", F.pandas_udf(_regexes, "string")(p).alias("regex"), by.alias("by")), "patterns")
    few = F.broadcast if asked.count() <= FEW else (lambda side: side)

    ways = {"path": F.array("path"), "folder": folders, "suffix": F.array(suffix(F.col("path"))), "all": F.array(F.lit(""))}
    used = [r.how for r in asked.select("by.how").distinct().collect()]  # at most four
    keys = F.concat(*[_keys(how, ways[how]) for how in used]) if used else F.array().cast("array<struct<how:string,value:string>>")
    met = walked.select("path", F.explode(keys).alias("by")).join(few(asked), "by").where(F.regexp_like("path", F.col("regex")))
    met = materialize(met.select("ordinal", "pattern", "path"), "matched")

    rest = asked.join(met.select("pattern").distinct(), "pattern", "left_anti").select("ordinal", "pattern", normal_path(F.col("pattern"), root).alias("path"))
    tried = rest.join(files, "path", "left")
    reason = F.when(F.col("link"), "a link").when(F.col("barred"), "inside an ignored folder").when(F.col("ignored"), "ignored").when(F.col("size") > RESCUE_BYTES, "too large")
    tried = tried.select("ordinal", "pattern", F.when(F.col("size").isNotNull(), F.col("path")).alias("path"), reason.alias("reason"))
    state = F.when(F.col("path").isNull(), "unmatched").when(F.col("reason").isNotNull(), "refused").otherwise("rescued")
    tried = tried.select(state.alias("state"), "ordinal", "pattern", "path", "reason")
    every = met.select(F.lit("matched").alias("state"), "ordinal", "pattern", "path", F.lit(None).cast("string").alias("reason")).unionByName(tried)
    named = every.where("state in ('matched', 'rescued')")
    first = named.groupBy("path").agg(F.min(F.struct("ordinal", "pattern", "state")).alias("f")).select("f.state", "f.pattern", "path", F.lit(None).cast("string").alias("reason"))
    return first.unionByName(every.where("state in ('refused', 'unmatched')").select("state", "pattern", "path", "reason"))
