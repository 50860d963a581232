"""A persistent keyword index as tables: repository walk, change states, postings of what changed, import edges."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tessera.functions.rules import language_of, suffix
from tessera.functions.text import code_tokens
from tessera.operators.budget import slots
from tessera.operators.ignore import ignored
from tessera.scratch import materialize

#: Characters read of a file; files whose terms are counted at once.
READ_CHARS, AT_ONCE = 200_000, 256


def walk(spark: SparkSession, folder: str, exts: list[str] | None = None, rules: list[str] | None = None, most: int | None = None) -> DataFrame:
    """(path, size, mtime) of the files under ``folder``, relative, of these extensions, not ignored, of at most ``most`` bytes; sorted by path.

    Only names are listed: no content is read unless a column asks for it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = re.sub(r"^(?:[a-z]+:)?/*|/+$", "", folder)
    whole = F.regexp_replace("path", r"^[a-z]+:/*", "")
    rows = files.select(F.ltrim(F.substring_index(whole, root, -1), F.lit("/")).alias("path"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime"), "content")
    if exts:
        rows = rows.where(suffix(F.col("path")).isin(*[e.lower().lstrip(".") for e in exts]))
    if rules:
        rows = rows.where(~ignored(F.col("path"), rules))
    if most is not None:
        rows = rows.where(F.col("size") <= most)
    return rows.select("path", "size", "mtime", "content").orderBy("path")


def text_of(content: Column, chars: int = READ_CHARS) -> Column:
    """The first ``chars`` characters of a file's bytes as valid UTF-8 (the bound is the feature); empty for null and binary files."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.when(content.isNull() | F.contains(content, F.lit(b"\0")), "").otherwise(F.substring(text, 1, chars))


def _state() -> Column:
    same = (F.col("size") == F.col("old_size")) & (F.col("mtime") == F.col("old_mtime"))
    return (
        F.when(F.col("mtime").isNull(), "removed").when(F.col("old_mtime").isNull(), "added").when(same, "unchanged").when(F.col("hash") == F.col("old_hash"), "touched").otherwise("changed")
    )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, term, tf) of (path, terms), some files at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            some = batch.slice(at, AT_ONCE)
            paths, terms = some.column("path"), some.column("terms")
            counts = pa.table({"row": pc.list_parent_indices(terms), "term": terms.flatten()}).group_by(["row", "term"]).aggregate([([], "count_all")])
            yield from pa.table({"path": paths.take(counts["row"].combine_chunks()), "term": counts["term"], "tf": counts["count_all"]}).to_batches()


def refresh(files: DataFrame, postings: DataFrame, current: DataFrame, stored_signature: str, signature: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, postings, report) after the stored index was brought level with ``current`` (path, size, mtime, hash, text).

    ``files``: path, size, mtime, hash; ``postings``: path, term, tf. Another signature wipes what is stored. Equal size and
    time mean unchanged, then the hash decides; only added and changed texts are cut into terms (the path counts three times). The report
    counts the states, with ``mode``: cold, rebuilt, incremental or warm.
    """
    if stored_signature != signature:
        files, postings = files.where(F.lit(False)), postings.where(F.lit(False))
    old = files.select("path", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.col("hash").alias("old_hash"))
    states = materialize(current.select("path", "size", "mtime", "hash").join(old, "path", "full_outer").withColumn("state", _state()), "states")
    fresh = current.join(states.where("state in ('added', 'changed')").select("path"), "path", "left_semi")
    terms = code_tokens(F.concat_ws(" ", "path", "path", "path", F.coalesce("text", F.lit(""))))
    new = fresh.select("path", terms.alias("terms")).mapInArrow(_counted, "path string, term string, tf long")
    if not states.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").isEmpty():  # rows of one path are one file
        new = new.groupBy("path", "term").agg(F.sum("tf").alias("tf"))
    kept = postings.join(states.where("state in ('unchanged', 'touched')").select("path"), "path", "left_semi").select("path", "term", "tf")
    any_old, moved = F.max(F.col("old_mtime").isNotNull()), F.max(~F.col("state").isin("unchanged"))
    wiped = F.lit(stored_signature not in ("", signature))
    mode = states.agg(F.when(wiped, "rebuilt").when(~F.coalesce(any_old, F.lit(False)), "cold").when(moved, "incremental").otherwise("warm").alias("mode"))
    report = states.groupBy("state").agg(F.count("*").alias("files")).crossJoin(F.broadcast(mode))  # one row
    return states.where("state <> 'removed'").select("path", "size", "mtime", "hash"), kept.unionByName(new), report


def stratified(files: DataFrame, most: int) -> DataFrame:
    """(path, language, place) of at most ``most`` files (path, hash): one of each content, languages in proportion, shallow paths first."""
    first = files.groupBy("hash").agg(F.min("path").alias("path")).withColumn("language", language_of(F.col("path"))).where("language is not null")
    given = slots(first.groupBy("language").agg(F.count("*").alias("n")), "language", "n", most).select("language", "slots")
    depth = F.size(F.split("path", "/"))
    place = F.row_number().over(Window.partitionBy("language").orderBy(depth, "path"))
    return first.withColumn("place", place).join(given, "language").where("place <= slots").select("path", "language", "place")


def import_edges(files: DataFrame) -> DataFrame:
    """(source, target) from Python files (module, text): ``import a.b`` gives a.b, ``from a import b`` a and a.b; no loops, each once."""
    # Lines without the word are no imports; they are left out before they are rows.
    lines = files.select("module", F.explode(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.contains(x, F.lit("import")))).alias("line"))
    plain = F.regexp_extract("line", r"^\s*import\s+(.+?)\s*(?:#.*)?$", 1)
    source = F.regexp_extract("line", r"^\s*from\s+([\w.]+)\s+import\s+\(?(.+?)\)?\s*(?:#.*)?$", 1)
    names = F.split(F.regexp_extract("line", r"^\s*from\s+([\w.]+)\s+import\s+\(?(.+?)\)?\s*(?:#.*)?$", 2), r"\s*,\s*")
    bare = lambda n: F.regexp_extract(n, r"^\s*([\w.]+)", 1)
    found = F.when(plain != "", F.transform(F.split(plain, ","), bare)).when(
        source != "", F.concat(F.array(source), F.transform(F.filter(names, lambda n: bare(n) != ""), lambda n: F.concat(source, F.lit("."), bare(n))))
    )
    edges = lines.select(F.col("module").alias("source"), F.explode(found).alias("target"))
    return edges.where((F.col("target") != "") & (F.col("target") != F.col("source"))).distinct()


def edges_of(edges: DataFrame, symbol: str, kind: str | None = None) -> DataFrame:
    """Edges (source, target, ...) that touch a symbol, of one kind if given."""
    hit = (F.col("source") == symbol) | (F.col("target") == symbol)
    return edges.where(hit if kind is None else hit & (F.col("kind") == kind))
