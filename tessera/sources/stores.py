"""Readers, writers and importers of fact stores: JSON by scope, datasets, rule files, legacy entries, keyed entries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.operators.documents import markdown_sections
from tessera.operators.ranking import ranked
from tessera.scratch import materialize

# Prefixes of legacy patterns and the kinds that they become, in their order.
LEGACY_KINDS = {"feature": "decision", "bugfix": "failure", "refactor": "architecture", "algorithm": "pattern", "explanation": "pattern", "parse_failure": "failure"}


def read_scopes(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(facts, corrupt lines) of JSON-lines files under ``path``, in folders ``scope=...``; a bad line costs itself only and is kept as it is."""
    rows = spark.read.schema(f"{schema}, _line string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line").json(path)
    rows = materialize(rows, "facts")  # a corrupt column alone cannot be read from the files
    return rows.where("_line is null").drop("_line"), rows.where("_line is not null").select(F.col("_line").alias("line"))


def write_scopes(facts: DataFrame, path: str) -> None:
    """Facts as JSON lines in a folder for each scope; scopes that have rows are replaced, others stay."""
    facts.write.partitionBy("scope").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)


def union_sources(*sources: tuple[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """(rows of all sources that can be read, errors of the others by name): one source's failure does not stop the rest."""
    out, errors = None, {}
    for name, load in sources:
        try:
            rows = materialize(load().withColumn("source_name", F.lit(name)), "source")
        except Exception as e:  # noqa: BLE001 - a source may fail in any way; its error is returned
            errors[name] = str(e).split("\n")[0]
            continue
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out, errors


def modified_since(spark: SparkSession, folder: str, since: str) -> DataFrame:
    """Text lines of the files of a folder that changed after a time (ISO); others are not opened."""
    return spark.read.option("modifiedAfter", since).option("recursiveFileLookup", "true").text(folder)


def entry_hash(pattern: Column, suggestion: Column) -> Column:
    return F.substring(F.sha2(F.concat(pattern, F.lit("||"), suggestion), 256), 1, 16)


def import_dataset(rows: DataFrame, mapping: dict[str, str], existing: DataFrame, order: str, limit: int) -> DataFrame:
    """New entries of the first ``limit`` dataset rows: mapped columns, non-empty pattern and suggestion, each content hash once and not in ``existing`` (hash).

    Only where there are more rows than ``limit`` are they put in order, over all tasks. The first row of each hash is found without
    the texts; a reader who needs no texts shuffles none.
    """
    text = lambda name, default: F.coalesce(F.col(mapping.get(name, default)).cast("string"), F.lit(""))
    first = ranked(rows, [], [F.col(order)], "_place").where(F.col("_place") <= limit) if rows.count() > limit else rows
    extra = [F.coalesce(F.col(mapping[c]).cast("string"), F.lit("")).alias(c) for c in ("context", "reasoning", "algorithm_type") if c in mapping]
    named = first.select(order, text("pattern", "text").alias("pattern"), text("suggestion", "code").alias("suggestion"), *extra).where("pattern <> '' and suggestion <> ''")
    hashed = named.withColumn("hash", entry_hash(F.col("pattern"), F.col("suggestion")))
    new = hashed.groupBy("hash").agg(F.min(F.struct(order)).alias("f")).join(existing.select("hash").distinct(), "hash", "left_anti")
    theirs = hashed.withColumn("f", F.struct(order)).join(new, ["hash", "f"]).drop("f")
    rest = [c for c in hashed.columns if c not in (order, "hash")]
    return theirs.groupBy("hash", order).agg(*[F.min_by(c, F.struct(*rest)).alias(c) for c in rest])


def ingest_rules(files: DataFrame, checksums: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new facts, superseded fact ids, checksums) of rule files (path, text) against stored checksums (path, checksum).

    A file of the same checksum changes nothing. Another replaces its valid constraints by its sections that have a body.
    """
    now = files.select("path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("checksum"), F.coalesce("text", F.lit("")).alias("text"))
    changed = materialize(now.join(checksums, ["path", "checksum"], "left_anti"), "changed_rules")
    old = facts.where("is_valid and kind = 'constraint'").join(changed.select(F.col("path").alias("source_file")), "source_file", "left_semi").select("fact_id")
    sections = markdown_sections(changed, "path").where(F.trim(F.regexp_replace("body", r"\s+", " ")) != "")
    new = sections.select(F.col("path").alias("source_file"), F.col("title").alias("subject"), F.regexp_replace("body", r"^\s+|\s+$", "").alias("body"), F.lit("constraint").alias("kind"), F.lit(1.0).alias("confidence"))
    kept = checksums.join(changed.select("path"), "path", "left_anti").select("path", "checksum")
    return new, old, kept.unionByName(changed.select("path", "checksum"))


def migrate(entries: DataFrame, scope: str) -> DataFrame:
    """(subject, body, kind, scope, tags) of legacy entries (pattern, reasoning, suggestion, code_template, pitfalls, when_to_use, algorithm_type, category)."""
    low, kind = F.lower("pattern"), None
    for prefix, name in LEGACY_KINDS.items():
        kind = F.when(low.startswith(prefix), name) if kind is None else kind.when(low.startswith(prefix), name)
    part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}: "), c))
    pitfalls = F.array_join(F.coalesce("pitfalls", F.array().cast("array<string>")), "; ")
    body = F.concat_ws("\n", part("Reasoning", F.col("reasoning")), part("Suggestion", F.col("suggestion")), part("Code template", F.col("code_template")), part("Pitfalls", pitfalls), part("When to use", F.col("when_to_use")))
    tags = F.filter(F.array(F.lit("migrated"), F.nullif(F.col("algorithm_type"), F.lit("")), F.nullif(F.col("category"), F.lit(""))), lambda t: t.isNotNull())
    rows = entries.where(F.coalesce("pattern", F.lit("")) != "")
    return rows.select(F.substring("pattern", 1, 100).alias("subject"), F.when(body != "", body).otherwise(F.col("pattern")).alias("body"), kind.otherwise("pattern").alias("kind"), F.lit(scope).alias("scope"), tags.alias("tags"))


class EntryStore:
    """Entries by key, each key a written table in the folder ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, key: str) -> str:
        return f"{self.root}/{''.join(c if c.isalnum() or c in '-_' else f'%{ord(c):x}' for c in key)}"

    def save(self, key: str, rows: DataFrame) -> None:
        """Replace a key's entries. Rows read from the same key are written beside them first."""
        materialize(rows, "entries").write.mode("overwrite").parquet(self._path(key))

    def load(self, key: str, schema: str) -> DataFrame:
        """A key's entries; an unknown key has none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(key))
        known = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(self._path(key)) if known else self.spark.createDataFrame([], schema)
