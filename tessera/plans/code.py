"""A query of the structure of code files, with its SQL: every document as a class whose methods hold the document's lines as comments and strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators import structure as S
from tessera.scratch import materialize
from tessera.sources.tables import read


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): JavaScript, Java, C#, C++ or Python by the id; a line that is not blank becomes a method, every third of which swallows errors."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "").alias("lines"))
    kind, base = F.col("doc_id") % 5, F.concat(F.lit("Base"), (F.col("doc_id") % 7).cast("string"))
    ext = F.element_at(F.array(*map(F.lit, ["js", "java", "cs", "cpp", "py"])), (kind + 1).cast("int"))
    quoted = lambda x: F.regexp_replace(x, r"[\\\"]", "'")
    name = lambda i: F.concat(F.lit("f"), i.cast("string"))
    handled = lambda i, none, some: F.when(i % 3 == 0, F.lit(none)).otherwise(F.lit(some))
    braced = F.transform("lines", lambda x, i: F.concat(
        F.when(kind == 0, F.lit("  ")).otherwise(F.lit("  int ")), name(i), F.lit("(a) { // "), x, F.lit('\n    say("{'), quoted(x), F.lit('");\n    try { go(a); } catch (e) { '), handled(i, "/* none */", "tell(e);"), F.lit(" }\n  }\n"),
    ))
    indented = F.transform("lines", lambda x, i: F.concat(
        F.lit("    def "), name(i), F.lit("(self, a):  # "), x, F.lit('\n        say("def x(): '), quoted(x), F.lit('")\n        try:\n            go(a)\n        except Error:\n            '), handled(i, "pass", "tell()"), F.lit("\n"),
    ))
    own = F.concat(F.lit("class Doc"), F.col("doc_id").cast("string"))
    parent = F.when(kind < 2, F.lit(" extends ")).when(kind == 3, F.lit(" : public ")).otherwise(F.lit(" : "))
    text = F.when(kind == 4, F.concat(own, F.lit("("), base, F.lit("):\n    n = 1\n"), F.array_join(indented, ""))).otherwise(F.concat(own, parent, base, F.lit(" {\n"), F.array_join(braced, ""), F.lit("}\n")))
    return materialize(d.select(F.concat(F.lit("src/d"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), text.alias("text")), "code")


def code_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, methods (and those directly in the class), bases and swallowed errors of each file."""
    files = _files(spark, sf_dir)
    found = materialize(S.blocks(files).withColumn("content", F.lit("")), "blocks")  # no column here tells of contents
    defined = materialize(S.definitions(files, found).drop("content", "start", "end"), "defined")
    d = defined.groupBy("path").agg(
        F.max(F.when(F.col("kind") == "class", F.col("name"))).alias("class"), F.count(F.when(F.col("kind") == "function", 1)).alias("methods"), F.count("within").alias("inside"), F.max("last").alias("lines")
    )
    bases = S.edges(files, defined).where("kind = 'inherits'").groupBy("path").agg(F.max("target").alias("base"))
    silent = S.swallowed(files, found).groupBy("path").agg(F.count("*").alias("swallowed"))
    return d.join(bases, "path", "left").join(silent, "path", "left").select("path", "class", "methods", "inside", "lines", "base", F.coalesce("swallowed", F.lit(0)).alias("swallowed"))


STRUCTURE = """with d as (select doc_id, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')) as n from documents)
select 'src/d' || doc_id || '.' || ['js', 'java', 'cs', 'cpp', 'py'][(doc_id % 5 + 1)::int] as path, 'Doc' || doc_id as class, n as methods, n as inside,
  case when doc_id % 5 = 4 then 2 + 6 * n else 2 + 4 * n end as lines, 'Base' || (doc_id % 7) as base, (n + 2) // 3 as swallowed from d"""

QUERIES = {"code_structure": (code_structure, STRUCTURE)}
