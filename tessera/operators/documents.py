"""Parsers of text files as columns: markdown sections, rule bullets, front matter, embedded JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def _lines(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(key, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))


def _joined(lines: str, separator: str):
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", F.col(lines).alias("line")))), lambda s: s["line"]), separator)


def markdown_sections(docs: DataFrame, key: str) -> DataFrame:
    """(key, section, title, body) of ``## `` sections; text before the first belongs to none."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("line").startswith("## ")
    s = _lines(docs, key).withColumn("section", F.sum(head.cast("long")).over(w)).where("section > 0")
    s = s.withColumns({"head": F.when(head, F.trim(F.substring("line", 4, 1 << 30))), "text_line": F.when(~head, F.col("line"))})
    return s.groupBy(key, "section").agg(F.max("head").alias("title"), _joined("text_line", "\n").alias("body"))


def rule_units(docs: DataFrame, key: str) -> DataFrame:
    """(key, unit, rule): each ``- `` bullet with its continuation lines, up to the next bullet or heading."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    bullet = F.col("line").startswith("- ")
    s = _lines(docs, key).withColumn("unit", F.sum((bullet | F.col("line").startswith("#")).cast("long")).over(w)).where("unit > 0")
    s = s.withColumns({"bullet": bullet, "said": F.trim(F.when(bullet, F.substring("line", 3, 1 << 30)).otherwise(F.col("line")))})
    return s.groupBy(key, "unit").agg(F.bool_or("bullet").alias("bullet"), _joined("said", " ").alias("rule")).where("bullet").drop("bullet")


def front_matter(docs: DataFrame, key: str) -> DataFrame:
    """(key, name, type, malformed) from a leading ``---`` block; nulls become empty."""
    block = F.regexp_extract(F.coalesce("text", F.lit("")), r"(?s)^---\n(.*?)\n---", 1)
    field = lambda name: F.regexp_extract(block, rf"(?m)^{name}:[ \t]*(.*)$", 1)
    return docs.select(key, field("name").alias("name"), field("type").alias("type"), ((field("name") == "") | (field("type") == "")).alias("malformed"))


def repair_json(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """Adds value (struct) and error_code (ok, no_object, invalid): the first flat object in a string, trailing commas dropped."""
    found = F.regexp_extract(F.coalesce(column, F.lit("")), r"(\{[^{}]*\})", 1)
    value = F.from_json(F.regexp_replace(found, r",[ \t\n]*\}", "}"), schema)
    code = F.when(F.col("_found") == "", "no_object").when(F.col("value").isNull(), "invalid").otherwise("ok")
    return rows.withColumn("_found", found).withColumn("value", F.when(found != "", value)).withColumn("error_code", code).drop("_found")


def design_patterns(files: DataFrame) -> DataFrame:
    """(path, name, author, intent, forces, solution, consequences, references, lines, errors) of pattern files (path, text).

    A file needs a ``# Pattern:`` line, an ``Author:`` line and the four sections from intent to consequences (any title with ``solution``
    is that one; of equal titles the last counts), else it is left out. ``errors``: sections under ten characters, over 300 lines.
    """
    rows = files.select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "raw")).withColumn("line", F.rtrim("raw"))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    name, author, head = F.col("line").startswith("# Pattern:"), F.col("line").startswith("Author:"), F.col("line").startswith("## ")
    s = rows.withColumn("section", F.sum(head.cast("long")).over(w))
    after = lambda mark: F.trim(F.replace("line", F.lit(mark), F.lit("")))
    tops = s.groupBy("path").agg(
        F.coalesce(F.max_by(F.when(name, after("# Pattern:")), F.when(name, F.col("line_no"))), F.lit("")).alias("name"),
        F.coalesce(F.max_by(F.when(author, after("Author:")), F.when(author, F.col("line_no"))), F.lit("")).alias("author"), F.count("*").alias("lines"),
    )
    bodies = s.where(F.col("section") > 0).where(~name & ~author).groupBy("path", "section").agg(
        F.max(F.when(head, F.lower(F.trim(F.replace("line", F.lit("##"), F.lit("")))))).alias("title"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~head, F.struct("line_no", "line")))), lambda x: x["line"]), "\n").alias("body"),
    )
    title = F.when(F.contains("title", F.lit("solution")), "solution").otherwise(F.col("title"))
    last = bodies.groupBy("path", title.alias("title")).agg(F.max_by("body", "section").alias("body")).withColumn("body", F.regexp_replace("body", r"^\s+|\s+$", ""))
    parts = ["intent", "forces", "solution", "consequences", "references"]
    wide = last.groupBy("path").agg(*[F.max(F.when(F.col("title") == p, F.col("body"))).alias(p) for p in parts])
    needed = F.lit(True)
    for p in parts[:4]:
        needed = needed & F.col(p).isNotNull()
    short = [F.when(F.length(p) < 10, F.lit(f"{p} is too short")) for p in parts[:4]]
    errors = F.filter(F.array(F.when(F.col("lines") > 300, F.lit("too many lines")), *short), lambda e: e.isNotNull())
    good = tops.where("name <> '' and author <> ''").join(wide, "path").where(needed)
    return good.select("path", "name", "author", *parts[:4], F.coalesce("references", F.lit("")).alias("references"), "lines", errors.alias("errors"))
