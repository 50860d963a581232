"""Queries of importers, code symbols, consolidation, sweeps and gates, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators.code import gates, python_symbols, select_regions
from tessera.operators.graph import connected_components
from tessera.operators.similarity import jaccard_pairs
from tessera.scratch import kept_path
from tessera.sources import stores as S
from tessera.sources.tables import facts, read


def import_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset import: pages as rows, those of known hashes left out, each content once."""
    p = read(spark, sf_dir, "documents").select("doc_id", F.concat("lang", F.lit(" "), F.substring_index("text", " ", 3)).alias("problem"), F.when(F.col("doc_id") % 17 == 0, "").otherwise(F.coalesce("text", F.lit(""))).alias("solution"))
    known = p.where("doc_id % 9 = 0").select(S.entry_hash(F.coalesce("problem", F.lit("")), F.col("solution")).alias("hash"))
    return S.import_dataset(p, {"pattern": "problem", "suggestion": "solution"}, known, "doc_id", 1 << 30).select("doc_id", "hash")


IMPORT = """with p as (select doc_id, coalesce(concat(lang, ' ', array_to_string(string_split(text, ' ')[1:3], ' ')), '') as problem, case when doc_id % 17 = 0 then '' else coalesce(text, '') end as solution from documents),
h as (select doc_id, problem, solution, substring(sha256(problem || '||' || solution), 1, 16) as hash from p)
select min(doc_id) as doc_id, hash from h where problem <> '' and solution <> '' and hash not in (select hash from h where doc_id % 9 = 0) group by hash"""


def rule_ingestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule files against stored checksums: the new constraints of changed files, by file."""
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("path"), "doc_id", F.concat(F.lit("intro\n## one\n"), F.coalesce("text", F.lit("")), F.lit("\n## two\n  \n## three\nbody "), F.col("doc_id").cast("string")).alias("text"))
    stored = d.where("doc_id % 3 = 0").select("path", F.sha2("text", 256).alias("checksum"))
    new, _, _ = S.ingest_rules(d.select("path", "text"), stored, spark.createDataFrame([], "fact_id long, source_file string, kind string, is_valid boolean"))
    return new.where("subject in ('one', 'three')").groupBy("source_file").agg(F.count("*").alias("sections"))


RULE_INGESTION = r"""select 'r' || doc_id as source_file, 1 + (regexp_matches(split_part(coalesce(text, '') || chr(10) || '## ', chr(10) || '## ', 1), '\S') and not starts_with(coalesce(text, ''), '## '))::int as sections from documents where doc_id % 3 > 0"""


def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts written as JSON by scope and read back, with a corrupt line among them."""
    path = kept_path(spark, "facts")
    f = facts(read(spark, sf_dir, "events")).select("fact_id", "scope", "kind", "confidence")
    S.write_scopes(f, path)
    spark.createDataFrame([('{"fact_id": 1, "kind',)], "value string").coalesce(1).write.mode("append").text(f"{path}/scope=global")
    good, bad = S.read_scopes(spark, path, "fact_id long, kind string, confidence double, scope string")
    return good.groupBy("scope", "kind").agg(F.count("*").alias("facts"), F.round(F.avg("confidence"), 6).alias("confidence")).unionByName(
        bad.agg(F.lit("corrupt").alias("scope"), F.lit("line").alias("kind"), F.count("*").alias("facts"), F.lit(0.0).alias("confidence"))
    )


def _round_trip_sql() -> str:
    from tessera.plans.search import FACTS_SQL

    return f"with {FACTS_SQL} select scope, kind, count(*) as facts, round(avg(confidence), 6) as confidence from facts group by all union all select 'corrupt', 'line', 1, 0.0"


def legacy_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy entries made from orders, as facts by kind."""
    k = F.col("o_orderkey")
    pick = lambda v, n: F.element_at(F.array(*map(F.lit, v)), (n % len(v) + 1).cast("int"))
    e = read(spark, sf_dir, "orders").select(
        F.concat(pick(["Feature: ", "bugfix ", "refactor-", "", "other ", "PARSE_FAILURE "], k), F.when(k % 6 == 3, "").otherwise(F.col("o_orderpriority"))).alias("pattern"), F.when(k % 2 == 0, F.col("o_orderstatus")).alias("reasoning"),
        F.lit("").alias("suggestion"), F.lit(None).cast("string").alias("code_template"), F.when(k % 5 == 0, F.array(F.lit("a"), F.lit("b"))).alias("pitfalls"), F.lit(None).cast("string").alias("when_to_use"), pick(["dp", ""], k).alias("algorithm_type"), F.lit("").alias("category"),
    )
    return S.migrate(e, "global").groupBy("kind", "subject", "body", F.array_join("tags", ",").alias("tags")).agg(F.count("*").alias("n"))


MIGRATION = """with e as (select ['Feature: ','bugfix ','refactor-','','other ','PARSE_FAILURE '][(o_orderkey % 6 + 1)::int] || case when o_orderkey % 6 = 3 then '' else o_orderpriority end as p, case when o_orderkey % 2 = 0 then o_orderstatus end as r, o_orderkey % 5 = 0 as pit,
  case when o_orderkey % 2 = 0 then 'migrated,dp' else 'migrated' end as tags from orders)
select case when p like 'Feature%' then 'decision' when p like 'bugfix%' or p like 'PARSE%' then 'failure' when p like 'refactor%' then 'architecture' else 'pattern' end as kind, p as subject,
  case when r is null and not pit then p else concat_ws(chr(10), case when r is not null then 'Reasoning: ' || r end, case when pit then 'Pitfalls: a; b' end) end as body, tags, count(*) as n from e where p <> '' group by all"""


def symbol_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and classes of Python files made around each document's text (as a docstring), with stubs."""
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\\\"\x00]", " ")
    n = F.col("doc_id")
    tail = F.element_at(F.array(*map(F.lit, ["        pass\n", "        ...\n", "        raise NotImplementedError\n", "        return 1\n"])), (n % 4 + 1).cast("int"))
    source = F.concat(F.lit("class A:\n    def f(self):\n        \"\"\"x "), body, F.lit("\"\"\"\n"), tail, F.lit("def g():\n    for i in x:\n        if i:\n            pass\n"), F.when(n % 10 == 0, "def (").otherwise(""))
    s = python_symbols(read(spark, sf_dir, "documents").select(F.concat(F.lit("f"), n.cast("string"), F.lit(".py")).alias("path"), source.alias("text")))
    return s.select("path", "name", "kind", "depth", "stub")


SYMBOLS = """with d as (select doc_id, 'f' || doc_id || '.py' as path from documents)
select path, null as name, 'unreadable' as kind, null::int as depth, null as stub from d where doc_id % 10 = 0
union all select path, 'A', 'class', 0, null from d where doc_id % 10 > 0
union all select path, 'A.f', 'function', 0, case doc_id % 4 when 0 then 'pass' when 1 then 'ellipsis' when 2 then 'not implemented' end from d where doc_id % 10 > 0
union all select path, 'g', 'function', 2, null from d where doc_id % 10 > 0"""


def file_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions of every long document that answer a prompt."""
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "text")
    return select_regions(d, ["todo", "und", "the", "ción"], 2_000)


def entry_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy writes: the first of near-twin texts enters at 0.3, later ones move its confidence by a tenth towards theirs, up to 0.95."""
    d = read(spark, sf_dir, "conversations").where("role = 'user' and text is not null")
    d = d.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.array_distinct(F.filter(F.split(F.lower("text"), r"[ \t\n\r\f]+"), lambda t: t != "")).alias("tokens"), (0.2 + (F.col("conv_id") + F.col("turn")) % 8 / 10).alias("confidence"))
    # Equal sets are twins whatever their number; only their first meets others.
    sign = d.withColumn("sign", F.sha2(F.array_join(F.sort_array("tokens"), " "), 256))
    first = sign.groupBy("sign").agg(F.min(F.struct("id", "tokens")).alias("f")).select("sign", "f.id", "f.tokens")
    pairs = jaccard_pairs(first.where("size(tokens) > 0").select("id", "tokens"), 0.8)
    labels = connected_components(pairs, "a", "b").withColumnRenamed("node", "id")
    owner = first.join(labels, "id", "left").select("sign", F.coalesce("component", "id").alias("entry_id"))
    per = sign.join(owner, "sign").groupBy("entry_id").agg(F.sort_array(F.collect_list(F.struct("id", "confidence"))).alias("writes"))
    fold = F.aggregate(F.slice("writes", F.lit(2), F.greatest(F.size("writes") - 1, F.lit(0))), F.lit(0.3).cast("double"), lambda c, w: F.least(F.lit(0.95), 0.9 * c + 0.1 * w["confidence"]))
    return per.select("entry_id", F.size("writes").alias("writes"), F.round(fold, 6).alias("confidence"))


def sweep_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next 40 projects of a budgeted sweep: those swept longest ago, in turn, without those in their cooldown of an hour, or of a day after a failure."""
    f = facts(read(spark, sf_dir, "events"))
    due = f.where(F.lit(1706745600.0) - F.col("last_accessed") >= F.when(F.col("error_count") > 0, 86400).otherwise(3600))
    return due.orderBy("last_accessed", "fact_id").limit(40).select("fact_id", F.round("last_accessed", 3).alias("last_accessed"))


def _sweep_sql() -> str:
    from tessera.plans.search import FACTS_SQL

    return f"with {FACTS_SQL} select fact_id, round(last_accessed, 3) as last_accessed from facts where 1706745600 - last_accessed >= case when error_count > 0 then 86400 else 3600 end order by facts.last_accessed, fact_id limit 40"


def evaluation_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of the event log against their limits."""
    e = read(spark, sf_dir, "events")
    rate = lambda kind: F.round(F.count(F.when(F.col("event_type") == kind, 1)) / F.count("*"), 6)
    one = e.agg(rate("error").alias("error"), rate("purchase").alias("purchase"), rate("view").alias("view"))
    metrics = one.select(F.explode(F.create_map(*[x for c in ("error", "purchase", "view") for x in (F.lit(c), F.col(c))])).alias("metric", "value"))
    limits = spark.createDataFrame([("error", None, 0.0), ("purchase", 0.01, None), ("view", 0.1, 0.9), ("latency", None, 500.0)], "metric string, at_least double, at_most double")
    return gates(metrics, limits)


EVALUATION = """with e as (select count(*) as n, count(*) filter (event_type = 'error') as error, count(*) filter (event_type = 'purchase') as purchase, count(*) filter (event_type = 'view') as v from events)
select 'error' as metric, round(error / n, 6) as value, round(error / n, 6) <= 0 as passed from e union all select 'purchase', round(purchase / n, 6), round(purchase / n, 6) >= 0.01 from e
union all select 'view', round(v / n, 6), round(v / n, 6) between 0.1 and 0.9 from e union all select 'latency', null, false"""

def pattern_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Design-pattern files made around each document's text: their sections and what is wrong with them."""
    from tessera.operators.documents import design_patterns

    n = F.col("doc_id")
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?m)^(## |# Pattern:|Author:)", "x")
    text = F.concat(
        F.when(n % 7 == 0, "").otherwise(F.concat(F.lit("# Pattern: P"), n.cast("string"))), F.lit("\nAuthor: "), F.when(n % 11 == 0, "").otherwise("me"), F.lit("\n## Intent\n"), body, F.lit("\n## Forces\nshort\n## Solution Sketch\nlong enough text\n"),
        F.when(n % 5 > 0, "## Consequences\nten and more\n").otherwise(""), F.lit("## References\n"),
    )
    p = design_patterns(read(spark, sf_dir, "documents").select(F.concat(F.lit("p"), n.cast("string")).alias("path"), text.alias("text")))
    return p.select("path", "name", "solution", "references", F.array_join("errors", ", ").alias("errors"))


PATTERNS = r"""with d as (select doc_id, regexp_replace(coalesce(text, ''), '(?m)^(## |# Pattern:|Author:)', 'x', 'g') as body from documents where doc_id % 7 > 0 and doc_id % 11 > 0 and doc_id % 5 > 0),
b as (select doc_id, length(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(body, chr(10)), lambda x: rtrim(x, ' ')), chr(10)), '^\s+', ''), '\s+$', '')) as n, len(string_split(body, chr(10))) + 10 as lines from d)
select 'p' || doc_id as path, 'P' || doc_id as name, 'long enough text' as solution, '' as "references", array_to_string(list_filter([case when lines > 300 then 'too many lines' end, case when n < 10 then 'intent is too short' end, 'forces is too short'], lambda x: x is not null), ', ') as errors from b"""


def problem_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints that problems state: benchmark items behind a sentence or two."""
    from tessera.functions.rules import stated_constraints

    said = ["Return a sorted array. ", "Strictly increasing, no duplicates. ", "A multiple of 12 and Divisible by 7; ", "values >= 0 in non-decreasing order ", "sum modulo 9 is 0, decreasing ", ""]
    p = F.concat(F.element_at(F.array(*map(F.lit, said)), (F.col("item_id") % 6 + 1).cast("int")), "text")
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(stated_constraints(p), " ").alias("constraints"))


CONSTRAINTS = """with p as (select item_id, lower(['Return a sorted array. ','Strictly increasing, no duplicates. ','A multiple of 12 and Divisible by 7; ','values >= 0 in non-decreasing order ','sum modulo 9 is 0, decreasing ',''][(item_id % 6 + 1)::int] || text) as t from benchmark)
select item_id, array_to_string(list_filter([case when regexp_matches(t, 'sorted array|sorted list|in sorted order|non-decreasing') then 'sorted' end, case when contains(t, 'increasing') and not contains(t, 'sorted') then 'increasing' end,
  case when contains(t, 'decreasing') then 'decreasing' end, 'divisible:' || nullif(regexp_extract(t, 'divisible by ([0-9]+)', 1), ''), 'divisible:' || nullif(regexp_extract(t, 'multiple of ([0-9]+)', 1), ''),
  'divisible:' || nullif(regexp_extract(t, 'modulo ([0-9]+) (is|equals) 0', 1), ''), case when regexp_matches(t, 'non-negative|non negative|positive integer|≥ 0|>= 0') then 'non_negative' end,
  case when regexp_matches(t, 'unique|distinct|no duplicates|all different') then 'unique' end], lambda x: x is not null), ' ') as constraints from p"""


def consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts that have a vector, consolidated by connected groups of cosine 0.85."""
    from tessera.operators.clusters import consolidate

    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("fact_id"), "embedding")
    out = consolidate(facts(read(spark, sf_dir, "events")).join(v, "fact_id"), "fact_id", "embedding")
    return out.select("cluster", "members", F.round("confidence", 6).alias("confidence"), "success_count", "tags")


QUERIES = {
    "pattern_files": (pattern_files, PATTERNS),
    "problem_constraints": (problem_constraints, CONSTRAINTS),
    "consolidation": (consolidation, None),
    "import_entries": (import_entries, IMPORT),
    "rule_ingestion": (rule_ingestion, RULE_INGESTION),
    "store_round_trip": (store_round_trip, _round_trip_sql()),
    "legacy_migration": (legacy_migration, MIGRATION),
    "symbol_index": (symbol_index, SYMBOLS),
    "file_regions": (file_regions, None),
    "entry_admission": (entry_admission, None),
    "sweep_order": (sweep_order, _sweep_sql()),
    "evaluation_gates": (evaluation_gates, EVALUATION),
}
