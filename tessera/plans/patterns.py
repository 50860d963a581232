"""Queries of overlaps, prompt analysis, prevention patterns and structural metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import diffs as D, prompts as P
from tessera.operators import patterns as O
from tessera.plans.sessions import QUERIES as SESSIONS, _turns
from tessera.sources.tables import read


def diff_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggested diffs and code against actual diffs, made from the lines of every document."""
    n = F.col("doc_id")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    sign = lambda k: F.transform(lines, lambda x, i: F.when((i + n) % k == 0, F.concat(F.lit("+"), x)).when((i + n) % k == 1, F.concat(F.lit("-"), x)).otherwise(F.concat(F.lit(" "), x)))
    diff = lambda k: F.concat(F.lit("--- a\n+++ b\n@@ 1 @@\n"), F.array_join(sign(k), "\n"))
    d = read(spark, sf_dir, "documents").select("doc_id", F.when(n % 3 > 0, diff(2)).otherwise("").alias("suggested"), diff(3).alias("actual"), F.coalesce("text", F.lit("")).alias("code"))
    return d.select("doc_id", F.round(D.diff_overlap(F.col("suggested"), F.col("actual")), 6).alias("diff"), F.round(D.code_overlap(F.col("code"), F.col("actual")), 6).alias("code"), D.verdict(F.col("suggested"), F.col("code"), F.col("actual")).alias("verdict"))


def _signed(k: int) -> str:
    return f"list_transform(l, lambda x, i: case (i - 1 + doc_id) % {k} when 0 then '+' || x when 1 then '-' || x else ' ' || x end)"


_S = r"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"
OVERLAPS = rf"""with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
s as (select doc_id, l, list_distinct(list_filter(list_transform(case when doc_id % 3 > 0 then {_signed(2)} else [] end, lambda x: {_S.format(x="x")}), lambda x: regexp_matches(x, '^[+-]') and not regexp_matches(x, '^(\+\+\+|---|@@)'))) as a,
  list_distinct(list_filter(list_transform({_signed(3)}, lambda x: {_S.format(x="x")}), lambda x: regexp_matches(x, '^[+-]') and not regexp_matches(x, '^(\+\+\+|---|@@)'))) as b,
  list_distinct(list_filter(list_transform(l, lambda x: {_S.format(x="x")}), lambda x: x <> '')) as c,
  list_distinct(list_filter(list_transform(list_filter({_signed(3)}, lambda x: starts_with(x, '+') and not starts_with(x, '+++')), lambda x: {_S.format(x="substring(x, 2)")}), lambda x: x <> '')) as e from d),
o as (select doc_id, case when len(a) = 0 and len(b) = 0 then 1.0 when len(a) = 0 or len(b) = 0 then 0.0 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) end::double as x,
  case when len(c) = 0 and len(e) = 0 then 1.0 when len(c) = 0 or len(e) = 0 then 0.0 else len(list_intersect(c, e)) / least(len(c), len(e)) end::double as y from s)
select doc_id, round(x, 6) as diff, round(y, 6) as code, case when doc_id % 3 > 0 then case when x > 0.3 then 'accepted' else 'modified' end when y >= 0.8 then 'accepted' else 'modified' end as verdict from o"""


def prompt_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The negative signals of all prompts, the most frequent first."""
    return O.analysis(P.signals(_turns(spark, sf_dir)))


_NEGATIVE = [f for f in P.FLAGS if P.WEIGHTS[f] < 0]
ANALYSIS = f"""with s as ({SESSIONS["prompt_signals"][1]}), c as ({" union all ".join(f"select '{f}' as signal, count(*) filter ({f}) as prompts from s" for f in _NEGATIVE)})
select signal, prompts from c where prompts > 0 order by prompts desc, signal limit 5"""


def effectiveness_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effectiveness entries by the structure of prompts: mean score, samples, confidence, signals."""
    s = P.signals(_turns(spark, sf_dir)).withColumn("text", P.structural_key(F.col("text")))
    e = O.effectiveness_entries(s, "conv_id", "turn")
    return e.select("prompt_hash", F.round("score", 6).alias("score"), "samples", F.round("confidence", 6).alias("confidence"), F.array_join("signals", ",").alias("signals"), "iterations")


def prevention_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prevention patterns made from orders, merged by category and size, and the benchmark items that they apply to."""
    k = F.col("o_orderkey")
    pick = lambda v, n: F.element_at(F.array(*[F.array(*map(F.lit, x)) if isinstance(x, list) else F.lit(x) for x in v]), (n % len(v) + 1).cast("int"))
    p = read(spark, sf_dir, "orders").select(
        k.alias("ordinal"), F.col("o_orderpriority").alias("category"), pick([["tion", "ing "], ["heit", "ung", "schaft"], ["the "], ["zzz", "qqq", "ción", "mente"]], k).alias("keywords"),
        F.when(k % 13 == 0, "**").otherwise("check").alias("rule"), F.when(k % 17 == 0, None).otherwise("slip").alias("mistake"), (k % 10 / 10).alias("confidence"), k.cast("string").alias("example"),
    )
    items = read(spark, sf_dir, "benchmark")
    out = O.applicable(items.select("item_id", "text"), F.col("text"), O.pattern_store(p))
    return out.select("item_id", "category", "hits", F.round("confidence", 6).alias("confidence"))


STORE = """with p as (select o_orderkey as k, o_orderpriority as category, [['tion','ing '],['heit','ung','schaft'],['the '],['zzz','qqq','ción','mente']][(o_orderkey % 4 + 1)::int] as kw, (o_orderkey % 10 / 10)::double as c from orders where o_orderkey % 13 > 0 and o_orderkey % 17 > 0),
s as (select category, kw, list_reduce(list(c order by k), lambda x, y: (x + y) / 2) as confidence from p group by all),
h as (select item_id, category, len(list_filter(kw, lambda w: contains(lower(text), w)))::int as hits, len(kw) as n, confidence from benchmark, s)
select item_id, category, hits, round(confidence, 6) as confidence from h where hits * 2 >= n"""


def structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural metrics of Python modules made from documents: each imports its neighbour in a ring of ten."""
    n = F.col("doc_id")
    ring = F.floor(n / 10) * 10 + (n + 1) % 10
    text = F.concat(F.lit("import m"), ring.cast("string"), F.lit("\n"), F.repeat(F.lit("def f():\n    if x:\n        pass\n"), (n % 40).cast("int")), F.repeat(F.lit("x = 1\n"), (n % 9 * 100).cast("int")))
    files = read(spark, sf_dir, "documents").select(F.concat(F.lit("m"), n.cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit("m"), n.cast("string")).alias("module"), text.alias("text"))
    return O.structural_metrics(files)


STRUCTURE = """with d as (select doc_id, doc_id // 10 as ring, doc_id % 40 as functions, 2 + 3 * (doc_id % 40) + doc_id % 9 * 100 as lines from documents), r as (select ring, count(*) as n from d group by 1)
select (select count(*) from d) as files, (select count(*) from d where lines > 800 or functions > 30) as god_files, (select case when max(functions) > 0 then 1 else 0 end from d)::int as max_depth, (select count(*) from r where n = 10) as cycles"""

QUERIES = {
    "diff_overlaps": (diff_overlaps, OVERLAPS),
    "prompt_analysis": (prompt_analysis, ANALYSIS),
    "effectiveness_entries": (effectiveness_entries, None),
    "prevention_store": (prevention_store, STORE),
    "structure": (structure, STRUCTURE),
}
