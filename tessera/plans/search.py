"""Search queries: keyword, vector, hybrid and routed retrieval, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.functions import scores as S
from tessera.functions.text import code_tokens, tokenize
from tessera.operators import retrieval as R
from tessera.operators.routing import classify, decompose
from tessera.sources.tables import facts, read

TERMS = ["the", "and", "tion", "die", "menteau", "the"]
CODE_TERMS = ["the", "src", "of", "and"]
NOW = 1706745600.0

_TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')"
_BM25 = """
docs as (select {key} as doc, {tokens} as toks from {table} {where}),
stats as (select count(*) as n, avg(len(toks)) as avgdl from docs),
tf as (select doc, len(toks) as dl, t.term, len(list_filter(toks, lambda x: x = t.term)) as tf, t.times
       from docs, (values {terms}) as t(term, times)),
df as (select term, count(*) filter (tf > 0) as df from tf group by term),
scored as (select doc, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score
           from tf join df using (term), stats where tf > 0 group by doc)"""


def _bm25_sql(table: str, key: str, tokens: str, terms: list[str], where: str = "") -> str:
    counted = {t: terms.count(t) for t in terms}
    values = ", ".join(f"('{t}', {n})" for t, n in counted.items())
    return _BM25.format(table=table, key=key, tokens=tokens, terms=values, where=where)


def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = R.normalized(R.bm25(read(spark, sf_dir, "documents"), "doc_id", tokenize(F.col("text")), TERMS))
    rounded = scored.select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))
    return R.top_k(rounded, "score", 20, "doc_id")


BM25_SEARCH = f"""with {_bm25_sql("documents", "doc_id", _TOKENS, TERMS)},
r as (select doc as doc_id, round(score / max(score) over (), 6) as score from scored)
select doc_id, score, rank from (select *, row_number() over (order by score desc, doc_id) as rank from r) where rank <= 20"""


def bm25_code_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", "source", "source", "source", "text")
    scored = R.bm25(read(spark, sf_dir, "documents"), "doc_id", code_tokens(text), CODE_TERMS)
    return R.top_k(scored.select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score")), "score", 20, "doc_id")


_CODE = """(select list_concat(list_filter(string_split_regex(concat_ws(' ', source, source, source, text), '[^A-Za-z0-9]+'), lambda t: t <> '')
  .list_transform(lambda t: lower(t)), flatten(list_filter(list_filter(string_split_regex(concat_ws(' ', source, source, source, text), '[^A-Za-z0-9]+'), lambda t: t <> '')
  .list_transform(lambda t: string_split(regexp_replace(regexp_replace(t, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), ' ')), lambda p: len(p) > 1))
  .list_transform(lambda t: lower(t))))"""
BM25_CODE = f"""with {_bm25_sql("documents", "doc_id", _CODE, CODE_TERMS)},
r as (select doc as doc_id, round(score, 6) as score from scored)
select doc_id, score, rank from (select *, row_number() over (order by score desc, doc_id) as rank from r) where rank <= 20"""


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, grp, vector): every vector of ``embeddings`` and two later revisions of it, each farther away, by an amount that its id sets."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("own"), F.col("label").alias("grp"), F.col("embedding").cast("array<double>").alias("x"))
    e = e.withColumn("k", F.explode(F.array(*map(F.lit, range(3)))))
    off = lambda i: ((F.col("own") * 31 + i * 17) % 7 - 3) * (1 + F.col("own") % 5) * F.col("k")
    return e.select((F.col("own") + F.col("k") * F.lit(10**9)).alias("id"), "grp", F.transform("x", lambda v, i: v + F.lit(0.01) * off(i)).alias("vector"))


REVISIONS = """revisions as (select vec_id + k * 1000000000 as vec_id, label, list_transform(embedding, lambda v, i: v::double + 0.01::double * (((vec_id * 31 + (i - 1) * 17) % 7 - 3) * (1 + vec_id % 5) * k)) as embedding
  from embeddings, (select unnest(range(3)) as k))"""


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    query = vectors.where("vec_id = 0").select("embedding").first()
    return R.vector_top_k(vectors, list(query[0]) if query else [], 20)


_DOT = "list_sum(list_transform(list_zip({a}::double[], {b}::double[]), lambda z: z[1] * z[2]))"
_COS = "(" + _DOT.format(a="{a}", b="{b}") + " / (sqrt(" + _DOT.format(a="{a}", b="{a}") + ") * sqrt(" + _DOT.format(a="{b}", b="{b}") + ")))"
VECTOR_TOPK = f"""with q as (select embedding as qe from embeddings where vec_id = 0),
r as (select vec_id, round({_COS.format(a="embedding", b="qe")}, 6) as score from embeddings, q)
select vec_id, score, rank from (select *, row_number() over (order by score desc, vec_id) as rank from r) where rank <= 20"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid, non-constraint facts about documents, with both similarities and the rank score."""
    vectors = read(spark, sf_dir, "embeddings")
    query = vectors.where("vec_id = 0").select("embedding").first()
    q = F.array(*[F.lit(float(x)) for x in (query[0] if query else [])])
    known = facts(read(spark, sf_dir, "events")).where("is_valid and kind <> 'constraint'")
    docs = read(spark, sf_dir, "documents").join(known.select(F.col("fact_id").alias("doc_id")), "doc_id", "left_semi")
    sparse = R.bm25(docs, "doc_id", tokenize(F.col("text")), TERMS).withColumnsRenamed({"doc": "fact_id", "score": "sparse"})
    dense = vectors.select(F.col("vec_id").alias("fact_id"), S.cosine(F.col("embedding"), q, 0.5).alias("dense"))
    texts = docs.select(F.col("doc_id").alias("fact_id"))
    rows = known.join(texts, "fact_id").join(dense, "fact_id", "left").join(sparse, "fact_id", "left")
    rows = rows.withColumns({"dense": F.coalesce("dense", F.lit(0.5)), "sparse": F.coalesce("sparse", F.lit(0.0))})
    top = F.broadcast(rows.agg(F.max("sparse").alias("top")))
    rows = rows.crossJoin(top).withColumn("sim", F.round(R.fuse(F.col("dense"), F.col("sparse"), F.col("top")), 6))
    fact = {c: F.col(c) for c in ("kind", "tags", "confidence", "success_count", "provenance", "last_recall_ts", "created_at", "g_n", "effectiveness_c", "effectiveness_n")}
    return rows.withColumn("score", F.round(S.rank_score(F.col("sim"), fact, NOW), 6))


def hybrid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.half_and_half(_candidates(spark, sf_dir).select("fact_id", "sim", "score"), 11, "score", "sim", "fact_id")


FACTS_SQL = """facts as (
  select user_id as fact_id, count(*) as access_count, count(*) filter (event_type = 'purchase') as success_count,
    count(*) filter (event_type = 'error') as error_count,
    epoch(min(ts)) as created_at, epoch(max(ts)) as last_accessed, round(0.1 + (user_id % 9) * 0.1, 1)::double as confidence,
    ['constraint','pattern','review','failure','decision','architecture','known_unknown','episode'][(user_id % 8 + 1)::int] as kind,
    ['global','org','project','session'][(user_id % 4 + 1)::int] as scope,
    case user_id % 6 when 0 then ['seed'] when 1 then ['independent'] when 2 then ['probation'] when 3 then ['attempt','observed-outcome'] else []::varchar[] end as tags,
    ['structural','observed','inferred'][(user_id % 3 + 1)::int] as provenance, user_id % 7 <> 6 as is_valid,
    case when user_id % 2 = 0 then epoch(max(ts)) end as last_recall_ts, (1.0 + user_id % 3)::double as g_n,
    (count(*) filter (event_type = 'purchase') * 1.5 - count(*) filter (event_type = 'error') * 0.5)::double as effectiveness_c,
    count(*) filter (event_type in ('purchase', 'error')) as effectiveness_n,
    case when user_id % 10 = 0 then ['e' || user_id] else []::varchar[] end as supporting_episode_ids
  from events group by user_id)"""

HYBRID_RANK = f"""with {FACTS_SQL},
known as (select * from facts where is_valid and kind <> 'constraint'),
corpus as (select * from documents where doc_id in (select fact_id from known)),
q as (select embedding as qe from embeddings where vec_id = 0),
{_bm25_sql("corpus", "doc_id", _TOKENS, TERMS)},
j as (select k.*, coalesce({_COS.format(a="e.embedding", b="q.qe")}, 0.5) as dense, coalesce(s.score, 0) as sparse
  from known k join corpus c on c.doc_id = k.fact_id left join embeddings e on e.vec_id = k.fact_id left join scored s on s.doc = k.fact_id, q),
f as (select *, round(case when max(sparse) over () <= 0 then dense else 0.7 * greatest(0, least(1, (dense + 1) / 2)) + 0.3 * sparse / max(sparse) over () end, 6) as sim from j),
g as (select *, kind not in ('constraint','architecture','decision') and not list_has_any(tags, ['seed','community','synthesized']) as fluid,
  greatest(0, ({NOW} - coalesce(last_recall_ts, created_at)) / 86400.0) as days from f),
h as (select fact_id, sim, round(
   (case when not fluid then sim when sim <= 0 then 0 else greatest(0, least(1, (1 - exp(-sim * exp(-days / g_n))) / (1 - exp(-1)))) end) * confidence
   + (case when success_count <= 0 then 0 else least(0.2, 0.1 * log2(success_count + 1)) end) * (case when fluid and effectiveness_n > 0 then effectiveness_c / effectiveness_n else 1 end)
   + (case provenance when 'structural' then 0.05 when 'observed' then 0.02 else 0 end), 6) as score from g),
a as (select * from h order by score desc, fact_id limit 6),
b as (select * from h where fact_id not in (select fact_id from a) order by sim desc, fact_id limit 5)
select fact_id, sim, score, row_number() over (order by score desc, fact_id) as rank from (select * from a union all select * from b)"""


def query_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.floor(F.length("text") / 2).cast("int")
    first, rest = F.col("text").substr(F.lit(1), half), F.col("text").substr(half + 1, F.length("text"))
    asked = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("compare "), first, F.lit(" vs "), rest))
    asked = asked.when(F.col("item_id") % 3 == 1, F.concat(first, F.lit(" of the owner of the "), rest))
    rows = read(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace(asked.otherwise(F.col("text")), "\n", " ").alias("query"))
    shaped = rows.withColumn("shape", classify(F.col("query")))
    return shaped.select("item_id", "shape", F.posexplode(decompose(F.col("query"), F.col("shape"))).alias("step", "part"))


_SP = r"[ \t\n\r\f]"
QUERY_ROUTING = rf"""with q as (select item_id, regexp_replace(case item_id % 3 when 0 then 'compare ' || substring(text, 1, length(text) // 2) || ' vs ' || substring(text, length(text) // 2 + 1)
  when 1 then substring(text, 1, length(text) // 2) || ' of the owner of the ' || substring(text, length(text) // 2 + 1) else text end, '\n', ' ', 'g') as query from benchmark),
s as (select *, case when regexp_matches(query, '(?i)(^|[^\p{{L}}\p{{N}}_])(of|in|on|by|from|under) the [\p{{L}}\p{{N}}_-]+ (of|in|on|by|from|under) the($|[^\p{{L}}\p{{N}}_])')
    or regexp_matches(query, '[\p{{L}}\p{{N}}_]''s [\p{{L}}\p{{N}}_]+''s($|[^\p{{L}}\p{{N}}_])')
    or regexp_matches(query, '(?i)(^|[^\p{{L}}\p{{N}}_])(that|which|who) (owns|has|holds|contains) the [\p{{L}}\p{{N}}_]') then 'chain'
  when regexp_matches(query, '(?i)(^|[^\p{{L}}\p{{N}}_])(compare|contrast) [\p{{L}}\p{{N}}_]') or regexp_matches(query, '(?i)(^|[^\p{{L}}\p{{N}}_])(diff(erence)? between|vs|versus)($|[^\p{{L}}\p{{N}}_])')
  then 'split' else 'direct' end as shape from q),
p as (select *, case shape
  when 'chain' then list_reverse(list_filter(list_transform(string_split_regex(query, '(?i){_SP}+of the{_SP}+'), lambda x: trim(x)), lambda x: x <> ''))[1:3]
  when 'split' then list_filter(list_transform(string_split_regex(regexp_replace(trim(query), '(?i)^(compare|contrast|diff(erence)? between){_SP}+', ''), '(?i){_SP}*(,| and | or | vs | versus | between ){_SP}*'), lambda x: trim(x, ' ?.')), lambda x: x <> '')[1:6]
  else [trim(query)] end as parts from s),
f as (select item_id, shape, case when len(parts) <= 1 then [trim(query)] else parts end as parts from p)
select item_id, shape, unnest(range(len(parts)))::int as step, unnest(parts) as part from f"""


def multi_branch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three branches (scopes) retrieve 5 each; merged by id with the best confidence, ordered by the score at similarity 1."""
    rows = _candidates(spark, sf_dir)
    w = Window.partitionBy("scope").orderBy(F.col("score").desc(), "fact_id")
    picked = rows.withColumn("rn", F.row_number().over(w)).where("rn <= 5")
    fact = {c: F.col(c) for c in ("kind", "tags", "confidence", "success_count", "provenance", "last_recall_ts", "created_at", "g_n", "effectiveness_c", "effectiveness_n")}
    merged = picked.withColumn("best", F.row_number().over(Window.partitionBy("fact_id").orderBy(F.col("confidence").desc(), "scope"))).where("best = 1")
    return R.top_k(merged.select("fact_id", "scope", F.round(S.rank_score(F.lit(1.0), fact, NOW), 6).alias("score")), "score", 10, "fact_id")


MULTI_BRANCH = (
    HYBRID_RANK[: HYBRID_RANK.index("h as (")]
    + """h as (select fact_id, scope, sim, round(
   (case when not fluid then sim when sim <= 0 then 0 else greatest(0, least(1, (1 - exp(-sim * exp(-days / g_n))) / (1 - exp(-1)))) end) * confidence
   + (case when success_count <= 0 then 0 else least(0.2, 0.1 * log2(success_count + 1)) end) * (case when fluid and effectiveness_n > 0 then effectiveness_c / effectiveness_n else 1 end)
   + (case provenance when 'structural' then 0.05 when 'observed' then 0.02 else 0 end), 6) as score,
   round((case when fluid then least(1, (1 - exp(-exp(-days / g_n))) / (1 - exp(-1))) else 1 end) * confidence
   + (case when success_count <= 0 then 0 else least(0.2, 0.1 * log2(success_count + 1)) end) * (case when fluid and effectiveness_n > 0 then effectiveness_c / effectiveness_n else 1 end)
   + (case provenance when 'structural' then 0.05 when 'observed' then 0.02 else 0 end), 6) as final from g),
p as (select *, row_number() over (partition by scope order by score desc, fact_id) as rn from h)
select fact_id, scope, final as score, rank from (select *, row_number() over (order by final desc, fact_id) as rank from p where rn <= 5) where rank <= 10"""
)

QUERIES = {
    "bm25_search": (bm25_search, BM25_SEARCH),
    "bm25_code_tokens": (bm25_code_tokens, BM25_CODE),
    "vector_topk": (vector_topk, VECTOR_TOPK),
    "hybrid_rank": (hybrid_rank, HYBRID_RANK),
    "query_routing": (query_routing, QUERY_ROUTING),
    "multi_branch_merge": (multi_branch_merge, MULTI_BRANCH),
}
