"""Queries of the write side: adding facts, feedback, contradictions, counters, peers, similarity bands, audits, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.operators import memory as M
from tessera.operators.vectors import band_pairs, best_other
from tessera.plans.search import FACTS_SQL, REVISIONS, _COS, revisions
from tessera.sources.tables import facts, read


def _pick(values: list, n):
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with vectors and texts: one for each embedding."""
    v = read(spark, sf_dir, "embeddings")
    n = F.col("vec_id")
    return v.select(
        n.cast("long").alias("fact_id"), F.concat(F.lit("get file /srv/app/"), (n % 700).cast("string"), F.lit(" "), F.coalesce(F.col("label").cast("string"), F.lit("none"))).alias("subject"),
        _pick(["pattern", "failure", "episode"], n).alias("kind"), F.coalesce(F.col("label").cast("string"), F.lit("none")).alias("scope"), (0.3 + n % 7 / 10).alias("confidence"),
        _pick(["structural", "observed", "inferred"], F.floor(n / 3)).alias("provenance"), (n * 7 % 1000).cast("double").alias("event_time"),
        F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), (n % 11 > 0).alias("is_valid"), n.alias("seq"),
    )


def add_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the facts stored, the other half added in order: twins, supersession and carried confidence."""
    rows = _rows(spark, sf_dir)
    half = F.col("fact_id") % 2 == 0
    return M.added(rows.where(half).drop("seq"), rows.where(~half).drop("is_valid")).withColumn("confidence", F.round("confidence", 6))


def feedback_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of facts by the outcomes of a batch, whose paths are spelled in several ways."""
    changes, _ = _feedback(spark, sf_dir)
    return changes.withColumns({"confidence": F.round("confidence", 6), "effectiveness_c": F.round("effectiveness_c", 6)})


def feedback_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review rows of the outcomes that no fact takes."""
    _, reviews = _feedback(spark, sf_dir)
    return reviews.withColumn("confidence", F.round("confidence", 6))


def _feedback(spark: SparkSession, sf_dir: str):
    f = facts(read(spark, sf_dir, "events"))
    links = f.where("fact_id % 3 > 0").select(F.concat(F.when(F.col("fact_id") % 2 == 0, "./").otherwise(""), F.lit("src/f"), F.col("fact_id").cast("string"), F.lit(".py")).alias("path"), "fact_id")
    k = F.col("o_orderkey")
    user = F.col("o_custkey")
    spelled = F.concat(_pick(["", "./", "/"], k), F.lit("src/f"), user.cast("string"), F.lit(".py"))
    o = read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(
        k.alias("ordinal"), spelled.alias("path"), _pick(["accepted", "modified", "unverified", "regression", "independent"], F.floor(k / 3)).alias("type"),
        F.array(user + 1, user + 3).alias("used"), F.when(k % 4 == 0, F.concat(F.lit("c"), k.cast("string"))).alias("candidate_id"), (k % 9 / 10).alias("suggested"),
    )
    return M.feedback(f, o, links, F.lit("regression"))


_OUTCOMES = """outcomes as (select o_orderkey as ordinal, ['', './', '/'][(o_orderkey % 3 + 1)::int] || 'src/f' || o_custkey || '.py' as path, ['accepted','modified','unverified','regression','independent'][(o_orderkey // 3 % 5 + 1)::int] as type,
  o_custkey as u, case when o_orderkey % 4 = 0 then 'c' || o_orderkey end as candidate_id, o_orderkey % 9 / 10 as suggested from orders where o_orderstatus <> 'P'),
links as (select fact_id, case when fact_id % 2 = 0 then './' else '' end || 'src/f' || fact_id || '.py' as path from facts where fact_id % 3 > 0),
spell as (select path, fact_id from links union select regexp_replace(path, '^(\\./)+', ''), fact_id from links),
hit as (select o.*, coalesce(a.fact_id, b.fact_id, c.fact_id) as linked from outcomes o left join spell a on a.path = o.path left join spell b on b.path = regexp_replace(o.path, '^(\\./)+', '')
  left join spell c on c.path = case when starts_with(o.path, '/') then ltrim(o.path, '/') else '/' || o.path end),
live as (select h.*, f.fact_id is not null as alive from hit h left join facts f on f.fact_id = h.linked and f.is_valid),
moves as (select ordinal, 1 as phase, 0 as place, linked as fact_id, type from live where alive and type in ('accepted','modified','regression')
  union all select ordinal, 0, p, u + 1 + 2 * p, type from live, (values (0), (1)) as x(p) where type in ('accepted','modified','regression') and (u + 1 + 2 * p) not in (select fact_id from links)),
touch as (select * from (select *, row_number() over (partition by fact_id order by ordinal, phase, place) as rn from moves) where rn = 1)"""
FEEDBACK = f"""with {FACTS_SQL}, {_OUTCOMES}
select f.fact_id, ordinal, case when phase = 1 then case when type = 'accepted' then 'reinforce' else 'demote' end else case when type = 'accepted' then 'credit_used' else 'demote_used' end end as operation,
  round(case when phase = 1 and type = 'accepted' then least(1.0, confidence + 0.1) when phase = 1 then greatest(0.1, confidence - 0.3) when type = 'accepted' then confidence else greatest(0.1, confidence - 0.05) end, 6)::double as confidence,
  success_count + (type = 'accepted')::int as success_count, round(effectiveness_c + case when type = 'accepted' then 1.5 else -0.5 end, 6)::double as effectiveness_c, effectiveness_n + 1 as effectiveness_n
from facts f join touch t using (fact_id) where is_valid"""
REVIEWS = f"""with {FACTS_SQL}, {_OUTCOMES}
select l.ordinal, 'outcome:' || l.type || ' ' || path as subject, round(case l.type when 'accepted' then least(1.0, greatest(0.0, suggested + 0.1 - 0.1)) when 'independent' then 0.2 else 0.4 end, 6)::double as confidence
from live l left join touch t on t.fact_id = l.linked and t.phase = 1
where ((l.type = 'accepted' and not alive and coalesce(candidate_id, '') = '') or l.type in ('modified', 'regression', 'independent')) and (not alive or l.type = 'independent' or t.ordinal = l.ordinal)"""


def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(read(spark, sf_dir, "events")).withColumn("contradicting_episode_ids", F.when(F.col("fact_id") % 5 == 0, F.array(F.lit("e1"))).otherwise(F.array().cast("array<string>")))
    reports = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("fact_id"), F.concat(F.lit("e"), (F.col("o_orderkey") % 3).cast("string")).alias("episode_id"))
    return M.contradicted(f, reports).withColumns({"confidence": F.round("confidence", 6), "effectiveness_c": F.round("effectiveness_c", 6)})


CONTRADICTIONS = f"""with {FACTS_SQL}, n as (select o_custkey as fact_id, count(distinct o_orderkey % 3) filter (not (o_custkey % 5 = 0 and o_orderkey % 3 = 1)) as n from orders where o_orderstatus = 'F' group by 1),
h as (select f.*, n, n + (fact_id % 5 = 0)::int as total from facts f join n using (fact_id) where n > 0)
select fact_id, total::bigint as episodes, round(greatest(0.1, confidence - 0.2 * n), 6)::double as confidence, round(effectiveness_c - 0.5 * n, 6)::double as effectiveness_c, effectiveness_n + n as effectiveness_n, is_valid and total < 2 as is_valid from h"""


def retractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose support is taken back with the facts of every eleventh customer."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    sign = F.concat(F.lit("s"), (F.col("o_custkey") % 40).cast("string"))
    candidates = o.select(k.alias("candidate_id"), F.concat(F.lit("e"), F.col("o_custkey").cast("string")).alias("episode_id"), sign.alias("signature"), F.when(k % 4 == 0, F.col("o_custkey") % 60).alias("promoted_fact_id"), _pick(["supported_once", "durable", "open"], k).alias("status"))
    gone = read(spark, sf_dir, "customer").where("c_custkey % 11 = 0").select((F.col("c_custkey") % 60).alias("fact_id"), F.concat(F.lit("s"), (F.col("c_custkey") % 40).cast("string")).alias("signature"), F.array(F.concat(F.lit("e"), F.col("c_custkey").cast("string"))).alias("supporting_episode_ids"))
    return M.retracted(candidates, gone).groupBy("status", "signature").agg(F.count("*").alias("n"), F.min("candidate_id").alias("first"))


RETRACTIONS = """with c as (select o_orderkey as candidate_id, o_custkey, 's' || (o_custkey % 40) as signature, case when o_orderkey % 4 = 0 then o_custkey % 60 end as promoted, ['supported_once','durable','open'][(o_orderkey % 3 + 1)::int] as status from orders),
r as (select signature, candidate_id, case when status <> 'open' and o_custkey % 11 = 0 and o_custkey in (select c_custkey from customer) and (promoted is null or promoted = o_custkey % 60) then 'contradicted' else status end as status from c)
select status, signature, count(*) as n, min(candidate_id) as first from r group by all"""


def resolve_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of facts: whole, cut to eight or four characters, or unknown."""
    c = read(spark, sf_dir, "customer").select("c_custkey", F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 16).alias("fact_id"))
    asked = F.when(F.col("c_custkey") % 4 == 0, F.col("fact_id")).when(F.col("c_custkey") % 4 == 1, F.substring("fact_id", 1, 8)).when(F.col("c_custkey") % 4 == 2, F.substring("fact_id", 1, 4)).otherwise(F.concat(F.lit("zz"), F.substring("fact_id", 1, 9)))
    return M.resolved(c.select(asked.alias("identifier")), c.select("fact_id"))


RESOLVE = """with c as (select c_custkey, substring(md5(c_custkey::varchar), 1, 16) as fact_id from customer),
a as (select distinct case c_custkey % 4 when 0 then fact_id when 1 then substring(fact_id, 1, 8) when 2 then substring(fact_id, 1, 4) else 'zz' || substring(fact_id, 1, 9) end as identifier from c),
m as (select identifier, (list(c.fact_id order by c.fact_id))[1:5] as ids, count(*) as n, bool_or(c.fact_id = identifier) as exact from a join c on starts_with(c.fact_id, identifier) group by 1)
select identifier, case when n is null then 'missing' when exact then 'exact' when n = 1 then 'prefix' else 'ambiguous' end as status, case when exact then identifier when n = 1 then ids[1] end as fact_id,
  case when n > 1 and not exact then array_to_string(ids, ', ') else '' end as matches from a left join m using (identifier)"""


def outcome_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals and confidence of entries after their outcomes, in order."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entry_id"), F.col("o_orderkey").alias("at"), (F.col("o_orderkey") % 3 > 0).alias("success"))
    entries = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entry_id"), (F.col("c_custkey") % 10 / 10).alias("confidence"))
    return M.recorded(entries, o).withColumn("confidence", F.round("confidence", 6))


COUNTERS = """with o as (select o_custkey as entry_id, list(case when o_orderkey % 3 > 0 then 0.1::double else -0.1::double end order by o_orderkey) as steps, count(*) filter (o_orderkey % 3 > 0) as w, count(*) filter (o_orderkey % 3 = 0) as l from orders group by 1)
select entry_id, w as success_signals, l as failure_signals, round(list_reduce(list_prepend((entry_id % 10 / 10)::double, steps), lambda c, s: least(1.0, greatest(0.0, c + s))), 6)::double as confidence from o join customer on c_custkey = entry_id"""


def context_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome counts of entries by context, the four largest buckets of each."""
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("entry_id"), _pick(["fix", "add", ""], k).alias("task"), F.when(k % 5 > 1, "with_error").otherwise("no_error").alias("error"), F.when(k % 7 > 0, "py").alias("ext"), (k % 2 == 0).alias("success"))
    return M.buckets(o, 4)


BUCKETS = """with o as (select o_custkey % 20 as entry_id, ['fix','add',''][(o_orderkey % 3 + 1)::int] as t, case when o_orderkey % 5 > 1 then 'with_error' else 'no_error' end as e, case when o_orderkey % 7 > 0 then 'py' end as x, o_orderkey % 2 = 0 as s from orders),
b as (select entry_id, s, unnest(list_filter([case when t <> '' and x is not null then t || '/' || e || '/' || x end, case when t <> '' then t || '/' || e end, case when x is not null then '*/' || e || '/' || x end, '*/' || e, case when t <> '' then t end], lambda n: n is not null)) as bucket from o),
c as (select entry_id, bucket, count(*) filter (s) as successes, count(*) as total from b group by all)
select entry_id, bucket, successes, total from (select *, row_number() over (partition by entry_id order by total desc, bucket) as place from c) where place <= 4"""


def contrast_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries against their peers on the same problems: parts as entries, suppliers' nations as problems."""
    li = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("entry_id"), (F.col("l_suppkey") % 50).alias("problem")).agg((F.sum("l_linenumber") % 2 == 0).alias("success"))
    return M.contrast(li.withColumn("cluster", F.col("entry_id") % 25)).withColumn("boost", F.round("boost", 6))


CONTRAST = """with r as (select l_partkey as entry_id, l_partkey % 25 as cluster, l_suppkey % 50 as problem, sum(l_linenumber) % 2 = 0 as ok from lineitem group by all),
p as (select cluster, problem, count(*) filter (ok) as good, count(*) filter (not ok) as bad from r group by all),
s as (select cluster, entry_id, sum(case when ok then bad else 0 end)::bigint as wins, sum(case when ok then 0 else good end)::bigint as losses from r join p using (cluster, problem) group by all)
select cluster, entry_id, wins, losses, case when wins + losses = 0 then 0.0 else round((wins / (wins + losses) - 0.5) * 0.4, 6) end::double as boost from s"""


def episode_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 200 facts by confidence, each episode followed by two of its prompt."""
    f = facts(read(spark, sf_dir, "events")).where("is_valid").withColumn("kind", F.when(F.col("fact_id") % 2 == 0, "episode").otherwise("pattern"))
    f = f.select("fact_id", "kind", "confidence", F.concat(F.lit("p"), (F.col("fact_id") % 40).cast("string")).alias("prompt"), F.col("created_at").alias("event_time"))
    hits = f.orderBy(F.col("confidence").desc(), "fact_id").limit(200)
    hits = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.col("confidence").desc(), "fact_id")).cast("long"))
    return M.with_peers(hits, f.where("kind = 'episode'"))


PEERS = f"""with {FACTS_SQL}, g as (select fact_id, case when fact_id % 2 = 0 then 'episode' else 'pattern' end as kind, confidence, 'p' || (fact_id % 40) as prompt, created_at from facts where is_valid),
h as (select *, row_number() over (order by confidence desc, fact_id) as rank from (select * from g order by confidence desc, fact_id limit 200)),
t as (select *, row_number() over (partition by prompt order by rank) - 1 as turn from h where kind = 'episode'),
e as (select *, row_number() over (partition by prompt order by created_at, fact_id) - 1 as pos from g where kind = 'episode' and fact_id not in (select fact_id from h) and prompt in (select prompt from t))
select rank, 0 as place, fact_id from h union all select t.rank, pos % 2 + 1 as place, e.fact_id from e join t on t.prompt = e.prompt and t.turn = pos // 2"""


def conflict_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 pairs of vectors of a label (three revisions of each) with a cosine from 0.80 to below 0.93."""
    return band_pairs(revisions(spark, sf_dir), 0.80, 0.93, 40)


BAND = f"""with {REVISIONS}, p as (select a.vec_id as a, b.vec_id as b, {_COS.format(a="a.embedding", b="b.embedding")} as c from revisions a join revisions b on a.label = b.label and a.vec_id < b.vec_id)
select a, b, round(c, 6) as similarity from p where c >= 0.80 and c < 0.93 order by a, b limit 40"""


def rule_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule units against the other files: those without a match of 0.78 there, and those aligned but not the same (below 0.97)."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), (F.col("vec_id") % 4).cast("int").alias("tool"), F.col("embedding").alias("vector"))
    best = best_other(v, "tool")
    state = F.when(F.col("similarity") < 0.78, "missing").when(F.col("similarity") < 0.97, "divergent").otherwise("same")
    return best.select("id", "tool", "other", state.alias("state"))


GAPS = f"""with v as (select vec_id as id, (vec_id % 4)::int as tool, embedding as e from embeddings),
p as (select a.id, a.tool, b.tool as other, max({_COS.format(a="a.e", b="b.e")}) as c from v a join v b on a.tool <> b.tool group by all)
select id, tool, other, case when c < 0.78 then 'missing' when c < 0.97 then 'divergent' else 'same' end as state from p"""


def hygiene_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on a set of memory files: malformed ones, ones that the index does not list, listed ones that are missing, duplicates at 0.93."""
    from tessera.operators.graph import connected_components
    from tessera.operators.vectors import linking_edges

    v = read(spark, sf_dir, "embeddings")
    name = lambda c: F.concat(F.lit("m"), F.col(c).cast("string"), F.lit(".md"))
    files = v.select(name("vec_id").alias("name"), (F.col("vec_id") % 13 == 0).alias("bad"))
    listed = read(spark, sf_dir, "documents").where("doc_id % 3 > 0").select(name("doc_id").alias("name"))
    bad = files.where("bad").select(F.lit("malformed").alias("finding"), "name")
    unlisted = files.join(listed, "name", "left_anti").select(F.lit("unlisted").alias("finding"), "name")
    missing = listed.join(files.select("name"), "name", "left_anti").select(F.lit("missing").alias("finding"), "name")
    edges = linking_edges(v.select(F.col("vec_id").cast("long").alias("id"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("grp"), F.col("embedding").alias("vector")), 0.93)
    copies = connected_components(edges, "a", "b").where("node <> component").select(F.lit("duplicate").alias("finding"), name("node").alias("name"))
    return bad.unionByName(unlisted).unionByName(missing).unionByName(copies)


AUDIT = f"""with recursive e as (select a.vec_id as a, b.vec_id as b from embeddings a join embeddings b on coalesce(a.label::varchar, '') = coalesce(b.label::varchar, '') and a.vec_id <> b.vec_id and {_COS.format(a="a.embedding", b="b.embedding")} >= 0.93),
r as (select a as node, a as seen from e union select r.node, e.b from r join e on e.a = r.seen),
f as (select 'm' || vec_id || '.md' as name, vec_id % 13 = 0 as bad from embeddings), l as (select 'm' || doc_id || '.md' as name from documents where doc_id % 3 > 0)
select 'malformed' as finding, name from f where bad union all select 'unlisted', name from f where name not in (select name from l) union all select 'missing', name from l where name not in (select name from f)
union all select 'duplicate', 'm' || node || '.md' from (select node, min(seen) as c from r group by 1) where c <> node"""

QUERIES = {
    "add_facts": (add_facts, None),
    "feedback_changes": (feedback_changes, FEEDBACK),
    "feedback_reviews": (feedback_reviews, REVIEWS),
    "contradictions": (contradictions, CONTRADICTIONS),
    "retractions": (retractions, RETRACTIONS),
    "resolve_ids": (resolve_ids, RESOLVE),
    "outcome_counters": (outcome_counters, COUNTERS),
    "context_buckets": (context_buckets, BUCKETS),
    "contrast_boosts": (contrast_boosts, CONTRAST),
    "episode_peers": (episode_peers, PEERS),
    "conflict_band": (conflict_band, BAND),
    "rule_gaps": (rule_gaps, GAPS),
    "hygiene_audit": (hygiene_audit, AUDIT),
}
