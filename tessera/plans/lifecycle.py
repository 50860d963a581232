"""Lifecycle queries over facts derived from ``events``, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators import lifecycle as L
from tessera.plans.search import _COS, FACTS_SQL, NOW
from tessera.sources.tables import facts, read

_PROTECTED = "(list_has_any(tags, ['seed','community','synthesized']) or len(supporting_episode_ids) > 0)"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(read(spark, sf_dir, "events"))


def lifecycle_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).select("fact_id", L.prunable(NOW).alias("pruned"))


PRUNE = f"""with {FACTS_SQL}
select fact_id, is_valid and kind <> 'constraint' and success_count <= 0 and not {_PROTECTED}
  and (list_contains(tags, 'independent') or list_contains(tags, 'probation') or confidence < 0.4)
  and {NOW} - created_at >= (case when list_contains(tags, 'probation') then 3 when list_contains(tags, 'independent') then 7 else 14 end) * 86400.0 as pruned
from facts"""


def lifecycle_demote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.demoted(_facts(spark, sf_dir), NOW).select("fact_id", "action", F.round("new_confidence", 6).alias("new_confidence"))


DEMOTE = f"""with {FACTS_SQL},
e as (select *, is_valid and kind <> 'constraint' and not {_PROTECTED} and {NOW} - created_at >= 7 * 86400.0 and access_count >= 5 as ok,
  least(1.0, least(0.9, 0.6 + 0.1 * success_count), confidence + 0.05) as raised from facts),
a as (select *, case when ok and success_count = 0 and access_count >= 10 then 'invalidate' when ok and success_count = 0 then 'demote'
  when ok and success_count > 0 and success_count / access_count >= 0.3 and raised > confidence then 'boost' else 'keep' end as action from e)
select fact_id, action, round(case action when 'demote' then greatest(0.1, confidence - 0.1) when 'boost' then raised else confidence end, 6) as new_confidence from a"""

_LIMITS = {"global": 6, "org": 4, "project": 8, "session": 2}


def scope_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.evicted(_facts(spark, sf_dir), _LIMITS)


SCOPE_CAP = f"""with {FACTS_SQL},
r as (select fact_id, scope, round(case when access_count > 0 and success_count > 0 then confidence * 0.5 + success_count / access_count * 0.5 else confidence end, 6) as eviction_score
  from facts where is_valid and kind <> 'constraint' and not {_PROTECTED}),
n as (select *, row_number() over (partition by scope order by eviction_score, fact_id) as place, count(*) over (partition by scope) as total from r)
select fact_id, scope, eviction_score from n where place <= total - case scope when 'global' then 6 when 'org' then 4 when 'project' then 8 else 2 end"""


def cap_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(spark, sf_dir).where("is_valid").where(~L.protected())
    independent = f.where("array_contains(tags, 'independent')").withColumn("class", F.lit("independent"))
    attempts = f.where("array_contains(tags, 'attempt') and array_contains(tags, 'observed-outcome')").withColumn("class", F.lit("attempt"))
    over = L.newest_beyond(independent, 5, ["class"]).unionByName(L.newest_beyond(attempts, 3, ["class"]))
    return over.select("fact_id", "class", "age_rank")


CAP_NEWEST = f"""with {FACTS_SQL},
r as (select fact_id, case when list_contains(tags, 'independent') then 'independent' else 'attempt' end as class, created_at from facts
  where is_valid and not {_PROTECTED} and (list_contains(tags, 'independent') or (list_contains(tags, 'attempt') and list_contains(tags, 'observed-outcome')))),
n as (select *, row_number() over (partition by class order by created_at desc, fact_id) as age_rank from r)
select fact_id, class, age_rank from n where age_rank > case class when 'independent' then 5 else 3 end"""


def purge_dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which facts a purge drops, and which tombstones lose their payload."""
    reason = F.when(F.col("fact_id") % 5 == 0, "repeated_attributed_contradiction")
    f = _facts(spark, sf_dir).withColumn("is_valid", F.col("fact_id") % 3 != 0).withColumn("invalidation_reason", reason)
    later = NOW + 25 * 86400
    return f.select("fact_id", L.purgeable(later).alias("purged"), F.when(F.col("is_valid"), F.col("kind")).alias("payload"))


PURGE = f"""with {FACTS_SQL}
select fact_id, fact_id % 3 = 0 and {NOW + 25 * 86400} - last_accessed >= 30 * 86400.0 and fact_id % 5 <> 0 as purged, case when fact_id % 3 <> 0 then kind end as payload from facts"""


def memory_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.memory_level(_facts(spark, sf_dir))
    return out.select(F.round("quality", 6).alias("quality"), "reference", F.round("level", 6).alias("level"))


MEMORY_LEVEL = f"""with {FACTS_SQL},
q as (select sum((case when access_count > 0 and success_count > 0 then confidence * 0.5 + success_count / access_count * 0.5 else confidence end)
  * (0.9 + 0.1 * least(1.0, access_count / 10))) filter (is_valid) as quality from facts),
c as (select greatest(50.0, sum(cap) * 0.2) as reference from (select distinct scope, case scope when 'global' then 200 when 'org' then 100 when 'project' then 500 else 50 end as cap from facts))
select round(quality, 6) as quality, reference::double as reference, round(1 - 1 / (1 + quality / reference), 6) as level from q, c"""


def effectiveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.scores import effectiveness as ratio, strengthened, success_bonus

    f = _facts(spark, sf_dir)
    return f.select(
        "fact_id", "effectiveness_c", "effectiveness_n", F.round(ratio(F.col("effectiveness_c"), F.col("effectiveness_n")), 6).alias("f"),
        F.round(success_bonus(F.col("success_count")), 6).alias("bonus"),
        F.round(strengthened(F.col("g_n"), (F.lit(NOW) - F.col("last_accessed")) / 86400.0), 6).alias("g_next"),
    )


EFFECTIVENESS = f"""with {FACTS_SQL}
select fact_id, effectiveness_c::double as effectiveness_c, effectiveness_n, round(case when effectiveness_n <= 0 then 1.0 else effectiveness_c / effectiveness_n end, 6) as f,
  round(case when success_count <= 0 then 0 else least(0.2, 0.1 * log2(success_count + 1)) end, 6) as bonus,
  round(g_n + (1 - exp(-greatest(0, ({NOW} - last_accessed) / 86400.0))) / (1 + exp(-greatest(0, ({NOW} - last_accessed) / 86400.0))), 6) as g_next from facts"""


def value_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.value_scores(_facts(spark, sf_dir), read(spark, sf_dir, "embeddings"))


VALUE_SCORE = f"""with {FACTS_SQL},
v as (select f.*, e.embedding, e.label from facts f join embeddings e on e.vec_id = f.fact_id where f.is_valid),
near as (select a.fact_id, max({_COS.format(a="a.embedding", b="b.embedding")}) as nearest from v a join v b on a.label = b.label and a.fact_id <> b.fact_id group by a.fact_id),
act as (select embedding from v order by last_accessed desc, fact_id limit 20),
cent as (select list(x order by i) as centroid from (select i, avg(x) as x from (select unnest(range(len(embedding))) as i, unnest(embedding)::double as x from act) group by i)),
scores as (select v.fact_id, round(0.30 * greatest(0, 1 - coalesce(nearest, 0.5)) + 0.20 * least(1, success_count / (access_count + 1))
  + 0.35 * greatest(0, least(1, {_COS.format(a="v.embedding", b="centroid")})) + 0.15 * least(1, access_count / ((select max(access_count) from facts) + 1)), 6) as value
  from v left join near using (fact_id), cent)
select fact_id, value from scores"""


def forgetting_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.forgetting_threshold(value_score(spark, sf_dir)).select(F.round("threshold", 6).alias("threshold"), "n")


FORGETTING = VALUE_SCORE.replace(
    "select fact_id, value from scores",
    "select round(greatest(0.05, least(1, avg(value) - stddev_pop(value) * (count(*) / 2000))), 6) as threshold, count(*) as n from scores",
)

QUERIES = {
    "lifecycle_prune": (lifecycle_prune, PRUNE),
    "lifecycle_demote": (lifecycle_demote, DEMOTE),
    "scope_cap": (scope_cap, SCOPE_CAP),
    "cap_newest": (cap_newest, CAP_NEWEST),
    "purge_dead": (purge_dead, PURGE),
    "memory_level": (memory_level, MEMORY_LEVEL),
    "effectiveness": (effectiveness, EFFECTIVENESS),
    "value_score": (value_score, VALUE_SCORE),
    "forgetting_threshold": (forgetting_threshold, FORGETTING),
}
