"""Log, promotion, correlation and incremental queries over ``events``, ``orders`` and ``lineitem``, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators.graph import connected_components
from tessera.plans.search import _COS
from tessera.sources.tables import read


def log_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, failures, rate and latency overall, by phase and by error code, in one pass (grouping sets)."""
    rows = read(spark, sf_dir, "events").select(
        F.col("event_type").alias("phase"), (F.get_json_object("props", "$.k").cast("int") % 5).alias("error_code"), "value",
        (F.col("event_type") == "error").cast("int").alias("failed"),
    )
    grouped = rows.groupingSets([[], ["phase"], ["error_code"]], "phase", "error_code")
    out = grouped.agg(F.count("*").alias("calls"), F.sum("failed").alias("failures"), F.avg("value").alias("latency"), F.grouping_id().alias("gid"))
    level = F.when(F.col("gid") == 3, "all").when(F.col("gid") == 1, "phase").otherwise("error_code")
    return out.select(
        level.alias("level"), "phase", "error_code", "calls", "failures", F.round(F.col("failures") / F.col("calls"), 6).alias("failure_rate"), F.round("latency", 4).alias("latency")
    )


LOG_METRICS = """with r as (select event_type as phase, (props->>'$.k')::int % 5 as error_code, value, (event_type = 'error')::int as failed from events)
select case grouping(phase, error_code) when 3 then 'all' when 1 then 'phase' else 'error_code' end as level, phase, error_code, count(*) as calls, sum(failed) as failures,
  round(sum(failed) / count(*), 6) as failure_rate, round(avg(value), 4) as latency from r group by grouping sets ((), (phase), (error_code))"""


def citation_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters overall and by model since a time, with the share that survives."""
    since = F.lit("2024-01-05").cast("timestamp")
    rows = read(spark, sf_dir, "events").where(F.col("ts").cast("timestamp") >= since).select(
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"),
        F.get_json_object("props", "$.k").cast("int").alias("retrieved"),
        F.when(F.col("event_type") == "purchase", F.get_json_object("props", "$.k").cast("int")).otherwise(0).alias("used"),
    )
    out = rows.rollup("model").agg(F.sum("retrieved").alias("retrieved"), F.sum("used").alias("used"), F.count("*").alias("n"))
    return out.withColumn("percent", F.round(F.col("used") * 100.0 / F.nullif("retrieved", F.lit(0)), 4))


CITATION = """with r as (select 'm' || (user_id % 3) as model, (props->>'$.k')::int as retrieved, case when event_type = 'purchase' then (props->>'$.k')::int else 0 end as used
  from events where ts >= timestamp '2024-01-05')
select model, sum(retrieved) as retrieved, sum(used) as used, count(*) as n, round(sum(used) * 100.0 / nullif(sum(retrieved), 0), 4) as percent from r group by rollup (model)"""


def learning_pulse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by outcome, by candidate status and by mutation operation."""
    status = F.concat(F.lit("s"), (F.get_json_object("props", "$.k").cast("int") % 4).cast("string"))
    parts = F.array(
        F.struct(F.lit("outcome").alias("family"), F.col("event_type").alias("name")),
        F.struct(F.lit("candidate").alias("family"), status.alias("name")),
        F.struct(F.lit("mutation").alias("family"), F.when(F.col("value") > 10, "write").otherwise("skip").alias("name")),
    )
    return read(spark, sf_dir, "events").select(F.explode(parts).alias("p")).groupBy("p.family", "p.name").agg(F.count("*").alias("n"))


PULSE = """select 'outcome' as family, event_type as name, count(*) as n from events group by 2 union all
select 'candidate', 's' || ((props->>'$.k')::int % 4), count(*) from events group by 2 union all
select 'mutation', case when value > 10 then 'write' else 'skip' end, count(*) from events group by 2"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, signature, episode, revision, confidence): candidates seen in episodes."""
    return read(spark, sf_dir, "events").select(
        (F.col("user_id") % 7).alias("project"), F.concat("event_type", F.lit("-"), (F.get_json_object("props", "$.k").cast("int") % 20).cast("string")).alias("signature"),
        F.col("event_id").alias("episode"), F.when(F.col("event_id") % 11 != 0, F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd")).otherwise("").alias("revision"),
        F.round(F.col("value") / 100, 4).alias("confidence"),
    )


_CAND = """c as (select user_id % 7 as project, event_type || '-' || ((props->>'$.k')::int % 20) as signature, event_id as episode,
  case when event_id % 11 <> 0 then strftime(ts, '%Y-%m-%d') else '' end as revision, round(value / 100, 4) as confidence from events)"""


def promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of a project with two episodes and two revisions or more."""
    g = _candidates(spark, sf_dir).groupBy("project", "signature").agg(
        F.countDistinct("episode").alias("episodes"), F.countDistinct(F.when(F.col("revision") != "", F.col("revision"))).alias("revisions")
    )
    return g.where("episodes >= 2 and revisions >= 2")


PROMOTION = f"""with {_CAND} select project, signature, count(distinct episode) as episodes, count(distinct revision) filter (revision <> '') as revisions
from c group by 1, 2 having count(distinct episode) >= 2 and count(distinct revision) filter (revision <> '') >= 2"""


def cross_project_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _candidates(spark, sf_dir).groupBy("signature").agg(F.countDistinct("project").alias("projects"), F.countDistinct("episode").alias("episodes"))
    return g.where("projects >= 2 and episodes >= 4").withColumn("confidence", F.round(F.least(F.lit(0.8), 0.5 + 0.05 * F.col("projects")), 6))


CROSS = f"""with {_CAND} select signature, count(distinct project) as projects, count(distinct episode) as episodes, round(least(0.8, 0.5 + 0.05 * count(distinct project)), 6)::double as confidence
from c group by 1 having count(distinct project) >= 2 and count(distinct episode) >= 4"""


def signature_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One survivor for each signature over projects: most episodes, then confidence, then project; others are folded in."""
    per = _candidates(spark, sf_dir).groupBy("signature", "project").agg(F.countDistinct("episode").alias("episodes"), F.max("confidence").alias("confidence"))
    best = F.max(F.struct("episodes", "confidence", "project")).alias("best")
    out = per.groupBy("signature").agg(best, F.sum("episodes").alias("folded"), (F.count("*") - 1).alias("superseded"))
    return out.select("signature", F.col("best.project").alias("project"), F.col("best.episodes").alias("episodes"), "folded", "superseded")


SIG_DEDUP = f"""with {_CAND}, p as (select signature, project, count(distinct episode) as episodes, max(confidence) as confidence from c group by 1, 2),
r as (select *, row_number() over (partition by signature order by episodes desc, confidence desc, project desc) as rn, sum(episodes) over (partition by signature) as folded,
  count(*) over (partition by signature) - 1 as superseded from p) select signature, project, episodes, folded, superseded from r where rn = 1"""


def interval_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each signup, the best later event of its user within two hours: closest value, later event on ties.

    The range join is an equi-join on (user, two-hour bucket); an event is looked up in its own bucket and the next.
    """
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    width = 7_200_000_000
    left = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("suggestion"), F.col("t").alias("t0"), F.col("value").alias("v0"))
    left = left.withColumn("bucket", F.explode(F.array(F.floor(F.col("t0") / width), F.floor(F.col("t0") / width) + 1)))
    right = e.where("event_type <> 'signup'").withColumn("bucket", F.floor(F.col("t") / width))
    hits = left.join(right, ["user_id", "bucket"]).where((F.col("t") >= F.col("t0")) & (F.col("t") <= F.col("t0") + width))
    closeness = F.round(1 / (1 + F.abs(F.col("value") - F.col("v0"))), 6)
    best = hits.withColumn("similarity", closeness).groupBy("suggestion").agg(F.max(F.struct("similarity", "t", "event_id")).alias("b"))
    return best.select("suggestion", F.col("b.event_id").alias("episode"), F.col("b.similarity").alias("similarity"))


INTERVAL = """with h as (select s.event_id as suggestion, e.event_id as episode, e.ts, round(1 / (1 + abs(e.value - s.value)), 6) as similarity
  from events s join events e on e.user_id = s.user_id and e.ts >= s.ts and e.ts <= s.ts + interval 2 hour and e.event_type <> 'signup' where s.event_type = 'signup'),
r as (select *, row_number() over (partition by suggestion order by similarity desc, ts desc, episode desc) as rn from h)
select suggestion, episode, similarity from r where rn = 1"""


def bucket_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success rate by the most specific context with ten signals or more, else the global one."""
    e = read(spark, sf_dir, "events").select(
        "event_id", (F.col("user_id") % 12).alias("task"), (F.get_json_object("props", "$.k").cast("int") % 6).alias("error"), (F.col("event_id") % 4).alias("ext"),
        (F.col("event_type") == "purchase").cast("int").alias("won"),
    )
    levels = [["task", "error", "ext"], ["task", "error"], ["error", "ext"], ["error"], ["task"]]
    asked = e.select("task", "error", "ext").distinct()
    picks = []
    for i, keys in enumerate(levels):
        sums = e.groupBy(*keys).agg(F.count("*").alias(f"n{i}"), F.sum("won").alias(f"w{i}"))
        asked = asked.join(sums, keys)
        picks.append(F.when(F.col(f"n{i}") >= 40, F.struct(F.lit(i).alias("level"), (F.col(f"w{i}") / F.col(f"n{i}")).alias("rate"))))
    total = F.broadcast(e.agg(F.count("*").alias("n"), F.sum("won").alias("w")))  # one row
    overall = F.when(F.col("n") >= 40, F.struct(F.lit(5).alias("level"), (F.col("w") / F.col("n")).alias("rate")))
    best = asked.crossJoin(total).withColumn("best", F.coalesce(*picks, overall))
    return best.select("task", "error", "ext", F.col("best.level").alias("level"), F.round("best.rate", 6).alias("rate"))


_FB = [("task, error, ext", 0), ("task, error", 1), ("error, ext", 2), ("error", 3), ("task", 4)]
FALLBACK = (
    "with e as (select user_id % 12 as task, (props->>'$.k')::int % 6 as error, event_id % 4 as ext, (event_type = 'purchase')::int as won from events), "
    + ", ".join(f"s{i} as (select {k}, count(*) as n{i}, sum(won) as w{i} from e group by {k})" for k, i in _FB)
    + " select task, error, ext, case "
    + " ".join(f"when n{i} >= 40 then {i}" for _, i in _FB)
    + " when n >= 40 then 5 end::int as level, round(case "
    + " ".join(f"when n{i} >= 40 then w{i} / n{i}" for _, i in _FB)
    + " when n >= 40 then w / n end, 6) as rate from (select distinct task, error, ext from e) "
    + " ".join(f"join s{i} using ({k})" for k, i in _FB)
    + ", (select count(*) as n, sum(won) as w from e)"
)


def validation_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as gates, line items as observations: the latest one per gate decides; verdicts follow the documented order."""
    gates = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("gate"), (F.col("o_orderkey") % 5 != 0).alias("required"), (F.col("o_orderkey") % 3).alias("revision"),
        (F.col("o_orderkey") % 7 == 0).alias("allow_waiver"), (F.col("o_orderkey") % 2).cast("int").alias("expected"),
    )
    seen = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("gate"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("at"), "l_linenumber",
        F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_linenumber") == 7, "waived").when(F.col("l_linenumber") == 6, "pending").otherwise("passed").alias("status"),
        F.when(F.col("l_linenumber") == 5, F.lit(-1)).otherwise(F.col("l_orderkey") % 3).alias("seen_revision"), (F.col("l_partkey") % 2).cast("int").alias("actual"),
    )
    latest = seen.groupBy("gate").agg(F.max(F.struct("at", "l_linenumber", "status", "seen_revision", "actual")).alias("o")).select("gate", "o.status", "o.seen_revision", "o.actual")
    joined = gates.where("required").join(latest, "gate", "left")
    fits = F.col("actual") == F.col("expected")
    verdict = (
        F.when(F.col("status").isNull() | (F.col("status") == "pending"), "pending")
        .when(F.col("revision") != F.col("seen_revision"), "stale")
        .when((F.col("status") == "passed") & fits, "passed")
        .when((F.col("status") == "waived") & F.col("allow_waiver"), "waived")
        .when((F.col("status") == "failed") | ((F.col("status") == "passed") & ~fits), "failed")
        .otherwise("unavailable")
    )
    return joined.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("gates"), F.sum("gate").alias("key_sum"))


GATES = """with g as (select o_orderkey as gate, o_orderkey % 3 as revision, o_orderkey % 7 = 0 as allow_waiver, o_orderkey % 2 as expected from orders where o_orderkey % 5 <> 0),
o as (select *, row_number() over (partition by l_orderkey order by l_shipdate desc, l_linenumber desc) as rn from (select l_orderkey, l_shipdate, l_linenumber,
  case when l_returnflag = 'R' then 'failed' when l_linenumber = 7 then 'waived' when l_linenumber = 6 then 'pending' else 'passed' end as status,
  case when l_linenumber = 5 then -1 else l_orderkey % 3 end as seen_revision, l_partkey % 2 as actual from lineitem)),
j as (select g.*, status, seen_revision, actual from g left join o on o.l_orderkey = g.gate and rn = 1)
select case when status is null or status = 'pending' then 'pending' when revision <> seen_revision then 'stale' when status = 'passed' and actual = expected then 'passed'
  when status = 'waived' and allow_waiver then 'waived' when status = 'failed' or (status = 'passed' and actual <> expected) then 'failed' else 'unavailable' end as verdict,
  count(*) as gates, sum(gate) as key_sum from j group by 1"""


def components_cosine(spark: SparkSession, sf_dir: str, bar: float = 0.85) -> DataFrame:
    """Single-linkage clusters of all vectors: components of cosine >= ``bar`` per embedding dimension; a vector without links is its own."""
    from tessera.operators.vectors import linking_edges

    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.lit(0).alias("grp"), F.col("embedding").alias("vector"))
    labels = connected_components(linking_edges(v, bar), "a", "b")
    return v.select(F.col("id").alias("node")).join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


COSINE_COMPONENTS = f"""with recursive p as (select a.vec_id as u, b.vec_id as v from embeddings a join embeddings b on a.vec_id <> b.vec_id and len(a.embedding) = len(b.embedding) and {_COS.format(a="a.embedding", b="b.embedding")} >= 0.85),
r as (select vec_id as node, vec_id as other from embeddings union select r.node, p.v from r join p on p.u = r.other)
select node, min(other) as component from r group by node"""


def import_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of modules that reach each other; an edge from each order's customer key to its order key."""
    from tessera.operators.cycles import cycle_groups

    return cycle_groups(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")))


def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored stamps against current ones: equal size and time mean unchanged, else the content hash decides."""
    d = read(spark, sf_dir, "documents")
    stored = d.where("doc_id % 11 <> 0").select("doc_id", F.col("n_chars").alias("size"), F.lit(1).alias("mtime"), F.sha2("text", 256).alias("hash"))
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    current = d.where("doc_id % 13 <> 0").select("doc_id", F.length(text).alias("new_size"), F.when(F.col("doc_id") % 5 < 2, 2).otherwise(1).alias("new_mtime"), F.sha2(text, 256).alias("new_hash"))
    j = stored.join(current, "doc_id", "full_outer")
    change = (
        F.when(F.col("new_size").isNull(), "removed").when(F.col("size").isNull(), "added")
        .when((F.col("size") == F.col("new_size")) & (F.col("mtime") == F.col("new_mtime")), "unchanged")
        .when(F.col("hash") == F.col("new_hash"), "touched").otherwise("changed")
    )
    return j.groupBy(change.alias("change")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("key_sum"))


CHANGES = """with s as (select doc_id, n_chars as size, 1 as mtime, sha256(text) as hash from documents where doc_id % 11 <> 0),
t as (select doc_id, case when doc_id % 5 = 0 then text || '!' else text end as text from documents where doc_id % 13 <> 0),
n as (select doc_id, length(text) as new_size, case when doc_id % 5 < 2 then 2 else 1 end as new_mtime, sha256(text) as new_hash from t)
select case when new_size is null then 'removed' when size is null then 'added' when size = new_size and mtime = new_mtime then 'unchanged' when hash = new_hash then 'touched' else 'changed' end as change,
  count(*) as n, sum(doc_id) as key_sum from s full join n using (doc_id) group by 1"""


def merge_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge-on-save of two versions of a table: counters by maximum; ours wins if invalid; peers' new rows stay unless deleted."""
    c = read(spark, sf_dir, "customer")
    disk = c.where("c_custkey % 7 <> 0").select("c_custkey", (F.col("c_custkey") % 4).alias("d_success"), (F.col("c_custkey") % 9 / 10).alias("d_conf"), (F.col("c_custkey") % 5 != 0).alias("d_valid"))
    ours = c.where("c_custkey % 6 <> 0").select("c_custkey", (F.col("c_custkey") % 3).alias("success"), (F.col("c_custkey") % 8 / 10).alias("conf"), (F.col("c_custkey") % 4 != 0).alias("valid"))
    j = disk.join(ours, "c_custkey", "full_outer").where("not (valid is null and c_custkey % 12 = 0)")
    stronger = F.col("d_valid") & (F.col("d_success") > F.col("success"))
    conf = F.when(F.col("valid").isNull(), F.col("d_conf")).when(F.col("d_conf").isNull() | ~F.col("valid") | ~stronger, F.col("conf")).otherwise(F.greatest("conf", "d_conf"))
    success = F.greatest("success", "d_success")
    valid = F.coalesce("valid", "d_valid")
    return j.select("c_custkey", success.alias("success"), F.round(conf, 2).alias("confidence"), valid.alias("is_valid"))


MERGE = """with d as (select c_custkey, c_custkey % 4 as ds, c_custkey % 9 / 10 as dc, c_custkey % 5 <> 0 as dv from customer where c_custkey % 7 <> 0),
o as (select c_custkey, c_custkey % 3 as s, c_custkey % 8 / 10 as c, c_custkey % 4 <> 0 as v from customer where c_custkey % 6 <> 0)
select c_custkey, greatest(s, ds) as success, round(case when v is null then dc when dc is null or not v or not (dv and ds > s) then c else greatest(c, dc) end, 2) as confidence, coalesce(v, dv) as is_valid
from d full join o using (c_custkey) where not (v is null and c_custkey % 12 = 0)"""


def latest_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tie rules over ranked outcomes of a user: the first of the best rank (dedup) and the last of it (ledger); worst verdict."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.when(F.col("event_type").isin("purchase", "signup", "error"), 3).when(F.col("event_type") == "click", 2).otherwise(1).alias("rank"))
    verdicts = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 3).otherwise(6)
    return e.groupBy("user_id").agg(
        F.max_by("event_type", F.struct("rank", -F.col("event_id"))).alias("deduped"),
        F.max_by("event_type", F.struct("rank", "event_id")).alias("ledger"),
        F.min(verdicts).alias("verdict"),
    )


LATEST = """with e as (select *, case when event_type in ('purchase','signup','error') then 3 when event_type = 'click' then 2 else 1 end as rank,
  case event_type when 'error' then 0 when 'click' then 1 when 'view' then 3 else 6 end as v from events),
a as (select *, row_number() over (partition by user_id order by rank desc, event_id) as f, row_number() over (partition by user_id order by rank desc, event_id desc) as l from e)
select user_id, max(event_type) filter (f = 1) as deduped, max(event_type) filter (l = 1) as ledger, min(v)::int as verdict from a group by user_id"""

QUERIES = {
    "log_metrics": (log_metrics, LOG_METRICS),
    "citation_survival": (citation_survival, CITATION),
    "learning_pulse": (learning_pulse, PULSE),
    "promotion": (promotion, PROMOTION),
    "cross_project_promotion": (cross_project_promotion, CROSS),
    "signature_dedup": (signature_dedup, SIG_DEDUP),
    "interval_correlation": (interval_correlation, INTERVAL),
    "bucket_fallback": (bucket_fallback, FALLBACK),
    "validation_gates": (validation_gates, GATES),
    "import_cycles": (import_cycles, None),
    "components_cosine": (components_cosine, COSINE_COMPONENTS),
    "change_detection": (change_detection, CHANGES),
    "merge_reconcile": (merge_reconcile, MERGE),
    "latest_outcome": (latest_outcome, LATEST),
}
