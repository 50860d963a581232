"""Selection queries: budgets, slots, file scores, ignore rules, clusters and outcome matching, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.functions import text as T
from tessera.operators import budget as B
from tessera.operators.clusters import complete_link, merge_clusters
from tessera.operators.ignore import glob_regex, ignored
from tessera.plans.search import FACTS_SQL
from tessera.sources.tables import facts, read


def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of a context: constraints within two thirds, then the top facts, each at least one, in what is left."""
    d = read(spark, sf_dir, "documents").withColumn("cost", F.floor(F.col("n_chars") / 4)).withColumn("layer", F.when(F.col("doc_id") % 5 == 0, "constraint").otherwise("fact"))
    groups = d.select("source", "layer", "doc_id", "cost")
    c = B.within_budget(groups.where("layer = 'constraint'"), ["source"], ["doc_id"], "cost", F.lit(4000), True)
    spent = c.groupBy("source").agg(F.sum("cost").alias("spent"))
    w = Window.partitionBy("source").orderBy(F.col("cost").desc(), "doc_id")
    top = groups.where("layer = 'fact'").withColumn("rank", F.row_number().over(w)).where("rank <= 5")
    top = top.join(spent, "source", "left").withColumn("rest", F.greatest(F.lit(0), 6000 - F.coalesce("spent", F.lit(0))))
    f = B.within_budget(top, ["source"], [F.col("cost").desc(), F.col("doc_id")], "cost", F.col("rest"), True)
    return c.select("source", "layer", "doc_id", "used").unionByName(f.select("source", "layer", "doc_id", "used"))


CONTEXT = """with d as (select source, doc_id, n_chars // 4 as cost, case when doc_id % 5 = 0 then 'constraint' else 'fact' end as layer from documents),
c as (select *, sum(cost) over (partition by source order by doc_id) as used, row_number() over (partition by source order by doc_id) as place from d where layer = 'constraint'),
k as (select * from c where used <= 4000 or place = 1), s as (select source, sum(cost) as spent from k group by 1),
t as (select *, row_number() over (partition by source order by cost desc, doc_id) as place from d where layer = 'fact'),
f as (select t.*, sum(cost) over (partition by source order by cost desc, doc_id) as used, greatest(0, 6000 - coalesce(spent, 0)) as rest from t left join s using (source) where place <= 5)
select source, layer, doc_id, used from k union all select source, layer, doc_id, used from f where used <= rest or place = 1"""


def apportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Max-min fair shares of 20 000 characters among the documents of each (source, language)."""
    d = read(spark, sf_dir, "documents").select(F.concat_ws("-", "source", "lang").alias("grp"), "doc_id", "n_chars")
    return B.fair_shares(d, "grp", "n_chars", 20_000, "doc_id").select("grp", "doc_id", "share")


APPORTION = """with d as (select source || '-' || lang as grp, doc_id, n_chars from documents where n_chars > 0),
p as (select *, coalesce(sum(n_chars) over (partition by grp order by n_chars, doc_id rows between unbounded preceding and 1 preceding), 0) as before,
  count(*) over (partition by grp) - row_number() over (partition by grp order by n_chars, doc_id) + 1 as rest, row_number() over (partition by grp order by n_chars, doc_id) as pos from d),
q as (select *, floor((20000 - before) / rest) as quotient from p),
s as (select grp, min(pos) as stop, arg_min(quotient, pos) as quotient from q where n_chars > quotient group by grp)
select q.grp, doc_id, (case when stop is null or pos < stop then n_chars else s.quotient end)::bigint as share from q left join s on s.grp = q.grp"""


def slot_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read(spark, sf_dir, "documents").groupBy(F.concat_ws("-", "lang", F.when(F.col("doc_id") % 3 == 0, "a").otherwise("b")).alias("name")).agg(F.count("*").alias("n"))
    return B.slots(counts, "name", "n", 100)


SLOTS = """with c as (select lang || '-' || case when doc_id % 3 = 0 then 'a' else 'b' end as name, count(*) as n from documents group by 1),
b as (select *, sum(n) over () as total, count(*) over () as names, row_number() over (order by n desc, name) as seat from c),
x as (select name, n, names, case when names >= 100 then (seat <= 100)::bigint else least(n, 1 + floor(n / total * (100 - names)))::bigint end as base from b),
f as (select 100 - sum(base) as free from x),
r as (select name, n, unnest(range(1, least(n - base, free)::bigint + 1)) as round from x, f where free > 0 and names < 100),
g as (select name, count(*) as extra from (select *, row_number() over (order by round, n desc, name) as turn from r) , f where turn <= free group by 1)
select name, n, base + coalesce(extra, 0) as slots from x left join g using (name)"""


def file_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path scores: documentation, archives, keyword hits, recency, entry points, depth, demoted tests (ranked down, never out)."""
    path = F.regexp_replace(F.col("url"), r"^https?://[^/]+/?", "")
    p = F.concat(F.when(F.col("page_id") % 7 == 0, "tests/").when(F.col("page_id") % 7 == 1, "docs/").when(F.col("page_id") % 7 == 2, "src/old/").otherwise("src/"), path, F.lit(".py"))
    rows = read(spark, sf_dir, "pages").select("page_id", p.alias("path"), (F.col("page_id") % 10 / 10).alias("content"))
    low = F.lower("path")
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda k: F.contains(low, k))
    hits = sum((F.contains(low, F.lit(t)).cast("int") for t in ("en", "page", "th", "src")), F.lit(0))
    base = (
        F.when(any_of(["readme", "architecture", "design", "claude.md", "contributing", "docs/"]), 0.8).otherwise(0.0) - F.when(any_of(["archive", "old", "deprecated"]), 0.5).otherwise(0.0)
        + 3.0 * F.col("content") + 0.15 * F.least(F.lit(3), hits) + F.when(F.col("page_id") % 4 == 0, 0.3).otherwise(0.0)
    )
    test = T.is_test_path(F.col("path"))
    rows = rows.withColumn("base", base).withColumn("test", test)
    depth = 0.05 * (F.size(F.split("path", "/")) - 1)
    score = F.when(F.col("test"), F.col("base") * 0.4).otherwise(F.col("base")) - depth
    forfeited = F.when(F.col("test"), F.col("base") * 0.6).otherwise(0.0)
    kept = F.when((forfeited != 0) & (score + forfeited >= 0.2), F.greatest(score, F.lit(0.2))).otherwise(score)
    return rows.select("page_id", "path", F.round(F.greatest(F.lit(0.0), kept), 6).alias("score"))


FILE_SCORING = """with p as (select page_id, case page_id % 7 when 0 then 'tests/' when 1 then 'docs/' when 2 then 'src/old/' else 'src/' end || regexp_replace(url, '^https?://[^/]+/?', '') || '.py' as path, page_id % 10 / 10 as content from pages),
b as (select *, lower(path) as low from p),
s as (select *, (case when len(list_filter(['readme','architecture','design','claude.md','contributing','docs/'], lambda k: contains(low, k))) > 0 then 0.8 else 0 end)
  - (case when len(list_filter(['archive','old','deprecated'], lambda k: contains(low, k))) > 0 then 0.5 else 0 end) + 3.0 * content + 0.15 * least(3, len(list_filter(['en','page','th','src'], lambda k: contains(low, k))))
  + (case when page_id % 4 = 0 then 0.3 else 0 end) as base,
  len(list_filter(string_split(low, '/')[:-2], lambda f: f in ('test','tests','spec','specs','__tests__') or ends_with(f, '.tests'))) > 0 or regexp_matches(string_split(path, '/')[-1], '^test_|_test\\.|_spec\\.|\\.test\\.|\\.spec\\.|^Test[A-Z0-9]|Tests?\\.') as test,
  0.05 * (len(string_split(path, '/')) - 1) as depth from b),
t as (select *, (case when test then base * 0.4 else base end) - depth as score0, case when test then base * 0.6 else 0 end as forfeited from s)
select page_id, path, round(greatest(0, case when forfeited <> 0 and score0 + forfeited >= 0.2 then greatest(score0, 0.2) else score0 end), 6)::double as score from t"""

RULES = ["# built", "*.py", "!src/**/en/*", "/tests/", "docs/*/5*", "src/old/**", "!**/*ref=x*"]


def ignore_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = file_scoring(spark, sf_dir)
    return files.select("page_id", ignored(F.col("path"), RULES).alias("ignored"))


def _ignore_sql() -> str:
    case = "false"
    for rule in RULES:
        if not rule.startswith("#"):
            regex, negated, _ = glob_regex(rule)
            case = f"case when regexp_matches(path, '{regex}') then {str(not negated).lower()} else {case} end"
    return f"with f as ({FILE_SCORING}) select page_id, {case} as ignored from f"


def adaptive_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File limit by a prompt's specificity, and k by the first rule that fits."""
    tokens = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_][A-Za-z0-9_./]{2,}"), F.lit(0)))
    rows = read(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text", tokens.alias("t"))
    technical = F.size(F.filter("t", lambda x: x.rlike(r"[_A-Z/.]")))
    specific = F.size("t") * 0.8 + technical * 3.0 + F.size(F.filter("t", lambda x: F.length(x) > 6)) * 1.2
    words = F.size(F.filter(F.split("text", r"[ \t\n\r\f]+"), lambda w: w != ""))
    k = F.when((F.col("conv_id") % 9 == 0) & (F.col("turn") > 2), 3).when(F.col("conv_id") % 9 == 1, 20).when(words > 50, 20).when(words < 5, 30).otherwise(10)
    limit = F.when(specific < 2, 15).when(specific < 5, 20).when(specific < 10, 25).otherwise(30)
    return rows.select("conv_id", "turn", limit.alias("file_limit"), k.alias("k"))


LIMITS = """with r as (select conv_id, turn, text, list_distinct(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_./]{2,}')) as t, len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda w: w <> '')) as words
  from conversations where role = 'user'),
s as (select *, len(t) * 0.8 + len(list_filter(t, lambda x: regexp_matches(x, '[_A-Z/.]'))) * 3.0 + len(list_filter(t, lambda x: length(x) > 6)) * 1.2 as sp from r)
select conv_id, turn, (case when sp < 2 then 15 when sp < 5 then 20 when sp < 10 then 25 else 30 end)::int as file_limit,
  (case when conv_id % 9 = 0 and turn > 2 then 3 when conv_id % 9 = 1 then 20 when words > 50 then 20 when words < 5 then 30 else 10 end)::int as k from s"""


def project_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised remotes and project ids of page addresses in their several spellings."""
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    owner = F.concat(F.lit("Team"), (F.col("page_id") % 5).cast("string"))
    repo = F.concat(F.lit("repo"), (F.col("page_id") % 11).cast("string"))
    remote = (
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://user:pw@"), F.upper(host), F.lit("/"), owner, F.lit("/"), repo, F.lit(".git")))
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit("git@"), host, F.lit(":"), owner, F.lit("/"), repo, F.lit(".git")))
        .when(F.col("page_id") % 4 == 2, F.concat(F.lit("ssh://git@"), host, F.lit("/"), owner, F.lit("/"), repo, F.lit("/")))
        .otherwise("")
    )
    rows = read(spark, sf_dir, "pages").select("page_id", remote.alias("remote"), F.concat(F.lit("/work/"), repo).alias("path"))
    return rows.select("page_id", T.normalize_remote(F.col("remote")).alias("remote"), T.project_id(F.col("remote"), F.col("path")).alias("project_id"))


PROJECTS = """with b as (select page_id, regexp_extract(url, '^https?://([^/]+)', 1) as host, 'Team' || (page_id % 5) as o, 'repo' || (page_id % 11) as r from pages),
n as (select page_id, case when page_id % 4 < 3 then lower(host) || '/' || o || '/' || r else '' end as remote, '/work/' || r as path from b)
select page_id, remote, substring(sha256(case when remote <> '' then remote else path end), 1, 16) as project_id from n"""


def outcome_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions against changed files: accepted by line overlap above .3, modified below, independent without one (top five by size)."""
    d = read(spark, sf_dir, "documents")
    suggested = d.where("doc_id % 3 = 0").select(F.concat(F.lit("./"), F.lower("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("raw"), "text")
    suggested = suggested.select(F.regexp_replace("raw", r"^\./", "").alias("path"), F.array_distinct(F.split("text", "\n")).alias("lines"))
    edited = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("new line\n"), F.substring("text", 1, 50)))
    changed = d.where("doc_id % 4 < 2").select(F.concat(F.lower("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.array_distinct(F.split(edited, "\n")).alias("now"), F.length(edited).alias("size"))
    j = suggested.join(changed, "path")
    overlap = F.size(F.array_intersect("lines", "now")) / F.size(F.array_union("lines", "now"))
    matched = j.select("path", F.when(overlap > 0.3, "accepted").otherwise("modified").alias("outcome"))
    free = changed.join(suggested.select("path"), "path", "left_anti").orderBy(F.col("size").desc(), "path").limit(5)
    waiting = suggested.join(changed.select("path"), "path", "left_anti").select("path", F.lit("unresolved").alias("outcome"))
    return matched.unionByName(free.select("path", F.lit("independent").alias("outcome"))).unionByName(waiting)


OUTCOMES = """with s as (select lower(source) || '/' || doc_id as path, list_distinct(string_split(text, chr(10))) as l from documents where doc_id % 3 = 0),
e as (select lower(source) || '/' || doc_id as path, case when doc_id % 2 = 0 then text else 'new line' || chr(10) || substring(text, 1, 50) end as t from documents where doc_id % 4 < 2),
c as (select path, list_distinct(string_split(t, chr(10))) as n, length(t) as size from e)
select path, case when len(list_intersect(l, n)) / len(list_distinct(list_concat(l, n))) > 0.3 then 'accepted' else 'modified' end as outcome from s join c using (path) union all
select path, 'independent' from (select path from c where path not in (select path from s) order by size desc, path limit 5) union all select path, 'unresolved' from s where path not in (select path from c)"""


def cluster_complete_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complete_link(read(spark, sf_dir, "embeddings").where("label is not null"), "label", "vec_id", "embedding", 0.85)


def cluster_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merge_clusters(facts(read(spark, sf_dir, "events")).withColumn("cluster", F.col("fact_id") % 12), "cluster")
    return out.withColumns({"confidence": F.round("confidence", 6), "created_at": F.round("created_at", 3), "last_accessed": F.round("last_accessed", 3)})


CLUSTER_MERGE = f"""with {FACTS_SQL}
select fact_id % 12 as cluster, count(*) as members, round(least(0.95, sum(confidence * (success_count + 1)) / sum(success_count + 1)), 6)::double as confidence, sum(success_count) as success_count, sum(access_count) as access_count,
  round(min(created_at), 3) as created_at, round(max(last_accessed), 3) as last_accessed, array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') as tags from facts group by 1"""

QUERIES = {
    "context_budget": (context_budget, CONTEXT),
    "apportion": (apportion, APPORTION),
    "slot_allocation": (slot_allocation, SLOTS),
    "file_scoring": (file_scoring, FILE_SCORING),
    "ignore_rules": (ignore_rules, _ignore_sql()),
    "adaptive_limits": (adaptive_limits, LIMITS),
    "project_ids": (project_ids, PROJECTS),
    "outcome_match": (outcome_match, OUTCOMES),
    "cluster_complete_link": (cluster_complete_link, None),
    "cluster_merge": (cluster_merge, CLUSTER_MERGE),
}
