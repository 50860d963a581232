"""Queries of the small rules: prompts, paths, windows, gates, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import rules as R
from tessera.plans.search import FACTS_SQL
from tessera.sources.tables import facts, read


def _quoted(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every whole text: whether it is about testing, the paths that it names, its algorithm category and the causes of failure in it."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" see "), "source", F.lit("\\"), "lang", F.lit(".py")).alias("t"))
    paths = F.sort_array(R.explicit_paths(F.col("t")))
    return d.select("doc_id", R.targets_tests(F.col("t")).alias("about_tests"), F.array_join(paths, " ").alias("paths"), R.algorithm_category(F.col("t")).alias("category"), F.array_join(R.failure_causes(F.col("t")), "; ").alias("causes"))


TEXT_RULES = r"""with d as (select doc_id, coalesce(text, '') || ' see ' || source || '\' || lang || '.py' as t from documents), l as (select *, lower(t) as low from d)
select doc_id, regexp_matches(t, '(?i)(^|[^\p{L}\p{N}_])(test|pytest($|[^\p{L}\p{N}_])|specs?($|[^\p{L}\p{N}_]))') as about_tests,
  array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, '[A-Za-z0-9_][A-Za-z0-9_./\\-]*\.[A-Za-z][A-Za-z0-9]{0,5}'), lambda x: lower(replace(x, '\', '/'))))), ' ') as paths,
  case when regexp_matches(low, 'two pointer|left right|start end|both ends|from edges') then 'two-pointer' when regexp_matches(low, 'sliding window|subarray|substring|consecutive|window size') then 'sliding-window'
    when regexp_matches(low, 'hash map|dictionary|frequency|count occurrences|lookup') then 'hash-map' when regexp_matches(low, 'binary search|sorted array|log n|divide half|mid point') then 'binary-search'
    when regexp_matches(low, 'dp|dynamic programming|memoization|subproblem|optimal substructure') then 'dynamic-programming' when regexp_matches(low, 'greedy|local optimum|sorted first|priority') then 'greedy'
    when regexp_matches(low, 'backtrack|recursion|try all|explore paths|permutation|combination') then 'backtracking' when regexp_matches(low, 'graph|bfs|dfs|traversal|adjacency|connected') then 'graph'
    when regexp_matches(low, 'tree|binary tree|level order|inorder|preorder|postorder') then 'tree' when regexp_matches(low, 'stack|lifo|push pop|monotonic') then 'stack' when regexp_matches(low, 'queue|fifo|deque') then 'queue'
    when regexp_matches(low, 'heap|priority queue|max heap|min heap') then 'heap' when regexp_matches(low, 'sort|merge sort|quick sort|bubble sort') then 'sort' else 'general' end as category,
  array_to_string(list_filter([case when regexp_matches(low, 'timeout|time limit') then 'Performance: timeout on large input' end, case when regexp_matches(low, 'indexerror|out of range') then 'Edge case: array index out of bounds' end,
    case when regexp_matches(low, 'keyerror|not found') then 'Edge case: missing key/value' end, case when regexp_matches(low, 'empty|null|none') then 'Edge case: empty or null input' end,
    case when regexp_matches(low, 'assertionerror|wrong answer') then 'Logic error: incorrect algorithm or calculation' end], lambda x: x is not null)[1:3], '; ') as causes from l"""

_FOLDERS = ["src", "docs", "code-review", "reviews", "lib/docs", "a/architecture-review", "tests"]
_NAMES = ["main.py", "REVIEW.md", "review_service.py", "index.TSX", "Notes.md", ".env", "data.tar.gz", "lib.hpp", "Makefile"]


def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, kind and trackability of paths; and which of a prompt's paths name them."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    p = read(spark, sf_dir, "pages").select("page_id", F.concat(pick(_FOLDERS, F.col("page_id")), F.lit("/"), F.col("page_id").cast("string"), F.lit("/"), pick(_NAMES, F.floor(F.col("page_id") / 7))).alias("path"))
    p = p.withColumn("path", F.when(F.col("page_id") % 50 == 0, "/dev/null").when(F.col("page_id") % 51 == 0, "/NO_MODIFY").otherwise(F.col("path")))
    asked = F.array(F.lit("review.md"), F.lit("/home/me/src/7/main.py"), F.lit("21/main.py"))
    return p.select(
        "page_id", "path", R.language_of(F.col("path")).alias("language"), R.is_code_file(F.col("path")).alias("code"), R.is_review_only(F.col("path")).alias("review"),
        R.is_untrackable(F.col("path"), F.ltrim(F.col("path"), F.lit("/"))).alias("untrackable"), R.names_path(F.col("path"), asked).alias("named"),
    )


PATH_RULES = r"""with p as (select page_id, case when page_id % 50 = 0 then '/dev/null' when page_id % 51 = 0 then '/NO_MODIFY' else
  ['src','docs','code-review','reviews','lib/docs','a/architecture-review','tests'][(page_id % 7 + 1)::int] || '/' || page_id || '/' || ['main.py','REVIEW.md','review_service.py','index.TSX','Notes.md','.env','data.tar.gz','lib.hpp','Makefile'][(page_id // 7 % 9 + 1)::int] end as path from pages),
b as (select *, lower(path) as low, string_split(lower(path), '/')[-1] as base, ltrim(path, '/') as norm from p),
r as (select *, path in ('NO_MODIFY', '/NO_MODIFY') or (ends_with(base, '.md') and contains(base, 'review')) or len(list_filter(string_split(trim(low, '/'), '/')[:-2], lambda s: s in ('review', 'reviews') or ends_with(s, '-review'))) > 0 as review from b)
select page_id, path, case when base = 'main.py' or base = 'review_service.py' then 'python' when base = 'index.tsx' then 'tsx' when base = 'lib.hpp' then 'cpp' end as language,
  base in ('main.py', 'review_service.py', 'index.tsx', 'lib.hpp') as code, review, path = '/dev/null' or starts_with(norm, 'docs/') or contains(norm, '/docs/') or review as untrackable,
  len(list_filter(['review.md', '/home/me/src/7/main.py', '21/main.py'], lambda t: low = t or ends_with(low, '/' || t) or ends_with(t, '/' || low))) > 0 as named from r"""


def windows_and_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows such as 14d in seconds, and stamps of several forms as seconds since 1970."""
    e = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    given = F.element_at(F.array(*map(F.lit, ["14d", "48h", "30m", "3600s", "1.5w", " ALL ", "0", "", "90", "7D"])), (F.col("event_id") % 10 + 1).cast("int"))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    stamp = F.when(F.col("event_id") % 3 == 0, F.concat(iso, F.lit("Z"))).when(F.col("event_id") % 3 == 1, F.unix_seconds("ts").cast("string")).otherwise("yesterday")
    return e.select("event_id", R.since_seconds(given).alias("window"), R.epoch(stamp).alias("seconds"))


WINDOWS = """select event_id, ([1209600.0, 172800.0, 1800.0, 3600.0, 907200.0, null, null, null, 90.0, 604800.0])[(event_id % 10 + 1)::int]::double as window,
  case when event_id % 3 < 2 then floor(epoch(ts))::double end as seconds from events"""


def fact_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By scope and kind: contributable facts, their mean confidence, the effort and the mode that this evidence asks for."""
    f = facts(read(spark, sf_dir, "events"))
    per = f.where("is_valid").groupBy("scope", "kind").agg(F.count("*").alias("patterns"), F.avg("confidence").alias("mean"), F.count(F.when(R.is_contributable(0.5, 1), 1)).alias("contributable"))
    difficulty = F.when(F.col("kind") == "pattern", "hard").otherwise("medium")
    models = F.length("kind") % 3
    choice = R.mode(R.effort(F.col("patterns"), F.col("mean"), difficulty), F.col("scope") != "org", models, F.when(F.col("scope") == "session", "deep").otherwise(""))
    return per.withColumn("choice", choice).select("scope", "kind", "patterns", "contributable", F.round("mean", 6).alias("mean"), "choice.mode", "choice.effort")


FACT_GATES = f"""with {FACTS_SQL},
p as (select scope, kind, count(*) as patterns, avg(confidence) as mean, count(*) filter (kind <> 'constraint' and not list_has_any(tags, ['seed','community','constraint','history','git-commit']) and confidence >= 0.5 and success_count >= 1) as contributable
  from facts where is_valid group by all),
e as (select *, case when patterns = 0 then case when kind = 'pattern' then 'xhigh' else 'high' end when mean < 0.5 then 'high' when patterns >= 3 and mean >= 0.8 then 'low' else 'medium' end as level, scope <> 'org' and length(kind) % 3 >= 1 as able from p)
select scope, kind, patterns, contributable, round(mean, 6) as mean, case when scope = 'session' then case when able then 'multi_agent' else 'fast' end when level in ('high', 'xhigh') and able then 'multi_agent' else 'fast' end as mode,
  case when scope = 'session' and not able then 'xhigh' else level end as effort from e"""


def lesson_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lessons of conversations: whether their span is held word for word, and as what they are admitted."""
    t = read(spark, sf_dir, "conversations")
    per = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    parts = F.transform("turns", lambda x: x["text"])
    last = F.regexp_replace(F.element_at(parts, -1), " ", "  \n")
    span = F.when(F.col("conv_id") % 4 == 0, F.concat(last, F.lit(" never said"))).when(F.col("conv_id") % 4 == 1, F.lit("  ")).otherwise(last)
    kind = F.when(F.col("conv_id") % 2 == 0, "failure").otherwise("insight")
    conf = F.element_at(F.array(*map(F.lit, ["0.9", "high", "0.3", "0"])), (F.col("conv_id") % 4 + 1).cast("int"))
    got = R.admitted(kind, conf, F.when(F.col("conv_id") % 3 == 0, "other").otherwise("web"), F.when(F.col("conv_id") % 5 == 0, "review"))
    return per.select("conv_id", R.evidence_held(span, parts).alias("held"), got.alias("a")).select("conv_id", "held", "a.kind", "a.confidence", "a.domain")


_SQ = r"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
LESSONS = rf"""with c as (select conv_id, list(coalesce(text, '') order by turn, role, coalesce(text, '')) as parts from conversations group by 1),
s as (select *, case conv_id % 4 when 0 then replace(parts[-1], ' ', '  ' || chr(10)) || ' never said' when 1 then '  ' else replace(parts[-1], ' ', '  ' || chr(10)) end as span from c),
q as (select *, {_SQ.format(x="span")} as s, {_SQ.format(x="array_to_string(parts, ' ')")} as h from s)
select conv_id, s <> '' and contains(h, s) as held, case when conv_id % 5 = 0 then 'review' when conv_id % 2 = 0 then 'failure' else 'pattern' end as kind,
  ([0.6, 0.5, 0.3, 0.5])[(conv_id % 4 + 1)::int]::double as confidence, case when conv_id % 3 = 0 then '' else 'web' end as domain from q"""


def architecture_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of the change between consecutive snapshots of each customer, and the reason of a change by its diff."""
    from pyspark.sql import Window

    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 4).alias("god"), (F.col("o_orderkey") % 3).alias("cycles"), (F.col("o_orderkey") % 5).alias("depth"), (F.col("o_orderkey") % 7 > 0).alias("covered"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    delta = lambda c: F.col(c) - F.lag(c).over(w)
    d = o.withColumns({"g": delta("god"), "c": delta("cycles"), "d": delta("depth"), "both": F.col("covered") & F.lag("covered").over(w)}).where("g is not null")
    diff = F.concat(F.lit("--- a\n+++ b\n"), F.repeat(F.lit("+x\n"), (F.col("o_orderkey") % 3).cast("int")), F.repeat(F.lit("-y\n"), (F.floor(F.col("o_orderkey") / 3) % 3).cast("int")))
    severity = R.architecture_severity(F.col("g"), F.col("c"), F.col("d"), F.col("both"))
    return d.withColumns({"severity": severity, "reason": R.change_reason(diff)}).groupBy("severity", "reason").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))


ARCHITECTURE = """with o as (select *, o_orderkey % 4 - lag(o_orderkey % 4) over w as g, o_orderkey % 3 - lag(o_orderkey % 3) over w as c, o_orderkey % 5 - lag(o_orderkey % 5) over w as d, o_orderkey % 7 > 0 and lag(o_orderkey % 7 > 0) over w as both_,
  o_orderkey % 3 as up, o_orderkey // 3 % 3 as down from orders window w as (partition by o_custkey order by o_orderkey))
select case when g > 0 then 'regression' when g < 0 then 'improvement' when not both_ then 'neutral' when c > 0 or d > 1 then 'regression' when c < 0 or d < -1 then 'improvement' else 'neutral' end as severity,
  case when up > 0 and down = 0 then 'added' when down > 0 and up = 0 then 'removed' when up > down then 'expanded' when down > up then 'simplified' else 'modified' end as reason, count(*) as n, count(distinct o_custkey) as customers
from o where g is not null group by all"""

QUERIES = {
    "text_rules": (text_rules, TEXT_RULES),
    "path_rules": (path_rules, PATH_RULES),
    "windows_and_times": (windows_and_times, WINDOWS),
    "fact_gates": (fact_gates, FACT_GATES),
    "lesson_admission": (lesson_admission, LESSONS),
    "architecture_changes": (architecture_changes, ARCHITECTURE),
}
