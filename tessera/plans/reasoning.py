"""Reasoning queries: legacy retrieval, loop decisions, hypotheses, prompt issues, task classes, running means, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.functions import decisions as D
from tessera.functions.scores import cosine
from tessera.operators.retrieval import top_k
from tessera.plans.search import _COS, FACTS_SQL
from tessera.sources.tables import facts, read

AFFINITY = 0.2


def legacy_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by cosine times quality for a hard problem: blended success rate, usage, difficulty affinity, strategy boost; above 0.1, best ten."""
    vectors = read(spark, sf_dir, "embeddings")
    first = vectors.where("vec_id = 0").select("embedding").first()
    q = F.array(*[F.lit(float(x)) for x in (first[0] if first else [])])
    e = facts(read(spark, sf_dir, "events")).join(vectors.select(F.col("vec_id").alias("fact_id"), "embedding"), "fact_id")
    used = D.entry_quality(F.col("confidence"), F.col("success_count"), F.col("error_count"), F.col("access_count"))
    hard_n, hard_s = F.col("fact_id") % 6, F.least(F.col("fact_id") % 6, F.col("fact_id") % 5)
    with_affinity = F.when(hard_n > 0, F.least(F.lit(1.0), used + hard_s / hard_n * AFFINITY)).otherwise(used)
    level = D.strategy_level((F.col("fact_id") % 5) / 4, F.when(hard_n > 0, hard_s / hard_n).otherwise(0.5), F.col("fact_id") % 9)
    quality = F.least(F.lit(1.0), F.greatest(F.lit(0.0), with_affinity + D.strategy_boost(level, "hard")))
    scored = e.select("fact_id", level.alias("level"), F.round(cosine(F.col("embedding"), q) * quality, 6).alias("score"))
    return top_k(scored.where("score > 0.1"), "score", 10, "fact_id")


LEGACY = f"""with {FACTS_SQL}, q as (select embedding as qe from embeddings where vec_id = 0),
b as (select fact_id, {_COS.format(a="e.embedding", b="q.qe")} as sim, fact_id % 6 as hn, least(fact_id % 6, fact_id % 5) as hs, fact_id % 5 / 4 as easy,
  (case when success_count + error_count >= 10 then confidence * 0.5 + success_count / (success_count + error_count) * 0.5 else confidence end) * (0.9 + 0.1 * least(1.0, access_count / 10)) as used
  from facts join embeddings e on e.vec_id = fact_id, q),
c as (select *, case when hn > 0 then least(1.0, used + hs / hn * 0.2) else used end as quality, case when hn > 0 then hs / hn else 0.5 end as hard from b),
d as (select *, case when hard > 0.6 and fact_id % 9 > 3 then 'compositional' when easy >= 0.75 and hard < 0.4 then 'procedural' else 'adaptive' end as level from c),
s as (select fact_id, level, round(sim * least(1.0, greatest(0.0, quality + case level when 'compositional' then 0.15 when 'procedural' then -0.10 else 0.05 end)), 6) as score from d)
select fact_id, level, score, rank from (select *, row_number() over (order by score desc, fact_id) as rank from s where score > 0.1) where rank <= 10"""


LEGACY_KEYWORD = """with w as (select doc_id, source, list_filter(string_split_regex(lower(substring(text, 1, 40)), '[ \\t\\n\\r\\f]+'), lambda x: x <> '') as p,
  list_filter(string_split_regex(lower(substring(text, 41, 80)), '[ \\t\\n\\r\\f]+'), lambda x: x <> '') as c, 0.1 + doc_id % 9 / 10 as quality from documents),
r as (select doc_id, quality, least(1.0, (len(list_filter(p, lambda x: contains('the thand edly ing of', x))) > 0)::int * 0.5 + (source in ('src0','src1'))::int * 0.3
  + (len(list_filter(c, lambda x: contains('the thand edly ing of', x))) > 0)::int * 0.2) as relevance from w),
s as (select doc_id, round(relevance * quality, 6)::double as score from r where round(relevance * quality, 6) > 0.05 or relevance > 0.3 or quality > 0.6)
select doc_id, score, rank from (select *, row_number() over (order by score desc, doc_id) as rank from s) where rank <= 10"""


def legacy_keyword_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance by substrings (.5 pattern, .3 shared source, .2 context) times quality; three ways to be accepted. The first line is the pattern, all the rest the context."""
    asked = "the thand edly ing of"
    at = F.instr("text", "\n")
    first = F.when(at > 0, F.col("text").substr(F.lit(1), at - 1)).otherwise(F.col("text"))
    rest = F.when(at > 0, F.col("text").substr(at + 1, F.length("text"))).otherwise(F.lit(""))
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", first.alias("pattern"), rest.alias("context"), (0.1 + F.col("doc_id") % 9 / 10).alias("quality"))
    relevance = D.keyword_relevance(F.lit(asked), F.col("pattern"), F.col("context"), F.col("source").isin("src0", "src1"))
    scored = rows.select("doc_id", relevance.alias("relevance"), "quality", F.round(relevance * F.col("quality"), 6).alias("score"))
    return top_k(scored.where("score > 0.05 or relevance > 0.3 or quality > 0.6").select("doc_id", "score"), "score", 10, "doc_id")


LEGACY_KEYWORD = LEGACY_KEYWORD.replace("substring(text, 1, 40)", "split_part(text, chr(10), 1)").replace("substring(text, 41, 80)", "substring(text, length(split_part(text, chr(10), 1)) + 2)")


def loop_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goal status and strategy of each order as a loop: the first rule of the decision table that fits."""
    li = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.count("*").alias("required"), F.count(F.when(F.col("l_returnflag") == "A", 1)).alias("passed"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("failed"),
        F.count(F.when(F.col("l_linenumber") == 6, 1)).alias("unavailable"), F.count(F.when(F.col("l_returnflag") == "N", 1)).alias("pending"),
    )
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 10 == 0).alias("exhausted"), (F.col("o_orderkey") % 4 == 0).alias("success"), (F.col("o_orderkey") % 6).alias("d"), (F.col("o_orderkey") % 9 == 1).alias("failure"))
    j = o.join(li, "k", "left").na.fill(0, ["required", "passed", "failed", "unavailable", "pending"])
    gates = {c: F.col(c) for c in ("required", "passed", "failed", "unavailable", "pending")}
    diagnosis = F.when(F.col("d").isin(1, 2), "changed").when(F.col("d") == 3, "same")
    out = j.withColumn("v", D.loop_decision(gates, F.col("exhausted"), F.col("success"), diagnosis, F.col("failure")))
    return out.groupBy("v.goal", "v.strategy").agg(F.count("*").alias("n"), F.sum("k").alias("key_sum"))


LOOP = """with l as (select l_orderkey as k, count(*) as required, count(*) filter (l_returnflag = 'A') as passed, count(*) filter (l_returnflag = 'R') as failed,
  count(*) filter (l_linenumber = 6) as unavailable, count(*) filter (l_returnflag = 'N') as pending from lineitem group by 1),
j as (select o_orderkey as k, o_orderkey % 10 = 0 as exhausted, o_orderkey % 4 = 0 as success, o_orderkey % 6 as d, o_orderkey % 9 = 1 as failure,
  coalesce(required, 0) as required, coalesce(passed, 0) as passed, coalesce(failed, 0) as failed, coalesce(unavailable, 0) as unavailable, coalesce(pending, 0) as pending from orders left join l on l.k = o_orderkey),
v as (select k, case when required > 0 and passed = required then 'satisfied/stop_success' when exhausted then 'blocked/stop_blocked' when failed > 0 then 'in_progress/change_strategy'
  when required = 0 and success then 'unverifiable/stop_blocked' when unavailable > 0 then 'unverifiable/stop_blocked' when pending > 0 and success then 'unverifiable/continue'
  when d in (1, 2) then 'in_progress/change_strategy' when d = 3 then 'in_progress/continue' when failure then 'in_progress/change_strategy' else 'in_progress/continue' end as v from j)
select split_part(v, '/', 1) as goal, split_part(v, '/', 2) as strategy, count(*) as n, sum(k) as key_sum from v group by all"""

def hypothesis_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hypotheses with claimed transitions: disallowed ones revert, claims without evidence step down."""
    pick = lambda i: F.element_at(F.array(*map(F.lit, D.STATUSES)), (i + 1).cast("int"))
    k = F.col("o_orderkey")
    h = read(spark, sf_dir, "orders").select(k.alias("id"), pick(k % 5).alias("prior"), pick(F.floor(k / 5) % 5).alias("claimed"), (k % 3 == 0).alias("support"), (k % 7 == 0).alias("contra"), (k % 2 == 0).alias("test"))
    status = D.hypothesis_status(*(F.col(c) for c in ("prior", "claimed", "support", "contra", "test")))
    return h.withColumn("status", status).groupBy("prior", "claimed", "status").agg(F.count("*").alias("n"))


HYPOTHESES = """with h as (select o_orderkey % 5 as p, o_orderkey // 5 % 5 as c, o_orderkey % 3 = 0 as support, o_orderkey % 7 = 0 as contra, o_orderkey % 2 = 0 as test from orders),
n as (select *, ['candidate','supported','confirmed','rejected','contradicted'][(p + 1)::int] as prior, ['candidate','supported','confirmed','rejected','contradicted'][(c + 1)::int] as claimed from h),
s as (select *, case when (prior = 'candidate' and claimed in ('candidate','supported','rejected')) or (prior = 'supported' and claimed in ('supported','confirmed','rejected'))
  or (prior = 'confirmed' and claimed in ('confirmed','contradicted')) or (prior = 'rejected' and claimed in ('rejected','candidate')) or (prior = 'contradicted' and claimed in ('contradicted','candidate'))
  then claimed else prior end as s0 from n),
t as (select *, case when prior in ('rejected','contradicted') and s0 = 'candidate' and not support and not contra then prior else s0 end as s1 from s)
select prior, claimed, case when contra and s1 not in ('rejected','contradicted') then case when s1 = 'confirmed' then 'contradicted' else 'rejected' end
  when s1 in ('rejected','contradicted') and not contra and prior not in ('rejected','contradicted') then case when support then 'supported' else 'candidate' end
  when s1 = 'confirmed' and (not test or not support) then case when support then 'supported' else 'candidate' end
  when s1 = 'supported' and not support then 'candidate' else s1 end as status, count(*) as n from t group by all"""

def prompt_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a prompt lacks (five rules) and the confidence of an enhancement."""
    tail = F.element_at(F.array(*map(F.lit, ["", " fix it", " in src/app.py", " it must return x", " tests should pass", " update only main.go"])), (F.col("item_id") % 6 + 1).cast("int"))
    p = read(spark, sf_dir, "benchmark").select("item_id", F.concat("text", tail).alias("p"))
    p = p.withColumn("issues", D.prompt_lacks(F.col("p")))
    conf = D.enhancement_confidence(F.col("issues"), F.col("item_id") % 4)
    return p.select("item_id", F.array_join("issues", ",").alias("issues"), F.round(conf, 6).alias("confidence"))


_Q = lambda s: s.replace("'", "''")
ISSUES = f"""with b as (select item_id, text || ['', ' fix it', ' in src/app.py', ' it must return x', ' tests should pass', ' update only main.go'][(item_id % 6 + 1)::int] as p from benchmark),
w as (select *, len(list_filter(string_split_regex(p, '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) as n, regexp_matches(p, '{_Q(D.FILE_REF)}') as f, regexp_matches(p, '{_Q(D.LIMITS)}') as l, regexp_matches(p, '{_Q(D.CRITERIA)}') as c,
  len(list_filter([{", ".join("'" + v + "'" for v in D.VAGUE)}], lambda v: contains(lower(p), v))) > 0 as v from b),
i as (select item_id, list_filter([case when v and not (f or l or n > 15) then 'lacks_specificity' end, case when not f then 'missing_file_references' end, case when not l then 'missing_constraints' end,
  case when not c then 'missing_acceptance_criteria' end, case when n < 5 then 'too_brief' end], lambda x: x is not null) as issues from w)
select item_id, array_to_string(issues, ',') as issues, round(least(1.0, 0.5 + least(0.3, 0.1 * len(issues)) + least(0.2, 0.07 * (item_id % 4))), 6)::double as confidence from i"""

# Signals of task types (\\b: a word's edge), in the order of ties.
SYMPTOMS = ["error", "fail", "exception", "crash"]
TASKS = {
    "feature": [r"\badd\b", r"\bimplement\b", r"\bcreate\b", r"\bbuild\b", r"\bsupport\b", r"\bnew\b", r"\bfeature\b"],
    "refactor": [r"\brefactor", r"\bclean ?up\b", r"\brestructure\b", r"\brename\b", r"\bextract\b", r"\bsimplif(?:y|ies|ied)\b", r"\breorganiz", r"\bconsolidat", r"\btidy\b"],
    "explanation": [
        r"\bexplain\b", r"\bdescribe\b", r"\bsummar", r"\bwalk me through\b", r"\bwhat (?:does|is|are|happens)\b", r"\bhow (?:does|do|is|can)\b", r"\bwhy (?:does|is|do|are)\b", r"\bunderstand\b",
    ],
    "bugfix": [
        r"\bfix(?:es|ed|ing)?\b", r"\bbugs?\b", r"\btraceback\b", r"\bregression\b", r"\bnot working\b", r"\bdoesn'?t work\b", r"\bthrows?\b",
        *[rf"\b{k}(?:s|es|ed|ing|ure)?\b" for k in SYMPTOMS],
    ],
    "algorithm": [
        r"\boptimiz", r"\bperformance\b", r"\bfaster\b", r"\bspeed ?up\b", r"\befficient\b", r"\bcomplexity\b", r"(?-i:O)\(", r"\balgorithms?\b", r"\bdata structure\b", r"\bmemoiz",
    ],
}
HARD = ["dynamic programming", "dp", "graph", "tree", "bfs", "dfs", "shortest path", "dijkstra", "optimization", "minimize", "maximize", "np-hard", "exponential", "backtrack"]


def task_type(prompt: Column, trace: Column) -> Column:
    """Type with the most distinct signals; ties in the order of ``TASKS``; a trace counts twice for bugfix; feature without a signal."""
    text = F.coalesce(prompt, F.lit(""))
    hits = {t: sum((text.rlike(f"(?iU){k}").cast("int") for k in ks), F.lit(0)) + (trace.cast("int") * 2 if t == "bugfix" else 0) for t, ks in TASKS.items()}
    best = F.greatest(*hits.values())
    kind: Column | None = F.when(best == 0, "feature")
    for t, n in hits.items():
        kind = kind.when(n == best, t)
    return kind


def difficulty(prompt: Column) -> Column:
    """By the bound of n, then by key words."""
    p = F.lower(F.coalesce(prompt, F.lit("")))
    bound = F.regexp_extract(p, r"n *<= *([0-9]+)", 1).try_cast("long")
    hard = F.exists(F.array(*map(F.lit, HARD)), lambda k: F.contains(p, k))
    return F.when(bound <= 100, "easy").when(bound >= 100000, "hard").when(hard, "hard").when(p.rlike("easy|simple|basic"), "easy").when(p.rlike("hard|complex|difficult"), "hard").otherwise("medium")


_LEADS = ["Explain the bug", "fix a traceback", "add NEW feature", "rename and extract", "faster algorithm n <= 100000", "describe graph n <= 50", "simple note", "plain info(", "Is it O(n)? why do tests crash", "clean up errors"]


def task_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type and difficulty of whole prompts."""
    p = F.concat(F.element_at(F.array(*map(F.lit, _LEADS)), (F.col("item_id") % 10 + 1).cast("int")), F.lit(" "), "text")
    rows = read(spark, sf_dir, "benchmark").select("item_id", p.alias("p"), (F.col("item_id") % 5 == 0).alias("trace"))
    return rows.select("item_id", task_type(F.col("p"), F.col("trace")).alias("task"), difficulty(F.col("p")).alias("difficulty"))


_B, _E = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
_ANY = {
    "feature": ["add{e}", "implement{e}", "create{e}", "build{e}", "support{e}", "new{e}", "feature{e}"],
    "refactor": ["refactor", "clean ?up{e}", "restructure{e}", "rename{e}", "extract{e}", "simplif(y|ies|ied){e}", "reorganiz", "consolidat", "tidy{e}"],
    "explanation": ["explain{e}", "describe{e}", "summar", "walk me through{e}", "what (does|is|are|happens){e}", "how (does|do|is|can){e}", "why (does|is|do|are){e}", "understand{e}"],
    "bugfix": ["fix(es|ed|ing)?{e}", "bugs?{e}", "traceback{e}", "regression{e}", "not working{e}", "doesn''?t work{e}", "throws?{e}", "error(s|es|ed|ing|ure)?{e}", "fail(s|es|ed|ing|ure)?{e}", "exception(s|es|ed|ing|ure)?{e}", "crash(s|es|ed|ing|ure)?{e}"],
    "algorithm": ["optimiz", "performance{e}", "faster{e}", "speed ?up{e}", "efficient{e}", "complexity{e}", "algorithms?{e}", "data structure{e}", "memoiz"],
}


def _task_sql() -> str:
    count = lambda ks: " + ".join(f"regexp_matches(p, '(?i){_B}{k.replace('{e}', _E)}')::int" for k in ks)
    extra = {"bugfix": " + trace::int * 2", "algorithm": " + regexp_matches(p, 'O[(]')::int"}
    scores = ", ".join(f"({count(ks)}{extra.get(t, '')}) as s_{t}" for t, ks in _ANY.items())
    best = "greatest(" + ", ".join(f"s_{t}" for t in _ANY) + ")"
    leads = ", ".join("'" + x + "'" for x in _LEADS)
    return f"""with b as (select item_id, [{leads}][(item_id % 10 + 1)::int] || ' ' || text as p, item_id % 5 = 0 as trace from benchmark),
s as (select *, {scores}, lower(p) as low, try_cast(regexp_extract(lower(p), 'n *<= *([0-9]+)', 1) as bigint) as bound from b)
select item_id, case when {best} = 0 then 'feature' {" ".join(f"when s_{t} = {best} then '{t}'" for t in _ANY)} end as task,
  case when bound <= 100 then 'easy' when bound >= 100000 then 'hard' when regexp_matches(low, 'dynamic programming|dp|graph|tree|bfs|dfs|shortest path|dijkstra|optimization|minimize|maximize|np-hard|exponential|backtrack') then 'hard'
  when regexp_matches(low, 'easy|simple|basic') then 'easy' when regexp_matches(low, 'hard|complex|difficult') then 'hard' else 'medium' end as difficulty from s"""


def pattern_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns by how many query terms they contain, then by effectiveness; and the running mean of their scores."""
    terms = ["the", "thand", "of ", "ing"]
    rows = read(spark, sf_dir, "conversations").where("role = 'user'")
    hits = sum((F.contains(F.lower("text"), F.lit(t)).cast("int") for t in terms), F.lit(0))
    per = rows.groupBy("conv_id").agg(F.max(hits).alias("hits"), F.round(F.avg((F.col("turn") % 5 - 2) / 2), 6).alias("effectiveness"), F.count("*").alias("samples"))
    conf = F.least(F.lit(0.95), 0.5 + 0.1 * F.col("samples"))
    scored = per.where("hits > 0").select("conv_id", (F.col("hits") * 10 + F.col("effectiveness")).alias("score"), F.round(conf, 6).alias("confidence"))
    return top_k(scored, "score", 15, "conv_id")


PATTERN_SEARCH = """with p as (select conv_id, max(len(list_filter(['the','thand','of ','ing'], lambda k: contains(lower(text), k)))) as hits, round(avg((turn % 5 - 2) / 2), 6) as effectiveness, count(*) as samples
  from conversations where role = 'user' group by 1), s as (select conv_id, hits * 10 + effectiveness as score, round(least(0.95, 0.5 + 0.1 * samples), 6)::double as confidence from p where hits > 0)
select conv_id, score, confidence, rank from (select *, row_number() over (order by score desc, conv_id) as rank from s) where rank <= 15"""


def prefix_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of three or more with an equal prefix of twenty characters, merged: mean confidence, summed counters, the best row as base."""
    rows = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.substring("text", 1, 20).alias("prefix"), (F.col("doc_id") % 50 / 50).alias("confidence"), (F.col("doc_id") % 13).alias("uses"))
    out = rows.groupBy("prefix").agg(F.count("*").alias("members"), F.round(F.avg("confidence"), 6).alias("confidence"), F.sum("uses").alias("uses"), F.max(F.struct("confidence", -F.col("doc_id"))).alias("best"))
    return out.where("members >= 3").select("prefix", "members", "confidence", "uses", (-F.col("best.col2")).alias("base"))


PREFIX = """with r as (select doc_id, substring(text, 1, 20) as prefix, doc_id % 50 / 50 as confidence, doc_id % 13 as uses from documents where text is not null)
select prefix, count(*) as members, round(avg(confidence), 6) as confidence, sum(uses)::bigint as uses, arg_max(doc_id, (confidence, -doc_id)) as base from r group by 1 having count(*) >= 3"""

QUERIES = {
    "legacy_retrieval": (legacy_retrieval, LEGACY),
    "legacy_keyword_retrieval": (legacy_keyword_retrieval, LEGACY_KEYWORD),
    "loop_decision": (loop_decision, LOOP),
    "hypothesis_states": (hypothesis_states, HYPOTHESES),
    "prompt_issues": (prompt_issues, ISSUES),
    "task_classes": (task_classes, _task_sql()),
    "pattern_search": (pattern_search, PATTERN_SEARCH),
    "prefix_consolidation": (prefix_consolidation, PREFIX),
}
