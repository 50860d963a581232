"""Reader and record queries: transcripts, histories, sessions, commits, outcomes, hashed embeddings, provenance, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.functions import decisions as D
from tessera.functions.text import EDGE_L, EDGE_R
from tessera.scratch import kept_path
from tessera.sources.tables import read
from tessera.sources.transcripts import read_transcripts, scan_history


def transcript_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as JSON lines (string and array contents, side chains, broken lines) and read back."""
    c = read(spark, sf_dir, "conversations")
    k = F.col("conv_id") + F.col("turn")
    part = lambda kind, **f: F.struct(F.lit(kind).alias("type"), *[v.alias(n) for n, v in f.items()])
    array = F.concat(F.lit("["), F.to_json(part("text", text=F.col("text"))), F.lit(","), F.to_json(part("tool_use", name=F.lit("run"))), F.lit(","), F.to_json(part("tool_result", is_error=k % 4 == 0, content=F.lit("x"))), F.lit("]"))
    content = F.when(k % 2 == 0, array).otherwise(F.col("text"))
    uuid = F.concat("conv_id", F.lit("-"), "turn")
    row = F.struct(F.col("role").alias("type"), uuid.alias("uuid"), F.col("conv_id").cast("string").alias("sessionId"), (k % 7 == 0).alias("isSidechain"), F.struct(F.col("role").alias("role"), content.alias("content")).alias("message"))
    line = F.when(k % 11 == 0, F.substring(F.to_json(row), 1, 60)).otherwise(F.to_json(row))
    path = kept_path(spark, "transcripts")
    c.select(line.alias("value")).write.text(path)
    out = read_transcripts(spark, path)
    return out.select("session", "uuid", "type", "human", "tools", "errors", F.sha2("text", 256).alias("text_sha256"))


TRANSCRIPTS = """select conv_id::varchar as session, conv_id || '-' || turn as uuid, role as type, role = 'user' and ltrim(text) <> '' and not starts_with(ltrim(text), '<') as human,
  (case when (conv_id + turn) % 2 = 0 then 1 else 0 end)::int as tools, (case when (conv_id + turn) % 2 = 0 and (conv_id + turn) % 4 = 0 then 1 else 0 end)::int as errors, sha256(text) as text_sha256
  from conversations where role in ('user','assistant') and (conv_id + turn) % 7 <> 0 and (conv_id + turn) % 11 <> 0"""


def history_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history file after a line watermark, and the new watermark."""
    e = read(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("line"), "user_id", "event_type")
    path = kept_path(spark, "history")
    e.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    rows = scan_history(spark, path, 400, "line long, user_id long, event_type string")
    return rows.groupBy("event_type").agg(F.count("*").alias("rows_after"), F.max("line").alias("watermark"))


HISTORY = "select event_type, count(*) as rows_after, max(event_id + 1) as watermark from events where event_id + 1 > 400 group by 1"

SUCCESS, FAILURE = ["successfully", "completed", "done", "finished", "created", "implemented", "fixed"], ["error", "failed", "cannot", "unable", "blocked"]


def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, tool share and outcome of each conversation; the outcome weighs words of its last five messages."""
    words = ["", " done", " error", " fixed and created", " cannot", " failed"]
    c = read(spark, sf_dir, "conversations").withColumn("said", F.concat("text", F.element_at(F.array(*map(F.lit, words)), (F.col("turn") % 6 + 1).cast("int"))))
    c = c.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc())))
    count = lambda ws: sum((F.contains("last", F.lit(w)).cast("int") for w in ws), F.lit(0))
    last = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("back") <= 5, F.struct("turn", F.lower("said").alias("t"))))), lambda s: s["t"]), " ")
    g = c.groupBy("conv_id").agg(F.min("turn").alias("first"), F.max("turn").alias("final"), F.count("*").alias("messages"), F.count(F.when(F.col("role") == "assistant", 1)).alias("replies"), last.alias("last"))
    good, bad = count(SUCCESS), count(FAILURE)
    return g.select("conv_id", "first", "final", "messages", "replies", F.when(good > bad, "success").when(bad > good, "failure").alias("outcome"))


_IN = lambda ws: "len(list_filter([" + ", ".join(f"'{w}'" for w in ws) + "], lambda w: contains(last, w)))"
SUMMARY = f"""with c as (select *, lower(text || ['',' done',' error',' fixed and created',' cannot',' failed'][(turn % 6 + 1)::int]) as said, row_number() over (partition by conv_id order by turn desc) as back from conversations),
g as (select conv_id, min(turn) as first, max(turn) as final, count(*) as messages, count(*) filter (role = 'assistant') as replies, string_agg(said, ' ' order by turn) filter (back <= 5) as last from c group by 1)
select conv_id, first, final, messages, replies, case when {_IN(SUCCESS)} > {_IN(FAILURE)} then 'success' when {_IN(FAILURE)} > {_IN(SUCCESS)} then 'failure' end as outcome from g"""

NOISE = ["merge ", "merge pull request", "merge branch", "bump version", "release v", "update changelog", "chore(deps)", "chore(release)", "initial commit"]


def commit_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits after a watermark without noise, newest fifty."""
    heads = ["Merge branch x ", "fix: ", "Bump version ", "feat: ", "chore(deps) ", "x", "refactor "]
    c = read(spark, sf_dir, "pages").select("page_id", F.concat(F.element_at(F.array(*map(F.lit, heads)), (F.col("page_id") % 7 + 1).cast("int")), F.when(F.col("page_id") % 7 == 5, "").otherwise(F.substring("url", 9, 30))).alias("message"))
    m = F.trim(F.lower("message"))
    noise = F.exists(F.array(*map(F.lit, NOISE)), lambda p: F.startswith(m, p))
    return c.where((F.col("page_id") > 10) & ~noise & (F.length(m) >= 10)).orderBy(F.col("page_id").desc()).limit(50)


COMMITS = f"""with c as (select page_id, ['Merge branch x ','fix: ','Bump version ','feat: ','chore(deps) ','x','refactor '][(page_id % 7 + 1)::int] || case when page_id % 7 = 5 then '' else substring(url, 9, 30) end as message from pages)
select page_id, message from c where page_id > 10 and len(list_filter([{", ".join("'" + n + "'" for n in NOISE)}], lambda p: starts_with(trim(lower(message)), p))) = 0 and length(trim(lower(message))) >= 10 order by page_id desc limit 50"""


def outcome_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome buckets of run logs (syntax, wrong result, speed) in the documented order, with the run's confidence."""
    logs = ["ok", "SyntaxError: x", "expected 3 got 4", "test failed", "all good"]
    e = read(spark, sf_dir, "events").select("event_id", "user_id", F.element_at(F.array(*map(F.lit, logs)), (F.col("event_id") % 5 + 1).cast("int")).alias("log"), F.when(F.col("event_id") % 3 != 0, F.col("value") / 10).alias("speed"))
    kind = D.outcome_class(F.col("log"), F.col("speed"))
    g = e.withColumn("kind", kind).groupBy("user_id").agg(
        F.count(F.when(F.col("kind") == "speed_up", 1)).alias("fast"), F.count(F.when(F.col("kind") == "slow_down", 1)).alias("slow"), F.count(F.when(F.col("kind") == "syntax_error", 1)).alias("broken"),
        F.count(F.when(F.col("kind") == "functional_incorrectness", 1)).alias("wrong"), F.avg(F.when(F.col("speed").isNotNull(), 0.5 + F.col("event_id") % 5 / 10)).alias("mean"),
    )
    conf = D.run_confidence(F.col("mean"), F.col("wrong"), F.col("broken"))
    basis = F.when(F.col("mean").isNull(), "no_verifiable_change").otherwise("suggestions")
    return g.select("user_id", "fast", "slow", "broken", "wrong", F.round(conf, 6).alias("confidence"), basis.alias("basis"))


_Q = lambda s: s.replace("'", "''")
OUTCOME_CLASSES = f"""with e as (select event_id, user_id, ['ok','SyntaxError: x','expected 3 got 4','test failed','all good'][(event_id % 5 + 1)::int] as log, case when event_id % 3 <> 0 then value / 10 end as speed from events),
k as (select *, case when regexp_matches(log, '{_Q(D.SYNTAX)}') then 'syntax_error' when regexp_matches(log, '{_Q(D.WRONG)}') then 'functional_incorrectness' when speed > 1 then 'speed_up' when speed < 1 then 'slow_down' else 'unknown' end as kind from e),
g as (select user_id, count(*) filter (kind = 'speed_up') as fast, count(*) filter (kind = 'slow_down') as slow, count(*) filter (kind = 'syntax_error') as broken, count(*) filter (kind = 'functional_incorrectness') as wrong,
  avg(0.5 + event_id % 5 / 10) filter (speed is not null) as mean from k group by 1)
select user_id, fast, slow, broken, wrong, case when mean is not null then round(greatest(0, least(1, mean - least(0.15, 0.02 * wrong) - least(0.1, 0.01 * broken))), 6)::double end as confidence,
  case when mean is null then 'no_verifiable_change' else 'suggestions' end as basis from g"""


def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic 128-dimensional embeddings: each token's sha-256 picks an index and a sign; unit length. One row per non-zero."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    t = read(spark, sf_dir, "benchmark").select("item_id", F.explode(words).alias("token")).withColumn("h", F.sha2("token", 256))
    number = lambda at, n: F.conv(F.substring("h", at, n), 16, 10).cast("int")
    g = t.groupBy("item_id", (number(1, 4) % 128).alias("dim")).agg(F.sum(F.when(number(5, 2) % 2 == 0, 1.0).otherwise(-1.0)).alias("x")).where("x <> 0")
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("item_id")))
    return g.select("item_id", "dim", F.round(F.col("x") / norm, 6).alias("x"))


HASH_EMBED = """with t as (select item_id, sha256(unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) as h from benchmark),
g as (select item_id, (('0x' || substring(h, 1, 4))::int % 128)::int as dim, sum(case when ('0x' || substring(h, 5, 2))::int % 2 = 0 then 1.0 else -1.0 end)::double as x from t group by all)
select item_id, dim, round(x / sqrt(sum(x * x) over (partition by item_id)), 6) as x from g where x <> 0"""


def fact_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with their supporting episodes (missing ones kept and marked) and how many depend on them."""
    c = read(spark, sf_dir, "customer")
    ids = F.array(F.col("c_custkey") * 3, F.col("c_custkey") * 1000)
    support = c.select("c_custkey", F.explode(ids).alias("episode"))
    episodes = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("episode"), "o_orderstatus")
    found = support.join(episodes, "episode", "left").groupBy("c_custkey").agg(F.count("o_orderstatus").alias("found"), F.count(F.when(F.col("o_orderstatus").isNull(), 1)).alias("missing"))
    gone = c.where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("dep"))
    depends = c.select("c_custkey", F.explode(F.array(F.floor(F.col("c_custkey") / 2), F.col("c_custkey") - 1)).alias("dep"))
    review = depends.join(gone, "dep", "left_semi").select("c_custkey").distinct().withColumn("needs_review", F.lit(True))
    return found.join(review, "c_custkey", "left").select("c_custkey", "found", "missing", F.coalesce("needs_review", F.lit(False)).alias("needs_review"))


PROVENANCE = """with s as (select c_custkey, unnest([c_custkey * 3, c_custkey * 1000]) as episode from customer),
f as (select c_custkey, count(o_orderstatus) as found, count(*) filter (o_orderstatus is null) as missing from s left join orders on o_orderkey = episode group by 1)
select c_custkey, found, missing, (c_custkey // 2 in (select c_custkey from customer where c_custkey % 10 = 0)) or (c_custkey - 1 in (select c_custkey from customer where c_custkey % 10 = 0)) as needs_review from f"""

QUERIES = {
    "transcript_reader": (transcript_reader, TRANSCRIPTS),
    "history_scan": (history_scan, HISTORY),
    "session_summary": (session_summary, SUMMARY),
    "commit_ingest": (commit_ingest, COMMITS),
    "outcome_classes": (outcome_classes, OUTCOME_CLASSES),
    "hash_embedding": (hash_embedding, HASH_EMBED),
    "fact_provenance": (fact_provenance, PROVENANCE),
}
