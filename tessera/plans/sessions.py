"""Conversation queries: sessions, prompt signals, iterations, patterns, templates and issues, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.functions import prompts as P
from tessera.sources.tables import read


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with phrases added by rule, so that the English signals occur in invented text."""
    k = (F.col("conv_id") * 7 + F.col("turn") * 3) % 11
    tail = F.when(k == 0, " Done.").when(k == 1, " Could you clarify").when(k == 2, " TypeError: bad value 42").when(k == 3, " 12 passed").when(k == 4, " git commit").otherwise("")
    user = F.when(k == 1, "actually, ").when(k == 2, "Fix src/app.py ").when(k == 3, "how does UserService work ").when(k == 4, "<note> ").otherwise("")
    text = F.when(F.col("role") == "user", F.concat(user, F.coalesce("text", F.lit("")))).otherwise(F.concat(F.coalesce("text", F.lit("")), tail))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.alias("text"))


_TURNS = """t as (select conv_id, turn, role, case when role = 'user'
  then case (conv_id * 7 + turn * 3) % 11 when 1 then 'actually, ' when 2 then 'Fix src/app.py ' when 3 then 'how does UserService work ' when 4 then '<note> ' else '' end || coalesce(text, '')
  else coalesce(text, '') || case (conv_id * 7 + turn * 3) % 11 when 0 then ' Done.' when 1 then ' Could you clarify' when 2 then ' TypeError: bad value 42' when 3 then ' 12 passed' when 4 then ' git commit' else '' end end as text
  from conversations)"""


def sessionize_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new episode at each human message; what follows folds into it. Rows before the first human message belong to none."""
    t = _turns(spark, sf_dir)
    human = (F.col("role") == "user") & ~F.ltrim("text").startswith("<") & ~F.ltrim("text").startswith("[Request interrupted")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    e = t.withColumn("human", human).withColumn("episode", F.sum(F.col("human").cast("int")).over(w)).where("episode > 0")
    said = (F.col("role") == "assistant") & (F.col("text") != "")
    out = e.groupBy("conv_id", "episode").agg(
        F.min("turn").alias("anchor"), F.max("turn").alias("last"), F.min_by("text", "turn").alias("ask"), F.count(F.when(said, 1)).alias("replies"),
        F.sum(F.when(said, F.length("text")).otherwise(0)).alias("reply_chars"),
    )
    return out.withColumn("substantive", (F.trim("ask") != "") & (F.col("replies") > 0))


SESSIONIZE = f"""with {_TURNS},
e as (select *, sum((role = 'user' and not starts_with(ltrim(text), '<') and not starts_with(ltrim(text), '[Request interrupted'))::int) over (partition by conv_id order by turn) as episode from t)
select conv_id, episode, min(turn) as anchor, max(turn) as last, arg_min(text, turn) as ask, count(*) filter (role = 'assistant' and text <> '') as replies,
  sum(case when role = 'assistant' and text <> '' then length(text) else 0 end) as reply_chars,
  trim(arg_min(text, turn)) <> '' and count(*) filter (role = 'assistant' and text <> '') > 0 as substantive from e where episode > 0 group by conv_id, episode"""


def prompt_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten signals and the clamped score of every user prompt."""
    return P.signals(_turns(spark, sf_dir)).select("conv_id", "turn", *P.FLAGS, "iterations", F.round("score", 6).alias("score"))


_SQ = lambda p: p.replace("'", "''")
_RX = lambda name, text: f"regexp_matches({text}, '{_SQ(P.PATTERNS[name])}')"
_LIST = lambda xs: "[" + ", ".join("'" + _SQ(x) + "'" for x in xs) + "]"
_WORDS = lambda t: f"list_distinct(list_filter(string_split_regex(lower({t}), '[ \\t\\n\\r\\f]+'), lambda x: x <> ''))"
_SIGNALS = f"""{_TURNS},
a as (select *, row_number() over w as idx, lead(role) over w as next_role, lead(text) over w as next_text,
  sum((role = 'user')::int) over (partition by conv_id order by turn) as segment from t window w as (partition by conv_id order by turn)),
r as (select a.conv_id, a.segment, min(case when b.role = 'assistant' then b.idx end) as ra, bool_or(b.idx - a.idx <= 9 and b.role <> 'user' and {_RX("commit", "b.text")}) as committed,
  bool_or(b.idx - a.idx <= 9 and b.role <> 'user' and {_RX("tests", "b.text")}) as tested
  from a join a b on a.conv_id = b.conv_id and a.segment = b.segment and b.idx > a.idx where a.role = 'user' group by all),
u as (select a.*, coalesce(r.committed, false) as commit_made, coalesce(r.tested, false) as tests_passed,
  coalesce((select min_by(x.text, x.idx) from a x where x.conv_id = a.conv_id and x.role = 'assistant' and x.idx > a.idx), '') as response,
  lead(a.text) over (partition by a.conv_id order by a.turn) as next_user, row_number() over (partition by a.conv_id order by a.turn) as pos, count(*) over (partition by a.conv_id) as users,
  a.next_role = 'assistant' as paired, coalesce(a.next_role = 'assistant' and {_RX("success", "a.next_text")}, false) as won
  from a left join r on r.conv_id = a.conv_id and r.segment = a.segment where a.role = 'user'),
s as (select *, min(case when won or not coalesce(paired, false) then pos * 2 + won::int end) over (partition by conv_id order by turn rows between current row and unbounded following) as stop from u),
i as (select *, greatest(1, case when stop is null then users - pos + 1 else stop // 2 - pos + stop % 2 end) as iterations from s),
w as (select *, coalesce(next_user, '') as nu, {_WORDS("text")} as ow, {_WORDS("coalesce(next_user, '')")} as nw, list_filter(string_split_regex(trim(coalesce(next_user, '')), '[ \\t\\n\\r\\f]+'), lambda x: x <> '') as nl from i),
c as (select *, {_RX("confusion", "response")} as claude_confused, {_RX("error", "response")} as error_in_response, {_RX("success", "response")} as task_completed,
  nu <> '' and text <> '' and (len(list_filter({_LIST(P.INDICATORS)}, lambda k: contains(lower(nu), k))) > 0
    or (len(nl) <= 5 and not list_contains({_LIST(P.FEEDBACK)}, rtrim(trim(lower(nu)), '!.,')) and not list_contains({_LIST(P.STARTERS)}, rtrim(lower(coalesce(nl[1], '')), '!.,'))
      and (list_contains({_LIST(P.CORRECTIONS)}, rtrim(lower(coalesce(nl[1], '')), ',')) or (len(list_intersect(ow, nw)) >= 1 and len(nl) <= 3)))) as immediate_clarification,
  list_filter(ow, lambda x: not list_contains({_LIST(P.STOP_WORDS)}, x)) as o2, list_filter(nw, lambda x: not list_contains({_LIST(P.STOP_WORDS)}, x)) as n2 from w),
d as (select *, coalesce(iterations = 1 and task_completed, false) as single_iteration, iterations > 2 as multiple_retries,
  coalesce(nu <> '' and text <> '' and len(o2) > 0 and len(n2) > 0 and len(list_intersect(o2, n2)) / greatest(len(o2), len(n2)) < 0.2, false) as changed from c),
f as (select *, changed and task_completed as topic_changed, changed and not (task_completed or commit_made or tests_passed) as abandoned_task from d)
select conv_id, turn, claude_confused, error_in_response, task_completed, immediate_clarification, commit_made, tests_passed, single_iteration, multiple_retries, topic_changed, abandoned_task, iterations,
  round(greatest(-1, least(1, 0.4 * task_completed::int + 0.2 * single_iteration::int + 0.2 * commit_made::int + 0.2 * tests_passed::int + 0.1 * topic_changed::int - 0.3 * claude_confused::int
   - 0.2 * immediate_clarification::int - 0.3 * multiple_retries::int - 0.2 * error_in_response::int - 0.4 * abandoned_task::int)), 6)::double as score from f"""
PROMPT_SIGNALS = "with " + _SIGNALS


def structural_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts by structural key, with the shortest as template and use cases; keys of two prompts or more."""
    t = _turns(spark, sf_dir).where("role = 'user'")
    keyed = t.select("conv_id", "turn", "text", P.structural_key(F.col("text")).alias("key"))
    base = F.min_by("text", F.struct(F.length("text"), "conv_id", "turn"))
    cases = [F.bool_or(F.contains(F.lower("text"), F.lit(w))) for w in P.USE_CASES]
    found = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(c, F.lit(v)) for c, v in zip(cases, P.USE_CASES.values(), strict=True)]), lambda x: x.isNotNull())))
    out = keyed.groupBy("key").agg(F.count("*").alias("n"), P.template(base).alias("template"), F.array_join(found, ",").alias("use_cases"))
    return out.where("n >= 2")


STRUCTURAL = f"""with {_TURNS},
u as (select *, lower(text) as l, list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f]+'), lambda x: x <> '') as w from t where role = 'user'),
k as (select *, case when len(w) = 0 then 'empty' else (case when list_contains(['add','create','fix','update','modify','implement','remove','delete'], trim(w[1], '.,!?')) then 'action:' || trim(w[1], '.,!?')
   when list_contains(['how','what','why','where','when','can','could','would'], trim(w[1], '.,!?')) then 'question' else 'other' end)
   || (case when regexp_matches(l, '[.][a-z]{{2,4}}($|[^\\p{{L}}\\p{{N}}_])|/[a-z_]+|src/|test') then '_with_file' else '' end)
   || (case when len(w) < 10 then '_short' when len(w) < 30 then '_medium' else '_long' end) end as key from u),
g as (select key, count(*) as n, arg_min(text, (length(text), conv_id, turn)) as base, {", ".join(f"bool_or(contains(l, '{w}')) as c{i}" for i, w in enumerate(P.USE_CASES))} from k group by key)
select key, n, regexp_replace(regexp_replace(base, '(^|[^\\p{{L}}\\p{{N}}_])[a-z_]+[.](py|js|ts|go|rs|java)($|[^\\p{{L}}\\p{{N}}_])', '\\1{{file}}\\3', 'g'),
  '(^|[^\\p{{L}}\\p{{N}}_])[A-Z][a-zA-Z]+(Service|Controller|Handler|Manager)($|[^\\p{{L}}\\p{{N}}_])', '\\1{{component}}\\3', 'g') as template,
  array_to_string(list_sort(list_distinct(list_filter([{", ".join(f"case when c{i} then '{v}' end" for i, v in enumerate(P.USE_CASES.values()))}], lambda x: x is not null))), ',') as use_cases from g where n >= 2"""


def issue_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recurring friction: error classes and clarifications over sessions, with category, evidence and confidence."""
    t = _turns(spark, sf_dir).where("role = 'assistant'")
    error = P.error_class(F.col("text"))
    asked = F.col("text").rlike(P.PATTERNS["clarification"])
    rows = t.select("conv_id", "turn", error.alias("error_class"), asked.alias("clarified"), F.substring("text", 1, 60).alias("span"))
    topic = F.when(F.col("error_class") != "", F.col("error_class")).when(F.col("clarified"), "clarification")
    g = rows.withColumn("topic", topic).where("topic is not null").groupBy("topic").agg(
        F.count("*").alias("members"), F.countDistinct("conv_id").alias("sessions"), F.max(F.struct("conv_id", "turn", "span")).alias("latest"), F.max(F.col("error_class") != "").alias("tool")
    )
    missing = F.col("topic").rlike("command not found|unknown command|is not recognized")
    category = F.when(F.col("tool") & missing, "missing-tool").when(F.col("tool"), "absent-guardrail").otherwise("vague-rule")
    conf = F.round(0.4 * F.least(F.lit(1.0), F.col("members") / 6) + 0.3 * F.least(F.lit(1.0), F.col("sessions") / 3) + 0.3 * 0.5, 2)
    return g.where("sessions >= 2 and members >= 2").select("topic", category.alias("category"), "members", "sessions", conf.alias("confidence"), F.col("latest.span").alias("evidence"))


ISSUES = f"""with {_TURNS},
l as (select conv_id, turn, substring(text, 1, 60) as span, regexp_matches(text, '{_SQ(P.PATTERNS["clarification"])}') as clarified,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_SQ(P.PATTERNS["error_signal"])}') and not regexp_matches(x, '{_SQ(P.PATTERNS["banner"])}'))[1] as line from t where role = 'assistant'),
e as (select *, coalesce(substring(lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '0x[0-9a-fA-F]+', '', 'g'), '(/[^ \\t:''"]+)+', '', 'g'), '(^|[^\\p{{L}}\\p{{N}}_])[0-9]+($|[^\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g'))), 1, 80), '') as error_class from l),
k as (select *, case when error_class <> '' then error_class when clarified then 'clarification' end as topic from e)
select topic, case when max(error_class) <> '' and regexp_matches(topic, 'command not found|unknown command|is not recognized') then 'missing-tool' when max(error_class) <> '' then 'absent-guardrail' else 'vague-rule' end as category,
  count(*) as members, count(distinct conv_id) as sessions, round(0.4 * least(1, count(*) / 6) + 0.3 * least(1, count(distinct conv_id) / 3) + 0.15, 2)::double as confidence, arg_max(span, (conv_id, turn)) as evidence
from k where topic is not null group by topic having count(distinct conv_id) >= 2 and count(*) >= 2"""

def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as rollout records and back as episodes: answers, tools and errors of each."""
    from tessera.sources.transcripts import rollout_episodes

    t = _turns(spark, sf_dir)
    bad = (F.col("role") == "assistant") & (F.col("turn") % 5 == 0)
    payload = (
        F.when(F.col("role") == "user", F.struct(F.lit("user_message").alias("type"), F.col("text").alias("message"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("output")))
        .when(bad, F.struct(F.lit("function_call_output").alias("type"), F.lit(None).cast("string").alias("message"), F.lit(None).cast("string").alias("name"), F.concat(F.lit("exited with code 1 "), "text").alias("output")))
        .when(F.col("role") == "assistant", F.struct(F.lit("agent_message").alias("type"), F.col("text").alias("message"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("output")))
        .otherwise(F.struct(F.lit("function_call").alias("type"), F.lit(None).cast("string").alias("message"), F.lit("shell").alias("name"), F.lit(None).cast("string").alias("output")))
    )
    kind = F.when(payload["type"].isin("user_message", "agent_message"), "event_msg").otherwise("response_item")
    lines = t.select(F.concat(F.lit("rollout-"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("file"), F.col("turn").alias("at"), F.to_json(F.struct(kind.alias("type"), payload.alias("payload"))).alias("value"))
    broken = lines.select("file", (F.col("at") + 1000).alias("at"), F.lit("{broken").alias("value")).distinct()
    e = rollout_episodes(lines.unionByName(broken))
    return e.select("session", "episode", F.sha2("ask", 256).alias("ask_sha256"), F.size("answers").alias("answers"), F.size("tools").alias("tools"), F.size("errors").alias("errors"))


_HUMAN = r"role = 'user' and trim(text, chr(32) || chr(9) || chr(10) || chr(13)) <> '' and not starts_with(ltrim(text, chr(32) || chr(9) || chr(10) || chr(13)), '<') and not starts_with(ltrim(text, chr(32) || chr(9) || chr(10) || chr(13)), '[Request interrupted')"
ROLLOUTS = f"""with {_TURNS}, e as (select *, ({_HUMAN}) as human, sum(({_HUMAN})::int) over (partition by conv_id order by turn) as episode from t)
select 'rollout-' || conv_id as session, episode - 1 as episode, sha256(trim(min(text) filter (human), chr(32) || chr(9) || chr(10) || chr(13))) as ask_sha256,
  (count(*) filter (role = 'assistant' and turn % 5 <> 0 and trim(text, chr(32) || chr(9) || chr(10) || chr(13)) <> ''))::int as answers, (count(*) filter (role not in ('user', 'assistant')))::int as tools, (count(*) filter (role = 'assistant' and turn % 5 = 0))::int as errors
from e where episode > 0 group by conv_id, episode"""


def stream_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that arrive as files, scored once each; patterns of effective prompts."""
    from tessera.scratch import kept_path
    from tessera.streaming.watch import scan_prompts

    t, path = _turns(spark, sf_dir), kept_path(spark, "conversation-files")
    t.repartition(3, "conv_id").write.parquet(path)
    return scan_prompts(spark, path, t.schema, 0.3, 2).withColumn("effectiveness", F.round("effectiveness", 6))


QUERIES = {
    "rollouts": (rollouts, ROLLOUTS),
    "stream_prompts": (stream_prompts, None),
    "sessionize_conversations": (sessionize_conversations, SESSIONIZE),
    "prompt_signals": (prompt_signals, PROMPT_SIGNALS),
    "structural_patterns": (structural_patterns, STRUCTURAL),
    "issue_mining": (issue_mining, ISSUES),
}
