"""Streaming queries over ``events`` as files, and parsing queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators.documents import front_matter, markdown_sections, repair_json, rule_units
from tessera.scratch import kept_path
from tessera.sources.tables import read
from tessera.streaming.admit import admit, windowed_counts
from tessera.streaming.lapse import correlated
from tessera.streaming.retained import retained
from tessera.streaming.rolling import read_rolled, sink
from tessera.streaming.runs import fed


def _as_files(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    events = read(spark, sf_dir, "events")
    path = kept_path(spark, "event-files")
    events.repartition(3, "event_id").write.parquet(path)
    return path, events


def stream_admit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admission of event files in three micro-batches; repeated (user, type, minute) rows are admitted once, as long as any may come."""
    path, events = _as_files(spark, sf_dir)
    at = F.col("ts").cast("timestamp")
    prepare = lambda df: df.select("user_id", "event_type", F.floor(F.unix_seconds(at) / 60).alias("minute"), at.alias("at")).where("event_type <> 'view'")
    rows = admit(spark, path, events.schema, ["user_id", "event_type", "minute"], prepare, "at", "60 days")
    return rows.groupBy("user_id", "event_type").agg(F.count("*").alias("admitted"))


STREAM_ADMIT = """select user_id, event_type, count(*) as admitted from (select distinct user_id, event_type, floor(floor(epoch(ts)) / 60) as minute from events where event_type <> 'view') group by all"""


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, events = _as_files(spark, sf_dir)
    return windowed_counts(spark, path, events.schema, "ts", "60 days", "6 hours", "event_type", "value")


STREAM_WINDOWS = "select (floor(epoch(ts) / 21600) * 21600)::bigint as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2"


def _arrivals(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The clicks in three parts, as they arrived; rows of a part may be up to three days older than those before it."""
    clicks = read(spark, sf_dir, "clicks")
    first, last = F.lit("2024-02-10").cast("timestamp_ntz"), F.lit("2024-03-25").cast("timestamp_ntz")
    at = F.coalesce("arrived_at", last)
    return [clicks.where(at < first), clicks.where((at >= first) & (at < last)), clicks.where(at >= last)]


def stream_lapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every signup with the best later click of its client within two hours, or lapsed; signups whose window was open at the end have no row."""
    rows = [p.select(F.col("click_id").alias("id"), "client_id", "ts", "value", F.coalesce(F.col("kind") == "signup", F.lit(False)).alias("suggested")) for p in _arrivals(spark, sf_dir)]
    return correlated(spark, rows, "client_id", "2 hours", "5 days")


STREAM_LAPSE = """with c as (select distinct click_id, client_id, ts, value, coalesce(kind = 'signup', false) as s from clicks where click_id is not null and client_id is not null and ts is not null),
w as (select least(max(ts) filter (s), max(ts) filter (not s)) - interval 5 day as mark from c),
h as (select a.click_id as suggestion, b.click_id as episode, b.ts, coalesce(round(1 / (1 + abs(b.value - a.value)), 6), 0) as similarity from c a join c b on a.client_id = b.client_id and b.ts >= a.ts and b.ts <= a.ts + interval 2 hour where a.s and not b.s),
r as (select *, row_number() over (partition by suggestion order by similarity desc, ts desc, episode desc) as rn from h)
select suggestion, episode, similarity, 'matched' as state from r where rn = 1
union all select distinct click_id, null, null, 'lapsed' from c, w where s and ts + interval 2 hour < mark and click_id not in (select suggestion from h)"""


def stream_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups as sessions that wait for a purchase of their client: resolved within 14 days, or expired."""
    session = F.when(F.col("kind") == "signup", F.col("click_id"))
    parts = [p.where("kind in ('signup', 'purchase')").select(F.col("client_id").alias("key"), "ts", session.alias("session")) for p in _arrivals(spark, sf_dir)]
    return retained(spark, parts, 14, "5 days")[0]


STREAM_RETAINED = """with c as (select distinct click_id, client_id, ts, kind from clicks where client_id is not null and ts is not null and kind in ('signup', 'purchase')),
w as (select max(ts) - interval 5 day as mark from c),
s as (select a.client_id as key, a.click_id as session, a.ts, count(b.click_id) as n from c a left join c b on a.client_id = b.client_id and b.kind = 'purchase' and b.ts >= a.ts and b.ts <= a.ts + interval 14 day where a.kind = 'signup' group by all)
select key, session, case when n > 0 then 'resolved' else 'expired' end as state from s, w where n > 0 or ts + interval 14 day < mark"""


def stream_rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups and purchases of the arriving clicks, kept by the profile of a sink of rolled JSON files, and read back from them."""
    place = kept_path(spark, "rolled")
    parts = [p.select(F.col("kind").alias("event"), "click_id", "client_id", "value") for p in _arrivals(spark, sf_dir)]
    fed(spark, parts, "rolled", lambda rows, checkpoint: sink(rows, "rolling", place, checkpoint, max_bytes=1 << 20, profile="minimal", events="signup,purchase"))
    rows = read_rolled(spark, place, "event string, click_id long, client_id long, value double")
    return rows.groupBy("event").agg(F.count("*").alias("n"), F.countDistinct("click_id").alias("clicks"), F.round(F.sum("value"), 2).alias("total"))


STREAM_ROLLED = "select kind as event, count(*) as n, count(distinct click_id) as clicks, round(sum(value), 2) as total from clicks where kind in ('signup', 'purchase') group by 1"


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rule files: front matter, headed sections and bullets made from their lines."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    body = F.array_join(F.transform(lines, lambda x, i: F.when(i % 4 == 0, F.concat(F.lit("## "), x)).when(i % 4 == 1, F.concat(F.lit("- "), x)).otherwise(F.concat(F.lit("  "), x))), "\n")
    head = F.concat(F.lit("---\nname: doc"), F.col("doc_id").cast("string"), F.lit("\ntype: "), "lang", F.lit("\n---\n"))
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(head, body).alias("text"))


_MD = """m as (select doc_id, '---' || chr(10) || 'name: doc' || doc_id || chr(10) || 'type: ' || lang || chr(10) || '---' || chr(10) || array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''),
  lambda x, i: case (i - 1) % 4 when 0 then '## ' || x when 1 then '- ' || x else '  ' || x end), chr(10)) as text from documents),
l as (select doc_id, unnest(range(len(string_split(text, chr(10)))))::int as line_no, unnest(string_split(text, chr(10))) as line from m)"""


def markdown_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of markdown files with size and hash."""
    return markdown_sections(_markdown(spark, sf_dir), "doc_id").select("doc_id", "section", "title", F.sha2("body", 256).alias("body_sha256"))


MARKDOWN = f"""with {_MD}, s as (select *, sum(starts_with(line, '## ')::int) over (partition by doc_id order by line_no) as section from l)
select doc_id, section, trim(substring(max(line) filter (starts_with(line, '## ')), 4)) as title,
  sha256(coalesce(string_agg(line, chr(10) order by line_no) filter (not starts_with(line, '## ')), '')) as body_sha256 from s where section > 0 group by doc_id, section"""


def rule_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule units: each bullet with its indented continuation lines."""
    return rule_units(_markdown(spark, sf_dir), "doc_id").select("doc_id", "unit", F.sha2("rule", 256).alias("rule_sha256"))


BULLETS = f"""with {_MD}, s as (select *, sum((starts_with(line, '- ') or starts_with(line, '#'))::int) over (partition by doc_id order by line_no) as unit from l),
g as (select doc_id, unit, string_agg(trim(case when starts_with(line, '- ') then substring(line, 3) else line end), ' ' order by line_no) as rule, bool_or(starts_with(line, '- ')) as bullet
  from s where unit > 0 group by doc_id, unit) select doc_id, unit, sha256(rule) as rule_sha256 from g where bullet"""


def memory_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return front_matter(_markdown(spark, sf_dir), "doc_id")


FRONT = "select doc_id, 'doc' || doc_id as name, lang as type, false as malformed from documents"


def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first object of a noisy string, trailing commas repaired, validated with error codes."""
    raw = F.concat(F.lit("note: "), F.when(F.col("event_id") % 5 == 0, F.lit("nothing")).otherwise(F.regexp_replace("props", r"\}$", F.when(F.col("event_id") % 3 == 0, ",}").otherwise("}"))), F.lit(" tail"))
    rows = read(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return repair_json(rows, "raw", "k int").select("event_id", F.col("value.k").alias("k"), "error_code")


JSON = """select event_id, case when event_id % 5 <> 0 then (props->>'$.k')::int end as k, case when event_id % 5 = 0 then 'no_object' else 'ok' end as error_code from events"""

QUERIES = {
    "stream_admit": (stream_admit, STREAM_ADMIT),
    "stream_windows": (stream_windows, STREAM_WINDOWS),
    "stream_lapse": (stream_lapse, STREAM_LAPSE),
    "stream_retained": (stream_retained, STREAM_RETAINED),
    "stream_rolled": (stream_rolled, STREAM_ROLLED),
    "markdown_rules": (markdown_rules, MARKDOWN),
    "rule_bullets": (rule_bullets, BULLETS),
    "memory_front_matter": (memory_front_matter, FRONT),
    "json_repair": (json_repair, JSON),
}
