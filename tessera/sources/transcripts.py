"""Lenient readers of JSON-lines logs: a bad line costs itself only; a message's content may be a string or an array of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "type string, uuid string, sessionId string, timestamp string, isSidechain boolean, message struct<role:string,content:string>"
PARTS = "array<struct<type:string,text:string,name:string,is_error:boolean,content:string>>"


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(session, uuid, type, at, human, text, tools, errors) of every usable line of a transcript folder.

    Dropped: lines that are no JSON, side chains, rows without session or uuid, types other than user and assistant.
    A user row is human if it has text that starts neither with ``<`` nor with ``[Request interrupted``.
    """
    lines = spark.read.text(path).where(F.contains("value", F.lit('"sessionId"')))
    rows = lines.select(F.from_json("value", SCHEMA).alias("r")).select("r.*")
    usable = F.col("sessionId").isNotNull() & F.col("uuid").isNotNull() & ~F.coalesce("isSidechain", F.lit(False)) & F.col("type").isin("user", "assistant")
    content = F.col("message.content")
    parts = F.when(F.ltrim(content).startswith("["), F.from_json(content, PARTS))
    rows = rows.where(usable).withColumn("parts", parts)
    texts = F.array_join(F.transform(F.filter("parts", lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")
    text = F.when(F.col("parts").isNotNull(), texts).otherwise(F.coalesce(content, F.lit("")))
    tools = F.transform(F.filter("parts", lambda p: p["type"] == "tool_use"), lambda p: p["name"])
    errors = F.transform(F.filter("parts", lambda p: (p["type"] == "tool_result") & p["is_error"]), lambda p: p["content"])
    start = F.ltrim(F.col("text"))
    human = (F.col("type") == "user") & (start != "") & ~start.startswith("<") & ~start.startswith("[Request interrupted")
    out = rows.select("sessionId", "uuid", "type", "timestamp", text.alias("text"), F.coalesce(F.size(tools), F.lit(0)).alias("tools"), F.coalesce(F.size(errors), F.lit(0)).alias("errors"))
    return out.withColumn("human", human).withColumnsRenamed({"sessionId": "session", "timestamp": "at"})


def scan_history(spark: SparkSession, path: str, since_line: int, schema: str) -> DataFrame:
    """Rows of a one-file JSON-lines history after line ``since_line`` (lines count from 1 and carry their number in ``line``)."""
    rows = spark.read.text(path).select(F.from_json("value", schema).alias("r")).where("r is not null").select("r.*")
    return rows.where(F.col("line") > since_line)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, value) of every line of a folder of text files; ``at`` rises within a file, also where it is read in several splits."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n")).alias("at"), "value")


_RECORD = "type string, timestamp string, payload struct<id:string,cwd:string,type:string,message:string,name:string,exit_code:int,stderr:string,success:boolean,output:string>"


def rollout_episodes(lines: DataFrame, wrapper: str = "The following is the Codex agent history") -> DataFrame:
    """(session, episode, at, ask, answers, tools, errors) from rollout records (file, at, value), one JSON object a line.

    A human message begins an episode (not an empty one, nor what starts with ``<``, ``[Request interrupted`` or the review wrapper); agent messages, tool
    calls and failures that follow belong to it, and what comes before the first is left out. Failures are commands that end with
    another code than 0, patches that fail, and outputs that name such a code or a time-out. Lines that are no JSON cost themselves only.
    """
    from pyspark.sql import Window

    r = lines.select("file", "at", F.from_json("value", _RECORD).alias("r")).where("r.payload is not null").select("file", "at", "r.type", "r.timestamp", "r.payload")
    p = lambda c: F.col(f"payload.{c}")
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    message = clean(p("message"))
    event, item = F.col("type") == "event_msg", F.col("type") == "response_item"
    human = event & (p("type") == "user_message") & (message != "") & ~message.startswith("<") & ~message.startswith("[Request interrupted") & ~message.startswith(wrapper)
    brief = lambda c, other: F.coalesce(F.nullif(F.substring(clean(c), 1, 300), F.lit("")), other)
    code = F.regexp_extract(p("output"), r"exited with code (\d+)", 1)
    failed = ((code != "") & (code != "0")) | F.contains(F.lower(p("output")), F.lit("timed out"))
    error = (
        F.when(event & (p("type") == "exec_command_end") & (p("exit_code") != 0), brief(p("stderr"), F.concat(F.lit("exit "), p("exit_code").cast("string"))))
        .when(event & (p("type") == "patch_apply_end") & ~p("success"), brief(p("stderr"), F.lit("patch apply failed")))
        .when(item & (p("type") == "function_call_output") & failed, F.substring(clean(p("output")), 1, 300))
    )
    w = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = r.select(
        "file", "at", "timestamp", F.sum(F.coalesce(human, F.lit(False)).cast("long")).over(w).alias("episode"), F.last(F.when(F.col("type") == "session_meta", p("id")), ignorenulls=True).over(w).alias("id"),
        F.when(human, message).alias("ask"), F.when(event & (p("type") == "agent_message") & (message != ""), message).alias("answer"), F.when(item & (p("type") == "function_call"), F.nullif(p("name"), F.lit(""))).alias("tool"), error.alias("error"),
    ).where("episode > 0")
    listed = lambda c: F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("at", F.col(c).alias("x"))))), lambda s: s["x"])
    out = rows.groupBy("file", "episode").agg(
        F.min_by(F.struct("id", "timestamp", "ask"), F.when(F.col("ask").isNotNull(), F.col("at"))).alias("first"), listed("answer").alias("answers"), listed("tool").alias("tools"), listed("error").alias("errors")
    )
    stem = F.regexp_replace(F.substring_index(F.col("file").cast("string"), "/", -1), r"\.[^.]*$", "")
    return out.select(F.coalesce("first.id", stem).alias("session"), (F.col("episode") - 1).alias("episode"), F.col("first.timestamp").alias("at"), F.col("first.ask").alias("ask"), "answers", "tools", "errors")


def task_sessions(spark: SparkSession, path: str) -> DataFrame:
    """(session, at, ask, answers) of finished task sessions, a JSON file each; the first of every ask, white space and case aside.

    The ask is the first user message, else the task; sessions without one, unfinished ones and files that are no JSON objects are left out.
    """
    schema = "id string, task string, finished boolean, created_at string, messages array<struct<role:string,content:string>>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path).withColumn("file", F.col("_metadata.file_path")).where("finished")
    of = lambda role: F.transform(F.filter("messages", lambda m: (m["role"] == role) & m["content"].isNotNull()), lambda m: m["content"])
    asked = F.coalesce(F.try_element_at(of("user"), F.lit(1)), F.col("task"), F.lit(""))
    stem = F.regexp_replace(F.substring_index("file", "/", -1), r"\.[^.]*$", "")
    rows = rows.select("file", F.coalesce("id", stem).alias("session"), F.col("created_at").alias("at"), F.regexp_replace(asked, r"(?U)^\s+|\s+$", "").alias("ask"), F.coalesce(of("assistant"), F.array().cast("array<string>")).alias("answers"))
    first = rows.where("ask <> ''").groupBy(F.lower("ask").alias("sign")).agg(F.min(F.struct("file", "session", "at", "ask", "answers")).alias("f"))
    return first.select("f.session", "f.at", "f.ask", "f.answers")


def owned_by(sessions: DataFrame, roots: DataFrame) -> DataFrame:
    """Sessions (cwd, ...) with the deepest of the project ``roots`` (path) that holds their folder; others are left out. Each session names its own ancestors."""
    parts = F.split(F.regexp_replace("cwd", r"(?<=.)/+$", ""), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    named = sessions.withColumn("_row", F.monotonically_increasing_id()).withColumn("root", F.explode(above))
    held = named.join(roots.select(F.regexp_replace("path", r"(?<=.)/+$", "").alias("root")).distinct(), "root")
    best = held.groupBy("_row", *[F.col(c) for c in sessions.columns]).agg(F.max(F.struct(F.length("root").alias("n"), "root")).alias("b"))
    return best.select(*sessions.columns, F.col("b.root").alias("root"))
