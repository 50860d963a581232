"""Prompt effectiveness: signals, iterations, structural keys and templates over (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Phrases and weights of the signals.
PATTERNS = {
    "confusion": r"(?i)I'm not sure|I am not sure|Could you clarify|Can you clarify|I need more information|Can you provide more context|I don't understand|I do not understand|What do you mean by|Please specify|Could you be more specific|I'm uncertain|It's unclear|I cannot determine",
    "success": r"(?i)Done\.|I've (completed|finished|implemented|fixed|created|added|updated)|I have (completed|finished|implemented|fixed|created|added|updated)|The (task|change|fix|feature|update|implementation) is complete|Successfully (completed|implemented|fixed|created|added|updated)|Changes have been (made|applied|committed)|All (tests|checks) pass|Here's the (completed|updated|fixed)",
    "error": r"(?i)Error:|Exception:|Traceback|failed with|cannot (find|locate|access)|does not exist|permission denied|syntax error|undefined|not found",
    "commit": r"(?i)git commit|committed|Created commit|\[.+\]\s+\w+",
    "tests": r"(?i)tests? passed|all tests|pytest.*passed|OK \([0-9]+ tests?\)|[0-9]+ passed|PASSED",
    "clarification": r"(?i)could you clarify|can you clarify|i'm not sure|i am not sure|i need more information|can you provide more context|what do you mean by|please specify|could you be more specific|it's unclear|i cannot determine",
    "error_signal": r"(?i)(^|[ >|\]])(error|errno|fatal|panic|exception|traceback)[ \t]*[:(]|[A-Za-z0-9_]*(error|exception)[ \t]*:|command not found|no such file|permission denied|failed to|unable to|could not",
    "banner": r"(?i)^[ \t]*(process )?exit(ed with)? code [0-9]+|^[ \t]*command (timed out|failed)$|^[ \t]*\[request interrupted",
}
INDICATORS = ["i mean", "what i meant", "to clarify", "let me clarify", "sorry, i meant", "no, i want", "not that", "actually,", "specifically", "in other words", "wait,", "no,", "nope,"]
FEEDBACK = ["thanks", "thank you", "perfect", "great", "good", "ok", "okay", "awesome", "nice", "yes", "yep", "done", "lgtm", "ship it", "looks good", "sounds good"]
STARTERS = ["thanks", "thank", "perfect", "great", "good", "ok", "okay", "awesome", "nice", "yes", "yep", "done", "lgtm"]
CORRECTIONS = ["no", "nope", "wait", "actually"]
STOP_WORDS = ["the", "a", "an", "is", "are", "to", "in", "for", "on", "it", "and", "or"]
ACTIONS = ["add", "create", "fix", "update", "modify", "implement", "remove", "delete"]
QUESTIONS = ["how", "what", "why", "where", "when", "can", "could", "would"]
USE_CASES = {
    "fix": "bugfix", "bug": "bugfix", "error": "bugfix", "add": "feature", "create": "feature", "implement": "feature", "new": "feature", "update": "enhancement",
    "modify": "enhancement", "refactor": "refactoring", "test": "testing", "doc": "documentation", "readme": "documentation",
}
WEIGHTS = {
    "task_completed": 0.4, "single_iteration": 0.2, "commit_made": 0.2, "tests_passed": 0.2, "topic_changed": 0.1, "claude_confused": -0.3,
    "immediate_clarification": -0.2, "multiple_retries": -0.3, "error_in_response": -0.2, "abandoned_task": -0.4,
}
FLAGS = list(WEIGHTS)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[ \t\n\r\f]+"), lambda w: w != "")


def _literals(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def is_clarification(following: Column, prompt: Column) -> Column:
    """A following message that corrects or clarifies the prompt."""
    low, words = F.trim(F.lower(following)), _words(following)
    marked = F.exists(_literals(INDICATORS), lambda k: F.contains(F.lower(following), k))
    first = F.coalesce(F.try_element_at(words, F.lit(1)), F.lit(""))
    praise = F.rtrim(low, F.lit("!.,")).isin(*FEEDBACK) | F.rtrim(first, F.lit("!.,")).isin(*STARTERS)
    overlap = F.size(F.array_intersect(_words(prompt), words)) >= 1
    short = (F.size(words) <= 5) & ~praise & (F.rtrim(first, F.lit(",")).isin(*CORRECTIONS) | (overlap & (F.size(words) <= 3)))
    return (following != "") & (prompt != "") & (marked | short)


def is_topic_change(prompt: Column, following: Column) -> Column:
    a, b = (F.array_except(F.array_distinct(_words(x)), _literals(STOP_WORDS)) for x in (prompt, following))
    some = (prompt != "") & (following != "") & (F.size(a) > 0) & (F.size(b) > 0)
    return F.coalesce(some & (F.size(F.array_intersect(a, b)) / F.nullif(F.greatest(F.size(a), F.size(b)), F.lit(0)) < 0.2), F.lit(False))


def signals(turns: DataFrame) -> DataFrame:
    """Every user turn with its ten flags, its iterations to success and its score in [-1, 1]."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    # From the last turn back the frames run on, so their cost is linear; forward, each row would look at all that follow.
    back = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    after = back.rowsBetween(Window.unboundedPreceding, -1)
    t = turns.withColumns(
        {
            "next_role": F.lead("role").over(w),
            "next_text": F.lead("text").over(w),
            "response": F.coalesce(F.last(F.when(F.col("role") == "assistant", F.col("text")), ignorenulls=True).over(after), F.lit("")),
            "next_user": F.coalesce(F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(after), F.lit("")),
            "segment": F.sum((F.col("role") == "user").cast("int")).over(w),
        }
    )
    near = Window.partitionBy("conv_id", "segment").orderBy("turn").rowsBetween(1, 9)
    for flag, name in (("commit_made", "commit"), ("tests_passed", "tests")):
        t = t.withColumn(flag, F.coalesce(F.max(F.col("text").rlike(PATTERNS[name])).over(near), F.lit(False)))
    paired = F.coalesce(F.col("next_role") == "assistant", F.lit(False))
    u = t.where("role = 'user'").withColumns({"paired": paired, "won": paired & F.coalesce(F.col("next_text").rlike(PATTERNS["success"]), F.lit(False))})
    onward = back.rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("pos", F.row_number().over(w))
    u = u.withColumn("stop", F.min(F.when(F.col("won") | ~F.col("paired"), F.struct("pos", "won"))).over(onward)).withColumn("left", F.count("*").over(onward))
    rounds = F.when(F.col("stop").isNull(), F.col("left")).otherwise(F.col("stop.pos") - F.col("pos") + F.col("stop.won").cast("int"))
    u = u.withColumns(
        {
            "iterations": F.greatest(F.lit(1), rounds).cast("long"),
            "claude_confused": F.col("response").rlike(PATTERNS["confusion"]),
            "error_in_response": F.col("response").rlike(PATTERNS["error"]),
            "task_completed": F.col("response").rlike(PATTERNS["success"]),
            "immediate_clarification": is_clarification(F.col("next_user"), F.col("text")),
            "changed": is_topic_change(F.col("text"), F.col("next_user")),
        }
    )
    u = u.withColumns(
        {
            "single_iteration": (F.col("iterations") == 1) & F.col("task_completed"),
            "multiple_retries": F.col("iterations") > 2,
            "topic_changed": F.col("changed") & F.col("task_completed"),
            "abandoned_task": F.col("changed") & ~(F.col("task_completed") | F.col("commit_made") | F.col("tests_passed")),
        }
    )
    total = sum((x * F.col(c).cast("int") for c, x in WEIGHTS.items()), F.lit(0.0))
    return u.withColumn("score", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total)))


def structural_key(text: Column) -> Column:
    """action:verb / question / other, _with_file, _short / _medium / _long."""
    words = _words(text)
    first = F.trim(F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("")), F.lit(".,!?"))
    head = F.when(first.isin(*ACTIONS), F.concat(F.lit("action:"), first)).when(first.isin(*QUESTIONS), "question").otherwise("other")
    file = F.when(F.lower(text).rlike(r"[.][a-z]{2,4}($|[^\p{L}\p{N}_])|/[a-z_]+|src/|test"), "_with_file").otherwise("")
    size = F.when(F.size(words) < 10, "_short").when(F.size(words) < 30, "_medium").otherwise("_long")
    return F.when(F.size(words) == 0, "empty").otherwise(F.concat(head, file, size))


def template(text: Column) -> Column:
    """File names and components as placeholders."""
    files = F.regexp_replace(text, r"(^|[^\p{L}\p{N}_])[a-z_]+[.](py|js|ts|go|rs|java)($|[^\p{L}\p{N}_])", "$1{file}$3")
    return F.regexp_replace(files, r"(^|[^\p{L}\p{N}_])[A-Z][a-zA-Z]+(Service|Controller|Handler|Manager)($|[^\p{L}\p{N}_])", "$1{component}$3")


def error_class(text: Column) -> Column:
    """First line that reads like an error, without its volatile parts; empty without one."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(PATTERNS["error_signal"]) & ~x.rlike(PATTERNS["banner"]))
    line = F.try_element_at(lines, F.lit(1))
    for pattern, put in ((r"0x[0-9a-fA-F]+", ""), (r"(/[^ \t:'\"]+)+", ""), (r"(^|[^\p{L}\p{N}_])[0-9]+($|[^\p{L}\p{N}_])", "$1$2"), (r"[ \t\n\r\f]+", " ")):
        line = F.regexp_replace(line, pattern, put)
    return F.coalesce(F.substring(F.lower(F.trim(line)), 1, 80), F.lit(""))
