"""Chat formatting from event logs, in DataFrame operations only.

Events (conv_id, seq, message_id, kind, role, text) are folded per message: ``message``, ``edit`` and ``regenerate`` set
the text (a regeneration without text starts empty), ``delta`` appends to what the last of these left, ``delete`` drops the
message. A message stands where its first event stands; its role is the first that is not null. Folding is per
message, so a long conversation is shared out; only the rendered string, the output unit, is put together per conversation.

Rendering marks turns with control strings and escapes texts: every backslash and every control string gets one backslash before
it. That is reversible, linear in the text, and a control string behind no backslash is never text. Loss covers the text of assistant turns. Nulls: texts and roles read as empty, a null conversation is one of its own
(rows of null ``conv_id`` together), rows of null ``seq`` come first; repeated events (equal in all but order) apply twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The control strings.
USER, USER_END = "[INST]", "[/INST]"
ASSISTANT, ASSISTANT_END = "<s>", "</s>"
SYSTEM, SYSTEM_END = "<<SYS>>", "<</SYS>>"
ROLE, ROLE_END, OTHER_END = "[ROLE]", "[/ROLE]", "[/TURN]"
CONTROLS = [USER, USER_END, ASSISTANT, ASSISTANT_END, SYSTEM, SYSTEM_END, ROLE, ROLE_END, OTHER_END]
_ANY = "|".join(c.replace("[", r"\[").replace("]", r"\]") for c in CONTROLS)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\|{_ANY})", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\|{_ANY})", "$1")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, message_id, at, role, text): the final messages."""
    key = ["conv_id", "message_id"]
    e = events.select(*key, "seq", F.lower("kind").alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    order = F.struct(F.coalesce("seq", F.lit(-(1 << 62))).alias("seq"), "text")
    sets = F.col("kind") != "delta"
    per = e.groupBy(*key).agg(
        F.min(F.coalesce("seq", F.lit(-(1 << 62)))).alias("at"),
        F.min_by("role", F.when(F.col("role").isNotNull(), order)).alias("role"),
        F.max(F.when(sets, F.struct(order.alias("o"), "kind"))).alias("last"),
        F.sort_array(F.collect_list(F.when(~sets, order))).alias("deltas"),
    )
    later = F.filter("deltas", lambda d: F.col("last").isNull() | (d["seq"] >= F.col("last.o.seq")))
    text = F.concat(F.coalesce("last.o.text", F.lit("")), F.array_join(F.transform(later, lambda d: d["text"]), ""))
    return per.where("last is null or last.kind <> 'delete'").select(*key, "at", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted) from final messages."""
    body = escape(F.col("text"))
    turn = (
        F.when(F.col("role") == "user", F.concat(F.lit(USER + " "), body, F.lit(" " + USER_END)))
        .when(F.col("role") == "assistant", F.concat(F.lit(ASSISTANT + " "), body, F.lit(" " + ASSISTANT_END)))
        .when(F.col("role") == "system", F.concat(F.lit(SYSTEM + " "), body, F.lit(" " + SYSTEM_END)))
        .otherwise(F.concat(F.lit(ROLE + " "), escape(F.col("role")), F.lit(f" {ROLE_END} "), body, F.lit(" " + OTHER_END)))
    )
    turns = messages.select("conv_id", F.struct("at", "message_id", turn.alias("turn")).alias("t"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["turn"]), "\n")
    return turns.groupBy("conv_id").agg(joined.alias("formatted"))


def parse(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns): turns (role, text) read back from the rendered string alone."""
    marks = [("user", USER, USER_END), ("assistant", ASSISTANT, ASSISTANT_END), ("system", SYSTEM, SYSTEM_END), ("", ROLE, OTHER_END)]
    quote = lambda s: s.replace("[", r"\[").replace("]", r"\]")
    spans = "|".join(rf"(?<!\\){quote(a)} .*? (?<!\\){quote(b)}" for _, a, b in marks)
    found = F.regexp_extract_all("formatted", F.lit(f"(?s)({spans})(?=\n|$)"), F.lit(1))

    def turn(t: Column) -> Column:
        between = lambda a, b: t.substr(F.lit(len(a) + 2), F.length(t) - (len(a) + len(b) + 2))
        other = rf"(?s)^\[ROLE\] (.*?) (?<!\\)\[/ROLE\] (.*) \[/TURN\]$"
        role = F.when(t.startswith(ROLE), unescape(F.regexp_extract(t, other, 1)))
        text = F.when(t.startswith(ROLE), F.regexp_extract(t, other, 2))
        for name, a, b in marks[:3]:
            role = role.when(t.startswith(a), F.lit(name))
            text = text.when(t.startswith(a), between(a, b))
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return formatted.select("conv_id", "formatted", found.alias("_spans")).select("conv_id", "formatted", F.transform("_spans", turn).alias("turns"))


def digests(parsed: DataFrame) -> DataFrame:
    """The contract's columns from parsed conversations."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def conversation_events(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows as one ``message`` event each; rows of an equal turn stand by role and text."""
    from pyspark.sql import Window

    tie = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    return rows.select(
        "conv_id", F.col("turn").alias("seq"), F.struct(F.col("turn"), tie.alias("n")).alias("message_id"), F.lit("message").alias("kind"), "role", "text"
    )
