"""Decision tables and scores of runs, hypotheses, prompts and legacy entries, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tessera.functions.rules import CATEGORIES
from tessera.functions.text import EDGE_L, EDGE_R

# Phrases of problem descriptions.
JUNK = [
    "you are given", "given an array", "given a string", "return true if", "return the number of", "find the number of", "find the maximum", "find the minimum", "determine if the", "calculate the number",
    "check if the",
]
# What a log says of a run.
SYNTAX = rf"(?i){EDGE_L}(SyntaxError|ParseError|parse error|unexpected token|unterminated|invalid syntax){EDGE_R}"
WRONG = rf"(?i){EDGE_L}(assertion ?error|expected .* got|test (failed|fail)|wrong (answer|output)|incorrect|FAIL(ED)?){EDGE_R}"
# Words of the prompt rules.
VAGUE = ["fix", "change", "update", "modify", "improve", "refactor", "adjust", "tweak", "handle", "do", "make", "work on", "look at", "check", "review", "clean up", "optimize"]
FILE_REF = rf"(?i)[A-Za-z0-9_/.-]+[.](py|js|ts|go|rs|java|cpp|c|h|md|json|yaml|yml|toml){EDGE_R}|{EDGE_L}in[ \t\n]+[A-Za-z0-9_/.-]|{EDGE_L}(src|lib|tests?)/[^ \t\n]"
LIMITS = rf"(?i){EDGE_L}(must|should|required?|requires|ensure|validate|before|after|without|only){EDGE_R}|{EDGE_L}(returns?|accepts?|when|if)[ \t\n]+[\p{{L}}\p{{N}}_]"
CRITERIA = rf"(?i){EDGE_L}tests?[ \t\n]+(should[ \t\n]+)?pass|{EDGE_L}should[ \t\n]+(return|output|produce)|{EDGE_L}(expect|expected|expectd|verify|verified|confirm){EDGE_R}|{EDGE_L}results?[ \t\n]+in{EDGE_R}|{EDGE_L}pass(es|ing)?[ \t\n]+(all[ \t\n]+)?tests?{EDGE_R}"
STATUSES = ["candidate", "supported", "confirmed", "rejected", "contradicted"]
ALLOWED = {"candidate": ["candidate", "supported", "rejected"], "supported": ["supported", "confirmed", "rejected"], "confirmed": ["confirmed", "contradicted"], "rejected": ["rejected", "candidate"], "contradicted": ["contradicted", "candidate"]}


def _any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda k: F.contains(text, k))


def loop_decision(gates: dict[str, Column], exhausted: Column, success: Column, diagnosis: Column, failure: Column) -> Column:
    """(goal, strategy) of a loop: the first rule that fits.

    ``gates``: required, passed, failed, unavailable and pending counts; ``diagnosis``: ``changed``, ``same`` or null.
    """
    rules = [
        ((gates["required"] > 0) & (gates["passed"] == gates["required"]), "satisfied", "stop_success"),
        (exhausted, "blocked", "stop_blocked"),
        (gates["failed"] > 0, "in_progress", "change_strategy"),
        ((gates["required"] == 0) & success, "unverifiable", "stop_blocked"),
        (gates["unavailable"] > 0, "unverifiable", "stop_blocked"),
        ((gates["pending"] > 0) & success, "unverifiable", "continue"),
        (diagnosis == "changed", "in_progress", "change_strategy"),
        (diagnosis == "same", "in_progress", "continue"),
        (failure, "in_progress", "change_strategy"),
    ]
    out: Column | None = None
    for test, goal, strategy in rules:
        one = F.struct(F.lit(goal).alias("goal"), F.lit(strategy).alias("strategy"))
        out = F.when(test, one) if out is None else out.when(test, one)
    return out.otherwise(F.struct(F.lit("in_progress").alias("goal"), F.lit("continue").alias("strategy")))


def hypothesis_status(prior: Column, claimed: Column, support: Column, contra: Column, tested: Column) -> Column:
    """The status that evidence allows: disallowed transitions revert, claims without evidence step down."""
    allowed = F.create_map(*[x for p, after in ALLOWED.items() for x in (F.lit(p), F.array(*map(F.lit, after)))])
    s = F.when(F.array_contains(F.try_element_at(allowed, prior), claimed), claimed).otherwise(prior)
    dead = prior.isin("rejected", "contradicted")
    s = F.when(dead & (s == "candidate") & ~support & ~contra, prior).otherwise(s)
    down = F.when(support, "supported").otherwise("candidate")
    return (
        F.when(contra & ~s.isin("rejected", "contradicted"), F.when(s == "confirmed", "contradicted").otherwise("rejected"))
        .when(s.isin("rejected", "contradicted") & ~contra & ~dead, down)
        .when((s == "confirmed") & (~tested | ~support), down)
        .when((s == "supported") & ~support, "candidate")
        .otherwise(s)
    )


def outcome_class(log: Column, speed: Column) -> Column:
    """What a run's log and its speed against the base (1 = as fast) say, syntax first."""
    return F.when(log.rlike(SYNTAX), "syntax_error").when(log.rlike(WRONG), "functional_incorrectness").when(speed > 1, "speed_up").when(speed < 1, "slow_down").otherwise("unknown")


def run_confidence(mean: Column, issues: Column, diagnostics: Column) -> Column:
    """Mean of what can be scored, less up to 0.15 for issues and 0.10 for diagnostics; null where nothing can."""
    return F.when(mean.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean - F.least(F.lit(0.15), 0.02 * issues) - F.least(F.lit(0.1), 0.01 * diagnostics))))


def prompt_lacks(prompt: Column) -> Column:
    """Names of what a prompt lacks, in the order of the five rules."""
    words = F.size(F.filter(F.split(prompt, r"[ \t\n\r\f]+"), lambda w: w != ""))
    vague = _any(F.lower(prompt), VAGUE) & ~(prompt.rlike(FILE_REF) | prompt.rlike(LIMITS) | (words > 15))
    flags = [(vague, "lacks_specificity"), (~prompt.rlike(FILE_REF), "missing_file_references"), (~prompt.rlike(LIMITS), "missing_constraints"), (~prompt.rlike(CRITERIA), "missing_acceptance_criteria"), (words < 5, "too_brief")]
    return F.filter(F.array(*[F.when(f, F.lit(n)) for f, n in flags]), lambda x: x.isNotNull())


def enhancement_confidence(issues: Column, patterns: Column) -> Column:
    return F.least(F.lit(1.0), 0.5 + F.least(F.lit(0.3), 0.1 * F.size(issues)) + F.least(F.lit(0.2), 0.07 * patterns))


def entry_quality(confidence: Column, wins: Column, losses: Column, uses: Column) -> Column:
    """Confidence, half success rate from ten signals on, scaled by use."""
    n = wins + losses
    base = F.when(n >= 10, confidence * 0.5 + wins / F.nullif(n, F.lit(0)) * 0.5).otherwise(confidence)
    return base * (0.9 + 0.1 * F.least(F.lit(1.0), uses / 10))


def strategy_level(easy: Column, hard: Column, steps: Column) -> Column:
    """Level of an entry by its success rates at easy and hard problems and its steps."""
    return F.when((hard > 0.6) & (steps > 3), "compositional").when((easy >= 0.75) & (hard < 0.4), "procedural").otherwise("adaptive")


def strategy_boost(level: Column, difficulty: str) -> Column:
    """What a level is worth at a difficulty."""
    worth = {("hard", "compositional"): 0.15, ("hard", "procedural"): -0.10, ("hard", "adaptive"): 0.05, ("easy", "adaptive"): 0.05, ("medium", "adaptive"): 0.10}
    out = F.lit(0.0)
    for (when, name), x in worth.items():
        if when == difficulty:
            out = F.when(level == name, x).otherwise(out)
    return out


def keyword_relevance(asked: Column, pattern: Column, context: Column, shared_files: Column) -> Column:
    """0.5 for a word of the pattern in the question, 0.3 for shared files, 0.2 for a word of the context; at most 1."""
    words = lambda part: F.filter(F.split(F.lower(F.coalesce(part, F.lit(""))), r"[ \t\n\r\f]+"), lambda w: w != "")
    inside = lambda part: F.exists(words(part), lambda w: F.contains(asked, w)).cast("int")
    return F.least(F.lit(1.0), inside(pattern) * 0.5 + shared_files.cast("int") * 0.3 + inside(context) * 0.2)


def junk_phrases(text: Column) -> Column:
    """How many phrases of problem descriptions a text holds."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.contains(low, F.lit(p)).cast("int") for p in JUNK), F.lit(0))


def is_junk(pattern: Column, suggestion: Column) -> Column:
    """A problem description or bare code instead of a solution."""
    both = F.lower(F.concat(F.coalesce(pattern, F.lit("")), F.lit(" "), F.coalesce(suggestion, F.lit(""))))
    hits, size = junk_phrases(both), F.length(F.coalesce(suggestion, F.lit("")))
    code = F.contains(suggestion, F.lit("def ")) | F.contains(suggestion, F.lit("class "))
    insight = _any(both, [w for words in CATEGORIES.values() for w in words])
    return F.coalesce(((hits >= 2) & (size > 150)) | ((hits >= 1) & (size > 300)) | (code & (size > 100) & ~insight), F.lit(False))
