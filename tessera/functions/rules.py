"""Small rules as column expressions: prompts, paths, times, gates of facts and runs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tessera.functions.text import is_test_path  # noqa: F401

# File extensions and language names.
LANGUAGES = {
    "py": "python", "pyi": "python", "cs": "c_sharp", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "java": "java", "go": "go", "rs": "rust", "c": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "h": "c", "hpp": "cpp", "hh": "cpp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin",
}
ALIASES = {
    "csharp": "c_sharp", "c#": "c_sharp", "cs": "c_sharp", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "py": "python", "golang": "go",
    "c++": "cpp", "cc": "cpp", "rs": "rust", "rb": "ruby", "kt": "kotlin",
}
CODE = ["py", "js", "ts", "tsx", "jsx", "go", "rs", "java", "c", "cpp", "h", "hpp", "cs", "rb", "swift", "kt", "scala", "sql", "sh", "bash", "zsh"]
# Key words of algorithm categories, in their order.
CATEGORIES = {
    "two-pointer": ["two pointer", "left right", "start end", "both ends", "from edges"],
    "sliding-window": ["sliding window", "subarray", "substring", "consecutive", "window size"],
    "hash-map": ["hash map", "dictionary", "frequency", "count occurrences", "lookup"],
    "binary-search": ["binary search", "sorted array", "log n", "divide half", "mid point"],
    "dynamic-programming": ["dp", "dynamic programming", "memoization", "subproblem", "optimal substructure"],
    "greedy": ["greedy", "local optimum", "sorted first", "priority"],
    "backtracking": ["backtrack", "recursion", "try all", "explore paths", "permutation", "combination"],
    "graph": ["graph", "bfs", "dfs", "traversal", "adjacency", "connected"],
    "tree": ["tree", "binary tree", "level order", "inorder", "preorder", "postorder"],
    "stack": ["stack", "lifo", "push pop", "monotonic"],
    "queue": ["queue", "fifo", "deque"],
    "heap": ["heap", "priority queue", "max heap", "min heap"],
    "sort": ["sort", "merge sort", "quick sort", "bubble sort"],
}
# Causes of failures and what tells them, in their order.
CAUSES = [
    (["timeout", "time limit"], "Performance: timeout on large input"),
    (["indexerror", "out of range"], "Edge case: array index out of bounds"),
    (["keyerror", "not found"], "Edge case: missing key/value"),
    (["empty", "null", "none"], "Edge case: empty or null input"),
    (["assertionerror", "wrong answer"], "Logic error: incorrect algorithm or calculation"),
]
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
NOT_CONTRIBUTED = ["seed", "community", "constraint", "history", "git-commit"]


def _some(text: Column, words: list[str]) -> Column:
    out = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(text, F.lit(w))
    return out


def targets_tests(prompt: Column) -> Column:
    """The prompt is itself about testing."""
    return F.coalesce(prompt.rlike(r"(?iU)\btest|\bpytest\b|\bspecs?\b"), F.lit(False))


def explicit_paths(prompt: Column) -> Column:
    """Distinct path-like tokens, with forward slashes, lower-case."""
    found = F.regexp_extract_all(F.coalesce(prompt, F.lit("")), F.lit(r"[A-Za-z0-9_][A-Za-z0-9_./\\-]*\.[A-Za-z][A-Za-z0-9]{0,5}"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda t: F.lower(F.regexp_replace(F.replace(t, F.lit("\\"), F.lit("/")), r"^(?:\./)+", ""))))


def names_path(path: Column, tokens: Column) -> Column:
    """Whether one of the tokens names ``path``: equal, or one ends with the other at a slash."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    hit = F.exists(tokens, lambda t: (t != "") & ((low == t) | F.endswith(low, F.concat(F.lit("/"), t)) | F.endswith(t, F.concat(F.lit("/"), low))))
    return F.coalesce((path != "") & hit, F.lit(False))


def suffix(path: Column) -> Column:
    """Lower-case extension of the last part, without the dot; empty without one (a leading dot is none)."""
    return F.lower(F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"[^.].*?\.([^.]+)$|^[^.]+\.([^.]+)$", 1))


def language_of(path: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(names, suffix(path))


def language_name(label: Column) -> Column:
    low = F.lower(F.coalesce(label, F.lit("")))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair]), low), low)


def is_code_file(path: Column) -> Column:
    return suffix(path).isin(*CODE)


def is_review_only(path: Column) -> Column:
    """Review documents, files under review folders and the sentinel that nothing is to be changed."""
    p = F.trim(F.coalesce(path, F.lit("")))
    low = F.lower(p)
    base = F.substring_index(low, "/", -1)
    parts = F.split(F.regexp_replace(low, "^/+|/+$", ""), "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    under = F.exists(folders, lambda s: s.isin("review", "reviews") | F.endswith(s, F.lit("-review")))
    return (p != "") & (p.isin("NO_MODIFY", "/NO_MODIFY") | (F.endswith(base, F.lit(".md")) & F.contains(base, F.lit("review"))) | under)


def is_untrackable(path: Column, normalized: Column) -> Column:
    """No diff can ever show what became of this path."""
    return (path == "/dev/null") | F.startswith(normalized, F.lit("docs/")) | F.contains(normalized, F.lit("/docs/")) | is_review_only(path)


def is_verifiable(path: Column, has_text: Column, is_file: Column, is_folder: Column, parent_is_folder: Column) -> Column:
    """A diff could name the path: an existing file, or a new one in an existing folder of the repository, and there is a text to compare."""
    return F.coalesce((path != "") & has_text & ~is_folder & (is_file | parent_is_folder), F.lit(False))


def algorithm_category(text: Column) -> Column:
    """The first category with a key word in the text; ``general`` without one."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), None
    for name, words in CATEGORIES.items():
        hit = _some(low, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("general")


def failure_causes(trace: Column) -> Column:
    """At most three causes, in the order of the rules."""
    low = F.lower(F.coalesce(trace, F.lit("")))
    found = F.filter(F.array(*[F.when(_some(low, words), F.lit(cause)) for words, cause in CAUSES]), lambda c: c.isNotNull())
    return F.slice(found, 1, 3)


def since_seconds(value: Column) -> Column:
    """Seconds of a window such as ``14d``, ``48h``, ``30m``, ``90``; null for none (empty, ``all``, ``0``); anything else is an error."""
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    number, unit = F.regexp_extract(v, r"^([0-9]+\.?[0-9]*|\.[0-9]+)([smhdw]?)$", 1), F.regexp_extract(v, r"^([0-9]+\.?[0-9]*|\.[0-9]+)([smhdw]?)$", 2)
    factor = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair]), unit), F.lit(1))
    wrong = F.raise_error(F.concat(F.lit("invalid window: "), v)).cast("double")
    return F.when(v.isin("", "all", "0"), F.lit(None).cast("double")).when(number != "", number.try_cast("double") * factor).otherwise(wrong)


def epoch(stamp: Column) -> Column:
    """Seconds since 1970 of a number or an ISO date and time (UTC if it names no zone); null if it is neither."""
    iso = F.try_to_timestamp(stamp)
    return F.coalesce(stamp.try_cast("double"), F.unix_micros(iso) / 1e6)


def is_contributable(min_confidence: float = 0.8, min_successes: int = 3) -> Column:
    """Valid, no constraint, not from a feed or a history, confident and validated."""
    eligible = F.col("is_valid") & (F.col("kind") != "constraint") & ~F.arrays_overlap("tags", F.array(*map(F.lit, NOT_CONTRIBUTED)))
    return eligible & (F.col("confidence") >= min_confidence) & (F.col("success_count") >= min_successes)


def effort(patterns: Column, confidence: Column, difficulty: Column) -> Column:
    known = F.when(confidence < 0.5, "high").when((patterns >= 3) & (confidence >= 0.8), "low").otherwise("medium")
    return F.when(patterns == 0, F.when(difficulty == "hard", "xhigh").otherwise("high")).otherwise(known)


def mode(level: Column, available: Column, models: Column, asked: Column, least: int = 1) -> Column:
    """(mode, effort): several agents for new ground where a panel can be had; an asked mode goes first."""
    able, want = available & (models >= least), F.lower(F.trim(F.coalesce(asked, F.lit(""))))
    pick = lambda m, e: F.struct(F.lit(m).alias("mode"), e.alias("effort"))
    deep = F.when(able, pick("multi_agent", level)).otherwise(pick("fast", F.lit("xhigh")))
    auto = F.when(level.isin("high", "xhigh") & able, pick("multi_agent", level)).otherwise(pick("fast", level))
    return F.when(want.isin("fast", "single"), pick("fast", level)).when(want.isin("deep", "deliberate", "multi", "multi_agent", "multi-agent"), deep).otherwise(auto)


def architecture_severity(god_files: Column, cycles: Column, depth: Column, covered: Column) -> Column:
    """Of the differences of two snapshots; cycles and depth count only where both cover the code, depth beyond a band of one."""
    inner = F.when((cycles > 0) | (depth > 1), "regression").when((cycles < 0) | (depth < -1), "improvement").otherwise("neutral")
    return F.when(god_files > 0, "regression").when(god_files < 0, "improvement").when(~covered, "neutral").otherwise(inner)


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def evidence_held(span: Column, parts: Column) -> Column:
    """The span occurs word for word in the joined parts, white space aside; an empty one does not."""
    s = _squeezed(span)
    return (s != "") & F.contains(_squeezed(F.array_join(parts, " ")), s)


def admitted(kind: Column, confidence: Column, domain: Column, override: Column) -> Column:
    """(kind, confidence, domain) of a lesson as it is admitted: at most 0.6, its source's kind first."""
    own = F.when(kind == "failure", "failure").otherwise("pattern")
    held = F.coalesce(F.nullif(confidence.try_cast("double"), F.lit(0.0)), F.lit(0.5))
    return F.struct(F.coalesce(override, own).alias("kind"), F.least(held, F.lit(0.6)).alias("confidence"), F.when(domain != "other", domain).otherwise("").alias("domain"))


def change_reason(diff: Column) -> Column:
    """Why a rules file changed, by the added and removed lines of a unified diff."""
    lines = F.split(F.coalesce(diff, F.lit("")), "\n")
    up = F.size(F.filter(lines, lambda x: F.startswith(x, F.lit("+")) & ~F.startswith(x, F.lit("+++"))))
    down = F.size(F.filter(lines, lambda x: F.startswith(x, F.lit("-")) & ~F.startswith(x, F.lit("---"))))
    return (
        F.when((up > 0) & (down == 0), "added").when((down > 0) & (up == 0), "removed").when(up > down, "expanded").when(down > up, "simplified").otherwise("modified")
    )


def actionable(diagnostics: Column, informational: list[str]) -> Column:
    """Diagnostics (severity, ...) that assert a problem."""
    return F.filter(diagnostics, lambda d: ~F.lower(F.coalesce(d["severity"], F.lit(""))).isin(*informational))


def stated_constraints(problem: Column) -> Column:
    """Names of the checkable constraints that a problem states, a divisor behind a colon, in the order of the rules."""
    low = F.lower(F.coalesce(problem, F.lit("")))
    divisor = lambda p: F.nullif(F.regexp_extract(low, p, 1), F.lit(""))
    rules = [
        F.when(_some(low, ["sorted array", "sorted list", "in sorted order", "non-decreasing"]), F.lit("sorted")),
        F.when(F.contains(low, F.lit("increasing")) & ~F.contains(low, F.lit("sorted")), F.lit("increasing")),
        F.when(F.contains(low, F.lit("decreasing")), F.lit("decreasing")),
        *[F.concat(F.lit("divisible:"), divisor(p)) for p in (r"divisible by (\d+)", r"multiple of (\d+)", r"modulo (\d+) (?:is|equals) 0")],
        F.when(_some(low, ["non-negative", "non negative", "positive integer", "≥ 0", ">= 0"]), F.lit("non_negative")),
        F.when(_some(low, ["unique", "distinct", "no duplicates", "all different"]), F.lit("unique")),
    ]
    return F.filter(F.array(*rules), lambda c: c.isNotNull())
