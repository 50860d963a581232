"""Ignore rules: globs compiled on the driver, last matching rule wins."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def glob_regex(pattern: str) -> tuple[str, bool, bool]:
    """(regex over a relative path, negated, directories only): ``*`` and ``?`` stop at a slash, ``**`` crosses it."""
    negated = pattern.startswith("!")
    body = pattern[1:] if negated else pattern
    only_dirs = body.endswith("/")
    body = body.strip("/") if body.startswith("/") else body.rstrip("/")
    anchored = "/" in body or pattern.lstrip("!").startswith("/")
    out = ""
    for token in re.findall(r"\*\*/|\*\*|\*|\?|\[!?[^\]]+\]|.", body):
        if token == "**/":
            out += "(?:[^/]+/)*"
        elif token == "**":
            out += ".*"
        elif token == "*":
            out += "[^/]*"
        elif token == "?":
            out += "[^/]"
        elif token.startswith("[") and len(token) > 2:
            out += "[^" + token[2:] if token[1] == "!" else token
        else:
            out += re.escape(token)
    head = "^" if anchored else "(?:^|.*/)"
    return f"{head}{out}" + ("/.*$" if only_dirs else "(?:/.*)?$"), negated, only_dirs


def ignored(path: Column, rules: list[str]) -> Column:
    """True where the last matching rule is not negated. Blank lines and comments are no rules."""
    out = F.lit(False)
    for rule in (r.strip() for r in rules):
        if rule and not rule.startswith("#"):
            regex, negated, _ = glob_regex(rule)
            out = F.when(path.rlike(regex), F.lit(not negated)).otherwise(out)
    return out
