"""Unified diffs of text columns and their application.

Lines become numbers, those that only one side has are set aside, and a linear-space Myers search finds a longest common
subsequence of the rest: time grows with the lines times the differences among shared lines, memory with the lines. ``applied``
looks for each hunk at its line and then nearer to farther away, after the hunk before; a hunk whose old lines are nowhere is
refused, and a text with a refused hunk is not changed at all. Null texts are empty; a text is its lines, split at newlines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

CONTEXT = 3
_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_APPLIED = "patched string, hunks int, refused int, farthest int"


def _middle(a: list[int], b: list[int]) -> tuple[int, int, int, int]:
    """The middle snake of two sequences without a common end: from (x, y) to (u, v)."""
    n, m = len(a), len(b)
    delta, odd = n - m, (n - m) & 1
    ahead, back = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            x = ahead[k + 1] if k == -d or k != d and ahead[k - 1] < ahead[k + 1] else ahead[k - 1] + 1
            y = x - k
            x0, y0 = x, y
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            ahead[k] = x
            if odd and abs(delta - k) < d and x + back[delta - k] >= n:
                return x0, y0, x, y
        for k in range(-d, d + 1, 2):
            x = back[k + 1] if k == -d or k != d and back[k - 1] < back[k + 1] else back[k - 1] + 1
            y = x - k
            x0, y0 = x, y
            while x < n and y < m and a[n - 1 - x] == b[m - 1 - y]:
                x, y = x + 1, y + 1
            back[k] = x
            if not odd and abs(delta - k) <= d and x + ahead[delta - k] >= n:
                return n - x, m - y, n - x0, m - y0
    raise AssertionError("two sequences always have a middle")


def matches(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence of hashable items, ascending."""
    shared = set(a) & set(b)
    at_a, at_b = [i for i, x in enumerate(a) if x in shared], [j for j, x in enumerate(b) if x in shared]
    number = {x: k for k, x in enumerate(shared)}
    left, right = [number[a[i]] for i in at_a], [number[b[j]] for j in at_b]
    out, todo = [], [(0, len(left), 0, len(right))]
    while todo:
        p, q, r, s = todo.pop()
        while p < q and r < s and left[p] == right[r]:
            out.append((at_a[p], at_b[r]))
            p, r = p + 1, r + 1
        while p < q and r < s and left[q - 1] == right[s - 1]:
            q, s = q - 1, s - 1
            out.append((at_a[q], at_b[s]))
        if p < q and r < s:
            x, y, u, v = _middle(left[p:q], right[r:s])
            out += [(at_a[p + x + k], at_b[r + y + k]) for k in range(u - x)]
            todo += [(p, p + x, r, r + y), (p + u, q, r + v, s)]
    return sorted(out)


def diff(old: str, new: str, context: int = CONTEXT) -> str:
    """Unified diff with ``context`` lines around changes; empty for equal texts."""
    a, b = (t.split("\n") if t else [] for t in (old, new))
    pairs = [*matches(a, b), (len(a), len(b))]
    changes, i, j = [], 0, 0  # (first and end in a, first and end in b)
    for x, y in pairs:
        if x > i or y > j:
            changes.append((i, x, j, y))
        i, j = x + 1, y + 1
    groups: list[list] = []
    for c in changes:
        if groups and c[0] - groups[-1][-1][1] <= 2 * context:
            groups[-1].append(c)
        else:
            groups.append([c])
    out = ["--- a", "+++ b"] if groups else []
    for g in groups:
        before, after = min(context, g[0][0]), min(context, len(a) - g[-1][1])
        first, last, top, end = g[0][0] - before, g[-1][1] + after, g[0][2] - before, g[-1][3] + after
        span = lambda s, n: f"{s + (n > 0)}" if n == 1 else f"{s + (n > 0)},{n}"
        out.append(f"@@ -{span(first, last - first)} +{span(top, end - top)} @@")
        at = first
        for i, x, j, y in g:
            out += [" " + line for line in a[at:i]] + ["-" + line for line in a[i:x]] + ["+" + line for line in b[j:y]]
            at = x
        out += [" " + line for line in a[at:last]]
    return "\n".join(out)


def hunks(patch: str) -> list[tuple[int, list[str], list[str]]]:
    """(first old line from 0, old lines, new lines) of each hunk; what stands before the first is no matter."""
    out, left, right = [], 0, 0
    for line in patch.split("\n"):
        if left or right:
            mark, rest = line[:1], line[1:]
            if mark in (" ", "-", ""):
                out[-1][1].append(rest)
                left -= 1
            if mark in (" ", "+", ""):
                out[-1][2].append(rest)
                right -= 1
        elif m := _HUNK.match(line):
            left, right = (1 if m[k] is None else int(m[k]) for k in (2, 4))
            out.append((int(m[1]) - (left > 0), [], []))
    return out


def _found(lines: list[str], old: list[str], wanted: int, least: int) -> int | None:
    """The place nearest to ``wanted`` where ``old`` stands, not before ``least``; of two as near the later."""
    last = len(lines) - len(old)
    for away in range(max(last - wanted, wanted - least, 0) + 1):
        for at in (wanted + away, wanted - away):
            if least <= at <= last and lines[at : at + len(old)] == old:
                return at
    return None


def apply(text: str, patch: str) -> tuple[str | None, int, int, int]:
    """(the patched text or None if any hunk is refused, hunks, refused ones, the farthest that one was found from its line)."""
    lines = text.split("\n") if text else []
    out, done, drift, refused, farthest = [], 0, 0, 0, 0
    parts = hunks(patch)
    for start, old, new in parts:
        at = _found(lines, old, start + drift, done)
        if at is None:
            refused += 1
            continue
        drift = at - start
        farthest = max(farthest, abs(drift))
        out += lines[done:at] + new
        done = at + len(old)
    return None if refused else "\n".join(out + lines[done:]), len(parts), refused, farthest


def _diffs(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for old, new in batches:
        yield pd.Series([diff(a or "", b or "") for a, b in zip(old, new, strict=True)], dtype=object)


def _patches(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for text, patch in batches:
        yield pd.DataFrame([apply(t or "", p or "") for t, p in zip(text, patch, strict=True)], columns=["patched", "hunks", "refused", "farthest"])


def unified_diff(old: Column, new: Column) -> Column:
    """Unified diff of two texts; empty for equal texts."""
    return F.pandas_udf(_diffs, "string")(old, new)


def applied(text: Column, patch: Column) -> Column:
    """A struct: ``patched`` (null if a hunk is refused), ``hunks``, ``refused``, ``farthest``."""
    return F.pandas_udf(_patches, _APPLIED)(text, patch)
