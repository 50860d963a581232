"""Overlap of suggested and actual changes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ACCEPTED_DIFF, ACCEPTED_CODE = 0.3, 0.8


def _lines(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))


def _ratio(common: Column, whole: Column, a: Column, b: Column) -> Column:
    none = (F.size(a) == 0) & (F.size(b) == 0)
    return F.when(none, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common / F.nullif(whole, F.lit(0)))


def changed_lines(diff: Column) -> Column:
    """Distinct added and removed lines with their sign; headers and hunk marks are none."""
    kept = lambda x: x.rlike(r"^[+-]") & ~x.rlike(r"^(\+\+\+|---|@@)")
    return F.array_distinct(F.filter(_lines(diff), kept))


def diff_overlap(suggested: Column, actual: Column) -> Column:
    """Jaccard of the changed lines: 1 if neither changes a line, 0 if one does not."""
    a, b = changed_lines(suggested), changed_lines(actual)
    return _ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)), a, b)


def code_overlap(code: Column, actual: Column) -> Column:
    """Share of the smaller side that a code block and the added lines of a diff have in common."""
    a = F.array_distinct(F.filter(_lines(code), lambda x: x != ""))
    plus = F.filter(F.split(F.coalesce(actual, F.lit("")), "\n"), lambda x: x.startswith("+") & ~x.startswith("+++"))
    b = F.array_distinct(F.filter(F.transform(plus, lambda x: F.regexp_replace(F.substring(x, 2, 1 << 30), r"(?U)^\s+|\s+$", "")), lambda x: x != ""))
    return _ratio(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b)), a, b)


def verdict(suggested_diff: Column, code: Column, actual: Column) -> Column:
    """``accepted`` or ``modified``: by the diff over 0.3, without one by the code from 0.8 on."""
    by_diff = F.when(diff_overlap(suggested_diff, actual) > ACCEPTED_DIFF, "accepted").otherwise("modified")
    by_code = F.when(code_overlap(code, actual) >= ACCEPTED_CODE, "accepted").otherwise("modified")
    return F.when(F.coalesce(suggested_diff, F.lit("")) != "", by_diff).otherwise(by_code)
