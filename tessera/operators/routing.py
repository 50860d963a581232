"""Query shape and decomposition as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tessera.functions.text import EDGE_L, EDGE_R

_W = r"[\p{L}\p{N}_]"
# Shape patterns, chains before splits.
CHAINS = [
    rf"(?i){EDGE_L}(?:of|in|on|by|from|under) the [\p{{L}}\p{{N}}_-]+ (?:of|in|on|by|from|under) the{EDGE_R}",
    rf"{_W}'s {_W}+'s{EDGE_R}",
    rf"(?i){EDGE_L}(?:that|which|who) (?:owns|has|holds|contains) the {_W}",
]
SPLITS = [rf"(?i){EDGE_L}(?:compare|contrast) {_W}", rf"(?i){EDGE_L}(?:diff(?:erence)? between|vs|versus){EDGE_R}"]
_SPACE = r"[ \t\n\r\f]"


def classify(query: Column) -> Column:
    """chain, split or direct."""
    out = None
    for shape, patterns in (("chain", CHAINS), ("split", SPLITS)):
        for p in patterns:
            out = F.when(query.rlike(p), shape) if out is None else out.when(query.rlike(p), shape)
    return F.coalesce(out, F.lit("direct"))


def decompose(query: Column, shape: Column) -> Column:
    """Sub-queries: a chain's links innermost first (3 at most), a split's branches (6 at most), else the query."""
    whole = F.array(F.trim(query))
    filled = lambda parts: F.filter(parts, lambda p: p != "")
    links = F.slice(F.reverse(filled(F.transform(F.split(query, rf"(?i){_SPACE}+of the{_SPACE}+"), lambda p: F.trim(p)))), 1, 3)
    body = F.regexp_replace(F.trim(query), rf"(?i)^(?:compare|contrast|diff(?:erence)? between){_SPACE}+", "")
    cut = F.split(body, rf"(?i){_SPACE}*(?:,| and | or | vs | versus | between ){_SPACE}*")
    branches = F.slice(filled(F.transform(cut, lambda p: F.trim(p, F.lit(" ?.")))), 1, 6)
    several = lambda parts: F.when(F.size(parts) > 1, parts).otherwise(whole)
    return F.when(shape == "chain", several(links)).when(shape == "split", several(branches)).otherwise(whole)
