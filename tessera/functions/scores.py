"""Numeric expressions: recall decay, rank scores, cosine."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

NORMALIZER = 1 - math.exp(-1)
DAY = 86400.0


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0).cast("double"), lambda s, x: s + x)


def cosine(a: Column, b: Column, default: float = 0.0) -> Column:
    """Cosine in double precision; ``default`` for null, zero-norm or non-finite sides."""
    c = dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
    return F.coalesce(F.when(~F.isnan(c), c), F.lit(default))


def recall_probability(cos: Column, days: Column, strength: Column) -> Column:
    g = F.when(strength > 0, strength).otherwise(1.0)
    inner = cos * F.exp(-F.greatest(days, F.lit(0.0)) / g)
    return F.when(cos <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - F.exp(-inner)) / NORMALIZER)))


def strengthened(strength: Column, days: Column) -> Column:
    e = F.exp(-F.greatest(days, F.lit(0.0)))
    return strength + (1 - e) / (1 + e)


def success_bonus(n: Column) -> Column:
    return F.when(n <= 0, 0.0).otherwise(F.least(F.lit(0.2), 0.1 * F.log2(n + 1)))


def provenance_bonus(p: Column) -> Column:
    return F.when(p == "structural", 0.05).when(p == "observed", 0.02).otherwise(0.0)


STABLE_KINDS, CURATED_TAGS = ("constraint", "architecture", "decision"), ("seed", "community", "synthesized")


def decays(kind: Column, tags: Column) -> Column:
    return ~kind.isin(*STABLE_KINDS) & ~F.arrays_overlap(tags, F.array(*map(F.lit, CURATED_TAGS)))


def effectiveness(c: Column, n: Column) -> Column:
    return F.when(n <= 0, 1.0).otherwise(c / n)


def rank_score(similarity: Column, fact: dict[str, Column], now: float) -> Column:
    """Recall-weighted similarity times confidence, plus success and provenance bonuses.

    ``fact``: kind, tags, confidence, success_count, provenance, last_recall_ts, created_at, g_n, effectiveness_c, effectiveness_n.
    """
    fluid = decays(fact["kind"], fact["tags"])
    since = F.coalesce(fact["last_recall_ts"], fact["created_at"])
    days = F.greatest(F.lit(0.0), (F.lit(now) - since) / DAY)
    recall = F.when(fluid, recall_probability(similarity, days, fact["g_n"])).otherwise(similarity)
    eff = F.when(fluid, effectiveness(fact["effectiveness_c"], fact["effectiveness_n"])).otherwise(1.0)
    return recall * fact["confidence"] + success_bonus(fact["success_count"]) * eff + provenance_bonus(fact["provenance"])
