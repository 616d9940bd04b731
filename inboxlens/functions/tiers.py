"""Engagement tiers from the open rate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inboxlens.schemas import HIGH_THRESHOLD, LOW_THRESHOLD, MEDIUM_THRESHOLD, TIER_NAMES, TIER_ORDER


def engagement_tier(open_rate: Column | str = "open_rate") -> Column:
    """high >= 80, medium [50, 80), low [1, 50), zero == 0; rates in (0, 1) get no tier."""
    r = F.col(open_rate) if isinstance(open_rate, str) else open_rate
    return (F.when(r >= HIGH_THRESHOLD, F.lit("high"))
             .when(r >= MEDIUM_THRESHOLD, F.lit("medium"))
             .when(r >= LOW_THRESHOLD, F.lit("low"))
             .when(r == 0, F.lit("zero")))


def tier_name(tier: Column | str = "tier") -> Column:
    t = F.col(tier) if isinstance(tier, str) else tier
    out = F.lit(None).cast("string")
    for key in reversed(TIER_ORDER):
        out = F.when(t == key, F.lit(TIER_NAMES[key])).otherwise(out)
    return out


def tier_rank(tier: Column | str = "tier") -> Column:
    """Report order of a tier: high 1, medium 2, low 3, zero 4."""
    t = F.col(tier) if isinstance(tier, str) else tier
    out = F.lit(None).cast("int")
    for i, key in reversed(list(enumerate(TIER_ORDER, 1))):
        out = F.when(t == key, F.lit(i)).otherwise(out)
    return out
