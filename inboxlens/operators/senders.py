"""Per-sender aggregation, tiers, look-ups and rankings over the sender table.

Rankings get a total order: the named metric, then ``from`` ascending, so
ties never depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inboxlens.functions.tiers import engagement_tier, tier_name
from inboxlens.schemas import SENDERS

SUMMARY_COLUMNS = ["from", "total_volume", "open_rate", "avg_recency_days", "ignorance_score"]


def _by(metric: str) -> list[Column]:
    return [F.col(metric).desc_nulls_last(), F.col("from").asc()]


def aggregate_and_score(messages: DataFrame, weight: str | None = None) -> DataFrame:
    """Sender table from message rows (the audit's core aggregation).

    Undated messages are left out. Group key is the raw ``from`` header.
    ``open_rate = (total - unread) / total * 100`` and
    ``ignorance_score = total * (100 - open_rate)``. ``weight`` names an
    optional count column: a row then stands for that many identical
    messages (e.g. an id listed several times), so nothing is replicated.

    Every aggregate is algebraic, so Spark runs a partial aggregate before the
    shuffle on ``from``: a sender holding a third of all mail costs one
    partial row per input partition, not a third of the data in one task.
    """
    # "dated messages only" is folded into the aggregates (and a total > 0
    # check after grouping) rather than a filter below them: a pushed-down
    # filter would repeat the whole date-parsing expression in its condition.
    dated = F.col("age_days").isNotNull()
    flags = ("unread", "starred", "important", "social", "updates", "promotions")
    src = messages.where(F.col("from").isNotNull())
    if weight is None:
        aggs = [F.count(F.when(dated, F.col("id"))).alias("total_volume"),
                *[F.count_if(dated & F.col(f)).alias(f"{f}_count") for f in flags],
                F.avg(F.col("age_days").cast("double")).alias("avg_recency_days")]
    else:
        w = F.col(weight).cast("long")
        n = F.sum(F.when(dated & F.col("id").isNotNull(), w)).cast("long")
        aggs = [F.coalesce(n, F.lit(0)).alias("total_volume"),
                *[F.coalesce(F.sum(F.when(dated & F.col(f), w)), F.lit(0)).cast("long").alias(f"{f}_count")
                  for f in flags],
                F.try_divide(F.sum(F.col("age_days") * w).cast("double"),
                             F.sum(F.when(dated, w)).cast("double")).alias("avg_recency_days")]
    agg = src.groupBy("from").agg(*aggs).where(F.col("total_volume") > 0)
    total = F.col("total_volume").cast("double")
    open_rate = F.try_divide(total - F.col("unread_count"), total) * F.lit(100.0)
    scored = (agg.withColumn("open_rate", open_rate)
                 .withColumn("ignorance_score", total * (F.lit(100.0) - F.col("open_rate"))))
    # unordered: rankings and writers sort where an order is wanted
    return scored.select(*SENDERS.fieldNames())


_FLAGS = ("unread", "starred", "important", "social", "updates", "promotions")


def sender_counts(messages: DataFrame, *keys: str) -> DataFrame:
    """Counts that can be added up: per ``keys`` and sender the dated messages, their flags, and the sum of ages."""
    dated = F.col("age_days").isNotNull()
    return messages.where(F.col("from").isNotNull()).groupBy(*keys, "from").agg(
        F.count(F.when(dated, F.col("id"))).alias("total_volume"),
        *[F.count_if(dated & F.col(f)).alias(f"{f}_count") for f in _FLAGS],
        F.sum(F.col("age_days").cast("long")).alias("age_sum"), F.count("age_days").alias("ages"))


def score_counts(counts: DataFrame) -> DataFrame:
    """The sender table from any number of :func:`sender_counts` parts."""
    sums = counts.groupBy("from").agg(*[F.sum(c).alias(c) for c in (
        "total_volume", *(f"{f}_count" for f in _FLAGS), "age_sum", "ages")]).where(F.col("total_volume") > 0)
    total = F.col("total_volume").cast("double")
    sums = sums.withColumn("avg_recency_days", F.try_divide(F.col("age_sum").cast("double"), F.col("ages").cast("double")))
    sums = sums.withColumn("open_rate", F.try_divide(total - F.col("unread_count"), total) * F.lit(100.0))
    return sums.withColumn("ignorance_score", total * (F.lit(100.0) - F.col("open_rate"))).select(*SENDERS.fieldNames())


def with_tier(senders: DataFrame) -> DataFrame:
    """Adds ``tier`` (high/medium/low/zero, null for open rates in (0, 1))."""
    return senders.withColumn("tier", engagement_tier("open_rate"))


def engagement_tiers(senders: DataFrame) -> DataFrame:
    """``(from, open_rate, tier, tier_name)`` for every sender."""
    t = with_tier(senders)
    return t.select("from", "open_rate", "tier", tier_name("tier").alias("tier_name"))


def top_noise_makers(senders: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` highest ignorance scores (TakeOrderedAndProject: per-partition top-n)."""
    return senders.orderBy(*_by("ignorance_score")).limit(n)


def audit_summary(senders: DataFrame, n: int = 10) -> DataFrame:
    """The audit's closing table: top ``n`` noise makers, five columns."""
    return top_noise_makers(senders, n).select(*SUMMARY_COLUMNS)


def sort_by_score(senders: DataFrame) -> DataFrame:
    return senders.orderBy(*_by("ignorance_score"))


# --- filters on the sender table --------------------------------------------

def never_opened(senders: DataFrame) -> DataFrame:
    return senders.where(F.col("open_rate") == 0)


def over_volume(senders: DataFrame, more_than: int = 50) -> DataFrame:
    return senders.where(F.col("total_volume") > more_than)


def high_volume(senders: DataFrame, at_least: int = 20, low_engagement_only: bool = False) -> DataFrame:
    cond = F.col("total_volume") >= at_least
    if low_engagement_only:
        cond = cond & (F.col("open_rate") < 50)
    return senders.where(cond)


def _filters() -> dict:
    return {
        "never_opened": F.col("open_rate") == 0,
        "over_50": F.col("total_volume") > 50,
        "at_least_20": F.col("total_volume") >= 20,
        "at_least_20_low_open": (F.col("total_volume") >= 20) & (F.col("open_rate") < 50),
    }


def filter_matches(senders: DataFrame) -> DataFrame:
    """Every (sender, filter) pair a sender passes, in one scan of the table."""
    names = F.array(*[F.when(c, F.lit(name)) for name, c in _filters().items()])
    return (senders.select("from", "total_volume", "open_rate",
                           F.explode(F.filter(names, lambda x: x.isNotNull())).alias("filter")))


# --- ranked recommendations ---------------------------------------------------

def unsubscribe_candidates(senders: DataFrame, n: int = 5) -> DataFrame:
    """Never-opened senders, largest volume first."""
    return never_opened(senders).orderBy(*_by("total_volume")).limit(n)


def review_candidates(senders: DataFrame, n: int = 5, low_engagement_only: bool = False) -> DataFrame:
    """Senders with at least 20 e-mails by score (optionally only open rate < 50)."""
    return high_volume(senders, 20, low_engagement_only).orderBy(*_by("ignorance_score")).limit(n)


def top_engaged(senders: DataFrame, n: int = 3) -> DataFrame:
    """Largest high-tier senders."""
    return with_tier(senders).where(F.col("tier") == "high").orderBy(*_by("total_volume")).limit(n)


def tier_listing(senders: DataFrame, tier: str) -> DataFrame:
    """Every sender of one tier by volume; an unknown tier is an error."""
    if tier not in ("high", "medium", "low", "zero"):
        raise ValueError(f"no such engagement tier: {tier!r}; known are high, medium, low and zero")
    return (with_tier(senders).where(F.col("tier") == tier)
            .select("from", "total_volume", "open_rate", "tier", tier_name("tier").alias("tier_name"))
            .orderBy(*_by("total_volume")))


def sender_lookup(senders: DataFrame, pattern: str, literal: bool = False) -> DataFrame:
    """The first sender, in score order, whose address matches ``pattern``.

    ``pattern`` is a regular expression that ignores case in all scripts
    (``literal=True``: a plain substring). Returns zero or one row.
    """
    addr = F.col("from")
    cond = (F.contains(F.lower(addr), F.lit(pattern.lower())) if literal
            else addr.rlike("(?iu)" + pattern))
    hit = senders.where(F.coalesce(cond, F.lit(False))).orderBy(*_by("ignorance_score")).limit(1)
    return hit.select(F.col("from").alias("sender"), F.col("total_volume").alias("total_emails"),
                      "open_rate", "ignorance_score", "unread_count")


def top_senders_for_patterns(senders: DataFrame, n: int = 5, by: str = "volume") -> DataFrame:
    """The ``n`` senders whose content gets analysed, by ``total_volume`` or ``ignorance``.

    As any top-n, the ``n`` rows end in one task, which numbers them; ``n`` is the length of a report.
    """
    if by not in ("volume", "ignorance"):
        raise ValueError("by must be 'volume' or 'ignorance'")
    metric = "total_volume" if by == "volume" else "ignorance_score"
    w = Window.orderBy(*_by(metric))
    # rank kept so downstream reports can order by it
    return (senders.orderBy(*_by(metric)).limit(n)
            .withColumn("rank", F.row_number().over(w)))


__all__ = [
    "aggregate_and_score", "sender_counts", "score_counts", "with_tier", "engagement_tiers", "top_noise_makers", "audit_summary",
    "sort_by_score", "never_opened", "over_volume", "high_volume", "filter_matches",
    "unsubscribe_candidates", "review_candidates", "top_engaged", "tier_listing", "sender_lookup",
    "top_senders_for_patterns",
]
