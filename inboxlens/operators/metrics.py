"""Whole-table metrics over the sender table: one-row summaries and shares.

Each summary is a global aggregate (partial per partition, one tiny final
merge). One-row frames are combined with cross joins of one-row sides, which
Spark broadcasts: their size is fixed at one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inboxlens.functions.numbers import percentage
from inboxlens.functions.tiers import engagement_tier, tier_name, tier_rank
from inboxlens.schemas import EMAIL_CATEGORIES, HEALTH_BANDS


def overall_metrics(senders: DataFrame) -> DataFrame:
    """One row: totals, unread share, mean open rate (unweighted), never-opened, top score.

    An empty table gives zeros, not nulls.
    """
    a = senders.agg(
        F.count(F.lit(1)).alias("total_senders"),
        F.sum("total_volume").alias("_total"),
        F.sum("unread_count").alias("_unread"),
        F.avg("open_rate").alias("_avg_open"),
        F.count_if(F.col("open_rate") == 0).alias("senders_never_opened"),
        F.max(F.col("ignorance_score").cast("double")).alias("_top"),
    )
    return a.select(
        "total_senders",
        F.coalesce(F.col("_total"), F.lit(0)).cast("long").alias("total_emails"),
        percentage("_unread", "_total").alias("unread_percentage"),
        F.coalesce(F.col("_avg_open"), F.lit(0.0)).alias("average_open_rate"),
        F.col("senders_never_opened").cast("long").alias("senders_never_opened"),
        F.coalesce(F.col("_top"), F.lit(0.0)).alias("top_ignorance_score"),
    )


def distribution_summary(senders: DataFrame) -> DataFrame:
    """One row: volume held by the top 10 by volume, the top 10 by score,
    zero-open senders and senders above 50 e-mails, with shares of all mail."""
    totals = senders.agg(
        F.coalesce(F.sum("total_volume"), F.lit(0)).cast("long").alias("total_emails"),
        F.count_if(F.col("open_rate") == 0).alias("zero_open_senders"),
        F.coalesce(F.sum(F.when(F.col("open_rate") == 0, F.col("total_volume"))), F.lit(0)).cast("long")
         .alias("zero_open_emails"),
        F.count_if(F.col("total_volume") > 50).alias("high_volume_senders"),
        F.coalesce(F.sum(F.when(F.col("total_volume") > 50, F.col("total_volume"))), F.lit(0)).cast("long")
         .alias("high_volume_emails"),
    )
    top_vol = (senders.orderBy(F.col("total_volume").desc(), F.col("from")).limit(10)
               .agg(F.coalesce(F.sum("total_volume"), F.lit(0)).cast("long").alias("top10_volume_emails")))
    top_noise = (senders.orderBy(F.col("ignorance_score").desc_nulls_last(), F.col("from")).limit(10)
                 .agg(F.coalesce(F.sum("total_volume"), F.lit(0)).cast("long").alias("top10_noise_emails")))
    row = totals.crossJoin(top_vol).crossJoin(top_noise)
    t = F.col("total_emails")
    return row.select(
        "total_emails",
        "top10_volume_emails", percentage("top10_volume_emails", t).alias("top10_volume_pct"),
        "top10_noise_emails", percentage("top10_noise_emails", t).alias("top10_noise_pct"),
        F.col("zero_open_senders").cast("long").alias("zero_open_senders"), "zero_open_emails",
        percentage("zero_open_emails", t).alias("zero_open_pct"),
        F.col("high_volume_senders").cast("long").alias("high_volume_senders"), "high_volume_emails",
        percentage("high_volume_emails", t).alias("high_volume_pct"),
    )


def tier_overview(senders: DataFrame) -> DataFrame:
    """Per non-empty tier: senders, e-mails, share of all e-mail, mean open rate.

    Rows come in tier order high, medium, low, zero (column ``tier_rank``).
    """
    # one pass: senders without a tier form a group of their own, which counts in the total only
    per = (senders.withColumn("tier", engagement_tier("open_rate"))
           .groupBy("tier").agg(F.count(F.lit(1)).alias("senders"),
                                F.sum("total_volume").cast("long").alias("emails"),
                                F.avg("open_rate").alias("avg_open_rate")))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # five rows at most
    return (per.withColumn("_all", F.sum("emails").over(whole)).where(F.col("tier").isNotNull())
            .select("tier", tier_name("tier").alias("tier_name"), tier_rank("tier").alias("tier_rank"),
                    F.col("senders").cast("long").alias("senders"), "emails",
                    percentage("emails", "_all").alias("share_pct"), "avg_open_rate")
            .orderBy("tier_rank"))


def category_distribution(senders: DataFrame) -> DataFrame:
    """Totals of the updates / promotions / social / important counts with their
    share of all e-mail; categories with no e-mail are left out."""
    sums = senders.agg(
        F.coalesce(F.sum("total_volume"), F.lit(0)).cast("long").alias("_all"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in EMAIL_CATEGORIES])
    stack = ", ".join(f"{i}, '{c.replace('_count', '').title()}', `{c}`" for i, c in enumerate(EMAIL_CATEGORIES, 1))
    long = sums.selectExpr("_all", f"stack({len(EMAIL_CATEGORIES)}, {stack}) as (category_rank, category, emails)")
    return (long.where(F.col("emails") > 0)
            .select(F.col("category_rank").cast("int").alias("category_rank"), "category",
                    F.col("emails").cast("long").alias("emails"), percentage("emails", "_all").alias("share_pct"))
            .orderBy("category_rank"))


def compare_metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change between two :func:`overall_metrics` rows.

    The relative score drop is null when the earlier top score is 0.
    """
    b = before.select(*[F.col(c).alias(f"b_{c}") for c in before.columns])
    a = after.select(*[F.col(c).alias(f"a_{c}") for c in after.columns])
    j = b.crossJoin(a)
    drop = F.col("b_top_ignorance_score") - F.col("a_top_ignorance_score")
    return j.select(
        (F.col("b_unread_percentage") - F.col("a_unread_percentage")).alias("unread_improvement"),
        drop.alias("top_score_reduction"),
        (F.try_divide(drop, F.col("b_top_ignorance_score")) * F.lit(100.0)).alias("top_score_reduction_pct"),
        (F.col("a_average_open_rate") - F.col("b_average_open_rate")).alias("open_rate_improvement"),
    )


def health_score(metrics: DataFrame) -> DataFrame:
    """``open_rate * 0.5 + (100 - unread_rate) * 0.5`` and its band name."""
    score = F.col("average_open_rate") * 0.5 + (F.lit(100.0) - F.col("unread_percentage")) * 0.5
    band = F.lit(None).cast("string")
    for lower, name in reversed(HEALTH_BANDS):
        band = F.when(score >= lower, F.lit(name)).otherwise(band)
    return metrics.select(score.alias("health_score"), band.alias("health_band"))


def success_bands(senders: DataFrame) -> DataFrame:
    """Unread rate, zero-engagement share and high-engagement share of senders,
    each with its band (null between the named bands)."""
    t = senders.withColumn("tier", engagement_tier("open_rate"))
    a = t.agg(F.sum("total_volume").alias("_all"), F.sum("unread_count").alias("_unread"),
              F.count(F.lit(1)).alias("_n"), F.count_if(F.col("tier") == "zero").alias("_zero"),
              F.count_if(F.col("tier") == "high").alias("_high"))
    unread = percentage("_unread", "_all")
    zero = percentage("_zero", "_n")
    high = percentage("_high", "_n")
    return a.select(
        unread.alias("unread_rate"),
        F.when(unread < 5, "Excellent").when(unread < 10, "Good").when(unread > 20, "Needs attention")
         .alias("unread_band"),
        zero.alias("zero_engagement_share"),
        F.when(zero < 2, "Excellent").when(zero < 5, "Good").when(zero > 10, "Problematic")
         .alias("zero_engagement_band"),
        high.alias("high_engagement_share"),
        F.when(high > 90, "Excellent").when(high > 80, "Good").alias("high_engagement_band"),
    )


__all__ = ["overall_metrics", "distribution_summary", "tier_overview", "category_distribution",
           "compare_metrics", "health_score", "success_bands"]
