"""Shares of all mail: running shares over a ranking, and counts over tier, category and month.

A running sum over a whole ranking would put all rows into one task. Here it takes two passes instead: the ranking is cut
into ranges, each range is summed in its own task, and the sums of the ranges before are added to the running sums inside
of each. What meets in one task is a row for each range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inboxlens.functions.numbers import percentage
from inboxlens.functions.tiers import engagement_tier
from inboxlens.session import materialize


def running_shares(senders: DataFrame, metric: str = "total_volume", ranges: int | None = None) -> DataFrame:
    """``(from, metric, place, running, share_pct)``: senders ranked by ``metric`` (ties by address), and what those down
    to each hold together, as a sum and in percent of all.

    ``ranges`` is the number of ranges (the session's shuffle partitions if not given). A null metric counts as 0.
    """
    order = [F.desc("_m"), F.col("from").asc_nulls_first()]
    ranked = senders.select("from", F.coalesce(F.col(metric), F.lit(0)).alias("_m"))
    ranked = ranked.repartitionByRange(ranges, *order) if ranges else ranked.repartitionByRange(*order)
    # Written, so that both passes see the same ranges.
    parts = materialize(ranked.withColumn("_p", F.spark_partition_id()), "ranked-senders")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = parts.groupBy("_p").agg(F.sum("_m").alias("_s"), F.count(F.lit(1)).alias("_n"))
    starts = sums.select("_p", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"), F.sum("_s").over(whole).alias("_all"),
                         F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))
    inside = Window.partitionBy("_p").orderBy(*order)
    run = parts.withColumn("_run", F.sum("_m").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "_k", F.row_number().over(inside))
    run = run.join(F.broadcast(starts), "_p")              # a row for each range
    running = F.col("_s0") + F.col("_run")
    return run.select("from", F.col("_m").alias(metric), (F.col("_n0") + F.col("_k")).alias("place"), running.alias("running"),
                      percentage(running, "_all").alias("share_pct"))


def smallest_holders(senders: DataFrame, percent: float = 80.0, metric: str = "total_volume", ranges: int | None = None) -> DataFrame:
    """The fewest senders that together hold at least ``percent`` % of all mail: rows of :func:`running_shares`."""
    shares = running_shares(senders, metric, ranges)
    total = F.when(F.col("share_pct") > 0, F.col("running") / F.col("share_pct") * 100.0)
    ahead = F.coalesce((F.col("running") - F.col(metric)) / total * 100.0, F.lit(0.0))
    return shares.where((ahead < percent) & (F.col("running") > 0))


CATEGORIES = ("updates", "promotions", "social", "important")
#: The sets of dimensions counted, from all three to none.
SETS = (("tier", "category", "month"), ("tier", "category"), ("category", "month"), ("tier", "month"), ("tier",), ("category",), ())


def engagement_cube(messages: DataFrame) -> DataFrame:
    """``(tier, category, month, level, emails, unread, open_rate)`` for several sets of dimensions at once.

    ``messages`` has from, ts, age_days and the flags; undated ones are left out, as everywhere in the audit. ``level``
    tells the set: a bit is 1 for each of tier (4), category (2) and month (1) that is summed over. A message counts under
    each category it is in, and under ``any`` once. Senders whose open rate is in no tier have the tier ``none``. The
    messages are read once: counts per sender and month are all that is ranked into tiers and expanded into sets.
    """
    seen = messages.where(F.col("age_days").isNotNull() & F.col("from").isNotNull())
    per = seen.groupBy("from", F.date_format("ts", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("any"), F.count_if("unread").alias("any_unread"),
        *[F.count_if(c).alias(c) for c in CATEGORIES], *[F.count_if(F.col(c) & F.col("unread")).alias(f"{c}_unread") for c in CATEGORIES])
    whole = Window.partitionBy("from")                     # a row for each month
    rate = (F.sum("any").over(whole) - F.sum("any_unread").over(whole)) / F.sum("any").over(whole) * 100.0
    per = per.withColumn("tier", F.coalesce(engagement_tier(rate), F.lit("none")))
    names = ", ".join(f"'{c}', {c}, {c}_unread" for c in ("any", *CATEGORIES))
    long = per.selectExpr("tier", "month", f"stack({1 + len(CATEGORIES)}, {names}) as (category, n, n_unread)").where("n > 0")
    dims = [F.col(c) for c in ("tier", "category", "month")]
    cube = long.groupingSets([[F.col(c) for c in s] for s in SETS], *dims).agg(
        F.grouping_id().cast("int").alias("level"), F.sum("n").alias("emails"), F.sum("n_unread").alias("unread"))
    return cube.select("tier", "category", "month", "level", "emails", "unread",
                       (F.lit(100.0) - percentage("unread", "emails")).alias("open_rate"))


def totals(cube: DataFrame, *dimensions: str) -> DataFrame:
    """The rows of :func:`engagement_cube` for one of its sets of dimensions."""
    if tuple(dimensions) not in SETS:
        raise ValueError(f"no such set of dimensions: {dimensions}; known are {SETS}")
    bits = {"tier": 4, "category": 2, "month": 1}
    return cube.where(F.col("level") == reduce(lambda a, d: a - bits[d], dimensions, 7)).select(*dimensions, "emails", "unread", "open_rate")
