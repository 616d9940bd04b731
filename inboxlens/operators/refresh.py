"""Keeping the cached message snapshot fresh: staleness, fetch plan, upsert, prune.

All steps are equi-joins on ``id`` (shuffle hash / sort-merge on both sides);
nothing is collected. The fetch itself (a network call) is outside Spark: its
output is the ``fetched`` DataFrame given to :func:`upsert`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inboxlens.functions.dates import is_stale, iso_timestamp
from inboxlens.schemas import CACHE, DEFAULT_CACHE_TTL_DAYS


def with_staleness(cache: DataFrame, ttl_days: int = DEFAULT_CACHE_TTL_DAYS, as_of=None) -> DataFrame:
    """Adds ``stale``: no stamp, unreadable stamp, or at least ``ttl_days`` whole days old."""
    return cache.withColumn("stale", is_stale("fetched_at", ttl_days, as_of))


def fetch_plan(listing: DataFrame, cache: DataFrame, refresh: bool = False,
               ttl_days: int = DEFAULT_CACHE_TTL_DAYS, as_of=None) -> DataFrame:
    """Listed ids to (re)fetch: not cached, stale, or everything when ``refresh``.

    A left outer join of the listing to the cache's ``(id, fetched_at)``; the
    response payload is pruned away before the shuffle.
    """
    c = cache.select("id", F.col("fetched_at").alias("_fetched_at"), F.lit(True).alias("_cached"))
    j = listing.select("id").join(c, "id", "left")
    need = (F.col("_cached").isNull() | F.lit(bool(refresh))
            | is_stale("_fetched_at", ttl_days, as_of))
    return j.where(need).select(
        "id", F.when(F.col("_cached").isNull(), F.lit("missing"))
               .when(F.lit(bool(refresh)), F.lit("refresh")).otherwise(F.lit("stale")).alias("reason"))


def latest_per_id(fetched: DataFrame) -> DataFrame:
    """One row per id: the newest ``fetched_at`` wins (ties: larger stamp text, then row content)."""
    cols_all = [f.name for f in CACHE.fields if f.name != "id"]
    # ties on the stamp fall back to the stamp text, then to a hash of the row, so the pick is deterministic
    key = F.struct(F.coalesce(F.unix_micros(iso_timestamp("fetched_at")), F.lit(-(2 ** 62))).alias("t"),
                   F.coalesce(F.col("fetched_at"), F.lit("")).alias("s"),
                   F.xxhash64(*cols_all).alias("h"))
    cols = [f.name for f in CACHE.fields if f.name != "id"]
    # max_by is an ordinary aggregate: partial per partition, so a hot id never lands whole in one task
    best = fetched.groupBy("id").agg(F.max_by(F.struct(*cols), key).alias("_row"))
    return best.select("id", *[F.col("_row")[c].alias(c) for c in cols])


def _stamp(alias: str):
    return F.coalesce(F.unix_micros(iso_timestamp("fetched_at")), F.lit(-(2 ** 62))).alias(alias)


def changes(cache: DataFrame, fetched: DataFrame) -> DataFrame:
    """The cache after ``fetched`` came in, each row with what became of it: ``added``, ``replaced`` or ``kept``.

    One full outer join on ``id``: both sides are read and shuffled once, bodies and all. The newer fetch of an id wins,
    whichever side holds it (``fetched`` on equal stamps), so a delivery that arrives late cannot undo a newer one. A
    message whose fetch failed (absent from ``fetched``) keeps its old, possibly stale copy. The join leaves the rows
    partitioned by id for what follows on the same key.
    """
    cols = [f.name for f in CACHE.fields]
    body = F.struct(*cols[1:])
    c = cache.select(*cols).select("id", body.alias("_old"), _stamp("_c"))
    f = latest_per_id(fetched.select(*cols)).select("id", body.alias("_new"), _stamp("_f"))
    taken = F.col("_f").isNotNull() & (F.col("_c").isNull() | (F.col("_f") >= F.col("_c")))
    change = F.when(~taken, "kept").when(F.col("_c").isNull(), "added").otherwise("replaced")
    row = F.when(taken, F.col("_new")).otherwise(F.col("_old"))
    joined = c.join(f, "id", "full_outer").select("id", row.alias("_row"), change.alias("change"))
    return joined.select("id", *[F.col("_row")[x].alias(x) for x in cols[1:]], "change")


def upsert(cache: DataFrame, fetched: DataFrame) -> DataFrame:
    """Replace or add every fetched message; other cached rows stay as they are (see :func:`changes`)."""
    return changes(cache, fetched).drop("change")


def newer(new: DataFrame, old: DataFrame) -> DataFrame:
    """The rows of ``new`` (an id once) that ``old`` has no newer copy of; of ``old`` only ids and stamps are needed."""
    cols = [f.name for f in CACHE.fields]
    held = old.select("id", _stamp("_c"))
    return (new.select(*cols).withColumn("_f", _stamp("_f")).join(held, "id", "left")
            .where(F.col("_c").isNull() | (F.col("_f") >= F.col("_c"))).select(*cols))


def prune(cache: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(kept, removed)``: cached messages still listed, and those no longer listed."""
    ids = listing.select("id")
    return cache.join(ids, "id", "left_semi"), cache.join(ids, "id", "left_anti")


def stale_entries(cache: DataFrame, ttl_days: int = DEFAULT_CACHE_TTL_DAYS, as_of=None) -> DataFrame:
    return with_staleness(cache, ttl_days, as_of).select("id", "fetched_at", "stale")


__all__ = ["with_staleness", "fetch_plan", "latest_per_id", "changes", "upsert", "newer", "prune", "stale_entries"]
