"""The message cache kept in buckets by id, so that refresh joins need no shuffle of it.

A bucketed table is hashed by id into a fixed number of files' worth of buckets and sorted inside of each. A join on id
reads it bucket by bucket: only the other side (a listing, a fetch plan, fetched rows) is shuffled, into as many
partitions. Two tables with as many buckets meet without any shuffle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inboxlens.session import shared_dir


def save_bucketed(rows: DataFrame, buckets: int, table: str | None = None, path: str | None = None) -> str:
    """Write ``rows`` (a column ``id``) as a table of ``buckets`` buckets sorted by id; gives the table's name.

    The rows are dealt out by id before they are written, so that each bucket is one file. Choose the number from the
    size of the cache (some 256 MB a bucket) and give the tables that it is to meet the same one. Without a ``path`` the
    files go to the shared folder; an existing table of that name is replaced.
    """
    spark = rows.sparkSession
    table = table or f"bucketed_{uuid.uuid4().hex[:12]}"
    # The hash by which buckets are told is that of repartition: one task writes one bucket.
    (rows.repartition(buckets, "id").write.mode("overwrite").option("path", path or shared_dir(spark, "bucketed"))
     .bucketBy(buckets, "id").sortBy("id").saveAsTable(table))
    return table


def load_bucketed(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.table(table)


def listing_state(listing: DataFrame, cache: DataFrame) -> DataFrame:
    """``(id, listed, cached, fetched_at)`` for every id of either side, in one full outer join.

    Inner, left, semi and anti joins of listing and cache are filters of it: ``listed and cached``, ``listed``,
    ``cached and listed``, ``cached and not listed``. A listing that holds an id several times gives it as often.
    """
    a = listing.select("id", F.lit(True).alias("_l"))
    b = cache.select("id", "fetched_at", F.lit(True).alias("_c"))
    j = a.join(b, "id", "full_outer")
    return j.select("id", F.coalesce("_l", F.lit(False)).alias("listed"), F.coalesce("_c", F.lit(False)).alias("cached"), "fetched_at")
