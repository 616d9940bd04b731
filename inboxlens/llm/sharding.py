"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records over buckets by a seeded hash (a shuffle writes them); the number of buckets follows from the
total size, so that a bucket fits into a task's memory. Pass 2 shuffles every bucket (Spark's ``shuffle`` is an
inside-out Fisher-Yates). The buckets in order are one uniformly shuffled sequence, which is cut into equal shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flagged, materialize, repeated

#: Bytes of records in a bucket, as ``size`` gives them.
BUCKET_BYTES = 16 << 20
#: 2**BLOCK_BITS buckets are added up together: a row for 64 GB then is all that meets in one task.
BLOCK_BITS = 12


def _offsets(counts: DataFrame) -> DataFrame:
    """(of, offset, total) from (bucket, n): rows before each bucket and in all, by sums of blocks, then inside of each."""
    counts = counts.withColumn("block", F.shiftright("bucket", BLOCK_BITS))
    before = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy("block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    blocks = counts.groupBy("block").agg(F.sum("n").alias("b")).select(
        "block", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("start"), F.sum("b").over(whole).alias("total"))
    inside = W.partitionBy("block").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("bucket", "block", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("inside"))
    return counts.join(blocks, "block").select(F.col("bucket").alias("of"), (F.col("start") + F.col("inside")).alias("offset"), "total")


def shard(records: DataFrame, shards: int, size: Column, *, seed: int = 42,
          bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The columns of ``records`` after shard (int), slot (long, gapless from 0 in each shard) and bucket (long).

    Shard sizes differ by one row at most (law ``rows``); with fewer rows than shards some stay empty. All columns
    travel, so give only those that the result needs; maps can't be among them. ``size`` (bytes of a record; null
    counts as 0) only sets the number of buckets. Rows are scattered where they are read. Only those whose hash is
    repeated (told by a bit map of bounded size) are counted first, and each copy is scattered by its number, so that
    copies spread like other rows however many they are. Nulls are values like any
    other. The result depends on the rows, the seed and the number of partitions, not on their order. Columns that are
    called shard, slot or bucket are replaced; an empty table gives no rows.
    """
    records = records.drop("shard", "slot", "bucket")
    names = records.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    total = records.agg(F.sum(size.cast("long")).alias("bytes")).first()["bytes"] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    rows = records.select(row.alias("row"))
    marks = materialize(repeated(rows.select(F.xxhash64("row").alias("h"))), "repeated-rows")
    rows = flagged(rows, F.xxhash64("row"), marks)
    copies = rows.where("often").groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    copies = copies.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    copies = rows.where(~F.col("often")).select("row", F.lit(1).cast("long").alias("copy")).unionByName(copies)
    bucket = F.pmod(F.xxhash64(F.lit(seed), "row", "copy"), F.lit(buckets))
    # Made twice rather than written: numbers of rows need no row to move, and the shuffle by bucket writes each once.
    scattered = copies.select(bucket.alias("bucket"), "copy", "row")
    counts = _offsets(scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")))
    mixed = scattered.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("row", "copy"))).alias("rows"))
    mixed = mixed.sortWithinPartitions("bucket").select("bucket", F.shuffle("rows", seed).alias("rows"))
    placed = mixed.select("bucket", F.posexplode("rows").alias("rank", "one"))
    placed = placed.join(counts, F.col("bucket") == F.col("of")).withColumn("place", F.col("offset") + F.col("rank"))
    of = F.expr(f"({shards} * (place + 1) - 1) div total")
    placed = placed.withColumn("shard", of.cast("int"))
    return placed.select("shard", (F.col("place") - F.expr(f"(shard * total) div {shards}")).alias("slot"), "bucket",
                         *[F.col(f"one.row.`{c}`").alias(c) for c in names])


def write_shards(records: DataFrame, path: str, shards: int, size: Column, **options) -> None:
    """Write whole records under ``path``, a folder ``shard=k`` each; ``slot`` gives the order within a shard."""
    shard(records, shards, size, **options).drop("bucket").write.partitionBy("shard").mode("overwrite").parquet(path)


def read_shards(spark, path: str, records: DataFrame) -> DataFrame:
    """What ``write_shards`` wrote of ``records``: their columns after shard and slot; no files give no rows."""
    columns = records.drop("shard", "slot", "bucket").schema.fields
    schema = T.StructType([T.StructField("slot", T.LongType()), *columns, T.StructField("shard", T.IntegerType())])
    return spark.read.schema(schema).parquet(path).select("shard", "slot", *[F.col(f"`{c.name}`") for c in columns])
