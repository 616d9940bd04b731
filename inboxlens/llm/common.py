"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inboxlens.session import materialize

__all__ = ["doc_bucket", "drop_strays", "documents", "flagged", "marked", "materialize", "repeated", "slices"]

#: Largest number of text bytes that Python code in a task works on at once (one longer text is one slice).
SLICE_BYTES = 8 << 20


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def doc_bucket(doc_id: Column, n: int) -> Column:
    """``crc32`` of the id written as text, modulo ``n``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def drop_strays(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, in this order: further columns of the input can then clash with nothing."""
    return df.select(*[F.col(f"`{n}`") for n in names])


#: Bits of the map of repeated hashes: what is broadcast are 2**FILTER_BITS / 64 rows of 16 bytes at most.
FILTER_BITS = 24


def repeated(hashes: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """(word, bits): a bit map of the hashes ``h`` that occur more than once; its size does not depend on the data."""
    return marked(hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), bits)


def marked(hashes: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """(word, bits): a bit map of all hashes ``h``."""
    slot = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    return hashes.select(F.shiftright(slot, 6).alias("word"), one.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def flagged(rows: DataFrame, h: Column, marks: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` with a column ``often``: false for no row whose hash ``h`` is among the ``marks`` of :func:`repeated` or :func:`marked`."""
    names = rows.columns
    slot = h.bitwiseAND(F.lit((1 << bits) - 1))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_slot").bitwiseAND(F.lit(63)).cast("int"))
    marks = marks.select(F.col("word").alias("_word"), F.col("bits").alias("_bits"))
    met = rows.withColumn("_slot", slot).withColumn("_at", F.shiftright("_slot", 6)).join(
        F.broadcast(marks), F.col("_at") == F.col("_word"), "left")
    return met.select(*[F.col(f"`{n}`") for n in names], F.coalesce(F.col("_bits").bitwiseAND(mask) != 0, F.lit(False)).alias("often"))


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of ``batch`` whose texts in ``column`` take about ``limit`` bytes at most."""
    if not batch.num_rows:
        return
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
