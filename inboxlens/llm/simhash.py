"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. Of two fingerprints that differ in at most two bits, one half differs in at
most one bit. So each half is indexed with every single bit of it left out (a one-wildcard variant), equal variants are
joined, and the pairs are verified on all 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_strays, materialize, slices
from .graph import components

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
#: Variants shared by more fingerprints than this are not paired but indexed again on the other half.
PAIRED = 64
_HALF = (1 << 32) - 1


def text_fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    norm = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return digest(norm, SEED)
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    starts = [0, *(gaps[:len(tokens) - words] + 1).tolist()]
    stops = [*gaps[words - 1:].tolist(), len(norm)]
    bits = np.zeros(64, np.int64)
    for i in range(0, len(starts), 1 << 16):
        h = np.array([digest(norm[a:b], SEED) for a, b in zip(starts[i:i + (1 << 16)], stops[i:i + (1 << 16)])], "<u8")
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << int(k) for k in np.flatnonzero(2 * bits > len(starts)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fp)`` for every row of ``docs``: the fingerprint as a signed 64-bit number.

    Text: A-Z in lower case, cut at white space into words, shingles of ``words`` words with repeats; a bit is 1 if it
    is set in over half of their XXH64. Fewer words make one shingle; null, empty and blank texts have fingerprint 0.
    """
    def work(batches):
        for whole in batches:
            for b in slices(whole, 1):
                fps = np.array([text_fingerprint(x, words) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    rows = drop_strays(docs, id_col, text_col).toDF("doc_id", "text")
    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _half(fp: Column, which: Column) -> Column:
    """Half 0 (low bits) or 1 (high bits) of a fingerprint, 0 to 2**32 - 1."""
    return F.when(which == 0, fp.bitwiseAND(F.lit(_HALF))).otherwise(F.shiftrightunsigned(fp, 32))


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))


def _variants(fps: DataFrame) -> DataFrame:
    """(fp, key, kind): for each half its own value (kind 64 + half), then with each bit left out (half * 32 + bit)."""
    one = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("kind"))
    half = _half(F.col("fp"), F.when(F.col("kind") >= 64, F.col("kind") - 64).otherwise(F.floor(F.col("kind") / 32)))
    left_out = F.when(F.col("kind") < 64, _bit(F.col("kind") % 32)).otherwise(F.lit(0))
    return one.select("fp", F.col("kind").cast("byte").alias("kind"),
                      half.bitwiseAND(F.bitwise_not(left_out)).alias("key"))


def links(fps: DataFrame, paired: int = PAIRED) -> DataFrame:
    """Links (u, v) of distinct fingerprints ``fp`` that connect all that differ in at most two bits, verified.

    Every two fingerprints of distance 2 or less are in the result or joined by a chain of verified links. An equal
    half with two more bits, or one bit in each half, are found from the variants. Pairs are only made within variants
    of at most ``paired`` members; a larger variant is indexed again with one or two bits of the other half left out,
    which leaves groups of four at most. So rows stay in proportion to the fingerprints, whatever they look like.
    """
    # One shuffle of narrow rows; variants of a single fingerprint end here.
    alike = W.partitionBy("kind", "key")
    members = _variants(fps).withColumn("n", F.count(F.lit(1)).over(alike)).where("n > 1")
    members = materialize(members.select("kind", "key", "n", "fp"), "variants")
    two = members.where("n = 2").groupBy("kind", "key").agg(F.min("fp").alias("u"), F.max("fp").alias("v"))
    two, members = two.select("u", "v"), members.where("n > 2")
    few = members.where(F.col("n") <= paired)
    few = few.withColumn("one", F.col("fp").bitwiseAND(F.when(F.col("kind") < 64, _bit(F.col("kind")))
                                                       .otherwise(F.lit(0))) != 0)
    a, b = few.alias("a"), few.alias("b")
    # In a one-wildcard variant only members with the bit meet members without it; the equal half has its own key.
    meet = ((F.col("a.kind") >= 64) & (F.col("a.fp") < F.col("b.fp"))) | (
        (F.col("a.kind") < 64) & F.col("a.one") & ~F.col("b.one"))
    pairs = a.join(b, (F.col("a.kind") == F.col("b.kind")) & (F.col("a.key") == F.col("b.key")) & meet).select(
        F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    many = members.where(F.col("n") > paired)
    other = _half(F.col("fp"), F.when(F.col("kind") >= 64, F.lit(65) - F.col("kind")).otherwise(
        F.lit(1) - F.floor(F.col("kind") / 32)))
    masks = F.when(F.col("kind") >= 64, F.flatten(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.transform(
        F.sequence(F.lit(0), i), lambda j: _bit(i).bitwiseOR(_bit(j)))))).otherwise(
        F.transform(F.sequence(F.lit(0), F.lit(31)), _bit))
    deeper = many.select("kind", "key", "fp", other.alias("other"), F.explode(masks).alias("mask"))
    small = deeper.select("kind", "key", "mask", F.col("other").bitwiseAND(F.bitwise_not("mask")).alias("rest"), "fp")
    groups = small.groupBy("kind", "key", "mask", "rest").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    chained = groups.select(F.explode(F.flatten(F.transform("fps", lambda x: F.transform(
        F.filter("fps", lambda y: y > x), lambda y: F.struct(x.alias("u"), y.alias("v")))))).alias("p")).select("p.*")
    found = two.unionByName(pairs).unionByName(chained)
    return found.where((F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                    words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row for each row of ``docs``.

    Documents whose fingerprints differ in at most two bits are linked; the component id is the smallest id that can be
    reached. Equal fingerprints are one node, so copies cost no links. A null id stays null and never is a component
    id, unless all ids of the component are null. Rows may repeat; an empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    roots = components(links(nodes.select("fp")))
    named = roots.join(nodes.withColumnRenamed("fp", "node"), "node").select("root", "least")
    named = named.unionByName(roots.select("root").distinct().join(nodes.withColumnRenamed("fp", "root"), "root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).join(least, "root")
    of = nodes.join(of.select(F.col("node").alias("fp"), "component_id"), "fp", "left").select(
        "fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")
