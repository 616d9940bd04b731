"""Exact deduplication by content-defined chunk recipes.

A normalised text is cut where a rolling hash of its bytes says so. Its recipe is the ordered list of its chunks'
identifiers. Each different chunk moves through one shuffle, where its identifier is verified against the bytes;
after that only recipes are compared, and long documents don't move again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_strays, materialize, slices

#: Rolling hash over 16 bytes; a cut where its upper CUT_BITS bits are 0, MIN_CHUNK to MAX_CHUNK bytes apart.
CUT_BITS, MIN_CHUNK, MAX_CHUNK = 11, 256, 16384
_WINDOW = 16
#: Identifiers of chunks, tried in this order until no two different chunks share one.
DIGESTS = (xxhash.xxh3_128_digest, lambda b: hashlib.sha256(b).digest(), lambda b: hashlib.blake2b(b).digest())


def normalised(text: Column) -> Column:
    """White space runs as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _gear() -> np.ndarray:
    """A pseudo-random 32-bit number for each byte."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


def cuts(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[list[int]]:
    """For each text (bytes start to stop of ``data``) the ends of its chunks; an empty text has none."""
    h = _gear()[data]
    width = 1
    while width < _WINDOW:
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width)
        h, width = wider, 2 * width
    marks = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
    lows = np.searchsorted(marks, starts + max(_WINDOW, MIN_CHUNK))
    highs = np.searchsorted(marks, stops)
    out = []
    for start, stop, low, high in zip(starts.tolist(), stops.tolist(), lows.tolist(), highs.tolist()):
        ends, last = [], start
        for m in marks[low:high].tolist():
            while m - last > MAX_CHUNK:
                last += MAX_CHUNK
                ends.append(last)
            if m - last >= MIN_CHUNK:
                ends.append(m)
                last = m
        while stop - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if stop > last:
            ends.append(stop)
        out.append(ends)
    return out


def recipes(rows: DataFrame, digest=DIGESTS[0]) -> DataFrame:
    """``(doc_id, sha256, recipe, chunks)`` for rows (doc_id, text as bytes).

    recipe: the identifiers one after the other; chunks: (h, b), each chunk that the rows before it in the same few
    megabytes of input don't have.
    """
    def work(batches):
        for whole in batches:
            for b in slices(whole, 1):
                texts = [x or b"" for x in b.column(1).to_pylist()]
                stops = np.cumsum([len(x) for x in texts])
                starts = np.concatenate([[0], stops[:-1]])
                ends = cuts(np.frombuffer(b"".join(texts), np.uint8), starts, stops)
                seen, lists, offsets, names, bodies = {}, [], [0], [], []
                for text, start, own in zip(texts, starts.tolist(), ends):
                    last, ids = 0, []
                    for end in own:
                        body = text[last:end - start]
                        last = end - start
                        ids.append(h := digest(body))
                        if seen.setdefault(h, body) is body or seen[h] != body:
                            names.append(h)
                            bodies.append(body)
                    lists.append(b"".join(ids))
                    offsets.append(len(names))
                chunks = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(names, pa.binary()), pa.array(bodies, pa.binary())], names=["h", "b"]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
                     pa.array(lists, pa.binary()), chunks], names=["doc_id", "sha256", "recipe", "chunks"])

    made = T.StructType([rows.schema["doc_id"], T.StructField("sha256", T.StringType()),
                         T.StructField("recipe", T.BinaryType()), T.StructField("chunks", T.ArrayType(T.StructType([
                             T.StructField("h", T.BinaryType()), T.StructField("b", T.BinaryType())])))])
    return rows.mapInArrow(work, made)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, digests=DIGESTS) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, sha256)``, one row for each row of ``docs``.

    Texts are equal when they are the same after every run of white space is one space; null counts as empty. Of
    equal texts the smallest id stays; null ids stay only if their texts have no other id. Rows that share id and text
    are all kept or all dropped. An empty table gives no rows. Should two different chunks share an identifier, all is
    done again with a longer one.
    """
    rows = drop_strays(docs, id_col, text_col).toDF("doc_id", "text")
    rows = rows.select("doc_id", normalised(F.col("text")).cast("binary").alias("text"))
    for digest in digests:
        made = materialize(recipes(rows, digest), "recipes")
        store = made.select(F.explode("chunks").alias("c")).select("c.h", "c.b").distinct()
        if store.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            break
    else:
        raise ValueError("two different chunks share every identifier")
    own = made.select("doc_id", "sha256", "recipe")
    classes = own.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return own.join(classes, "recipe").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "sha256")


def oracle_sql(relation: str = "documents") -> str:
    return rf"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from {relation})
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept,
  sha256(t) as text_sha256 from n window w as (partition by t)"""
