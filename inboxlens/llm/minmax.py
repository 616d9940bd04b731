"""Near-duplicates by min-max hashing.

Of every hash function both the smallest and the largest value over a document's shingles are kept, so that n values cost
n / 2 evaluations. Each value agrees in two sets with their Jaccard similarity as probability. Values are banded; sets
that agree in a whole band are candidates, and links are confirmed on the full sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_strays, flagged, marked, materialize, slices
from .graph import merged
from .words import cut

SHINGLE_WORDS = 2
#: Link at similarity NUMERATOR / DENOMINATOR or more.
NUMERATOR, DENOMINATOR = 80, 100
#: Values in a band, and the largest probability that a pair of just that similarity shares no band.
BAND_ROWS, MISS = 5, 1e-6
SEED = 42
#: Sets that the links with a bucket's first leave apart are compared with all of its sets up to this number, and banded again beyond it.
PAIRED = 1024
#: Bits of the map of each set's shingles.
MAP_BITS = 2048
#: Bytes of text that a worker cuts at a time.
TEXT_BYTES = 1 << 20
SPACE = b" \t\n\v\f\r"


def bands_for(rows: int = BAND_ROWS, miss: float = MISS, similarity: float = NUMERATOR / DENOMINATOR) -> int:
    """Even number of bands of ``rows`` values that together miss a pair with probability ``miss`` at most."""
    n = math.ceil(math.log(miss) / math.log1p(-similarity ** rows))
    return n + n % 2


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (multiply and fold twice)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: pa.Array, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the different shingles of each text, sorted; fewer words than ``words`` make one shingle."""
    w = cut(texts, SPACE)
    own = np.array([xxhash.xxh64_intdigest(x, SEED) for x in w.names.to_pylist()], np.uint64)
    h = own[w.codes] if len(own) else np.zeros(0, np.uint64)
    n = np.bincount(w.rows, minlength=len(texts))
    first = np.cumsum(n) - n
    place = np.arange(len(h)) - first[w.rows]
    # The number of words is part of the hash, so that a short text equals no shingle of a longer one.
    length = np.minimum(n, words).astype(np.uint64)[w.rows]
    total = _mix(h + length)
    for k in range(1, words):
        more = np.flatnonzero(place + k < n[w.rows])
        total[more] = _mix(total[more] + h[more + k] * np.uint64(2 * k + 1))
    starts = place <= np.maximum(n[w.rows] - words, 0)
    rows, hashes = w.rows[starts], total[starts]
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


def signatures(rows: np.ndarray, hashes: np.ndarray, functions: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have shingles, and for each the minima and then the maxima under all hash functions."""
    own, starts = np.unique(rows, return_index=True)
    out = np.empty((len(own), 2 * functions), np.uint64)
    seeds = _mix(np.arange(1, 2 * functions + 1, dtype=np.uint64) + np.uint64(SEED << 32))
    step = 1 << 16                                       # rows of one piece of work, cut where a row begins
    bounds = np.append(starts, len(hashes))
    i = 0
    while i < len(own):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + step, side="right")) - 1)
        part, at = hashes[bounds[i]:bounds[j]], bounds[i:j] - bounds[i]
        for f in range(functions):
            x = (part ^ seeds[2 * f]) * (seeds[2 * f + 1] | np.uint64(1))
            x ^= x >> np.uint64(31)
            x *= np.uint64(0xD6E8FEB86659FD93)
            out[i:j, f] = np.minimum.reduceat(x, at)
            out[i:j, functions + f] = np.maximum.reduceat(x, at)
        i = j
    return own, out


def _band_keys(values: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One 64-bit key for each band, the band's number included."""
    keys = np.empty((len(values), bands), np.uint64)
    for b in range(bands):
        k = np.full(len(values), b + 1, np.uint64)
        for x in values[:, b * rows:(b + 1) * rows].T:
            k = _mix(k * np.uint64(0x9E3779B97F4A7C15) + x)
        keys[:, b] = k
    return keys


def _low_bits(values: np.ndarray) -> np.ndarray:
    """The lowest bits of all values, 64 to a word: sets of similarity J agree in (1 + J) / 2 of them."""
    bits = (values >> np.uint64(7) & np.uint64(1)).astype(np.uint8)
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64)))
    return np.packbits(bits, axis=1).view(np.uint64)


def _maps(own: np.ndarray, rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each row of ``own`` a bit map of its hashes, 64 bits to a word."""
    at = np.zeros((len(own), MAP_BITS), np.uint8)
    at[np.searchsorted(own, rows), (hashes & np.uint64(MAP_BITS - 1)).astype(np.int64)] = 1
    return np.packbits(at, axis=1).view(np.uint64)


def most_differing(bits: int, similarity: float, miss: float = 1e-9) -> int:
    """The number of differing low bits that a pair of this similarity passes with probability ``miss`` at most."""
    p, tail = (1 - similarity) / 2, 0.0
    for k in range(bits, -1, -1):
        tail += math.comb(bits, k) * p ** k * (1 - p) ** (bits - k)
        if tail > miss:
            return k
    return 0


def _prints(docs: DataFrame, words: int, rows: int, bands: int) -> DataFrame:
    """(doc_id, of1, of2, n, d1, d2, keys, bits, map): hashes of text and set, size of the set, band keys, low bits, bit map."""
    functions = math.ceil(rows * bands / 2)

    def work(batches):
        for whole in batches:
            for b in slices(whole, 1, TEXT_BYTES):
                r, h = shingle_sets(b.column(1), words)
                own, values = signatures(r, h, functions)
                n = np.bincount(r, minlength=b.num_rows)
                stops = np.cumsum(n)
                digest = np.zeros((b.num_rows, 2), np.uint64)
                for i in own.tolist():
                    d = xxhash.xxh3_128_intdigest(h[stops[i] - n[i]:stops[i]].tobytes(), SEED)
                    digest[i] = d >> 64, d & 0xFFFFFFFFFFFFFFFF
                lists = []
                for made in (_band_keys(values, rows, bands), _low_bits(values), _maps(own, r, h)):
                    ends = np.cumsum(np.where(n > 0, made.shape[1], 0))
                    lists.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(made.view(np.int64).ravel())))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(2), b.column(3), pa.array(n, pa.int64()), pa.array(digest[:, 0].view(np.int64)),
                     pa.array(digest[:, 1].view(np.int64)), *lists],
                    names=["doc_id", "of1", "of2", "n", "d1", "d2", "keys", "bits", "map"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(work, f"doc_id {kind}, of1 long, of2 long, n long, d1 long, d2 long, keys array<long>, bits array<long>, map array<long>")


def _text_hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("of1"), F.xxhash64(F.lit("text"), text).alias("of2")]


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, numerator: int, denominator: int) -> DataFrame:
    """The pairs (u, v) whose full shingle sets are similar enough; ``texts`` (node, text) has all their nodes."""
    def work(batches):
        for whole in batches:
            for half in slices(whole, 2, TEXT_BYTES):
                for b in slices(half, 3, TEXT_BYTES):
                    m = b.num_rows
                    r, h = shingle_sets(pa.concat_arrays([b.column(2), b.column(3)]), words)
                    n = np.bincount(r, minlength=2 * m)
                    # A hash that occurs twice among a pair's two sets is in both.
                    pair = np.where(r < m, r, r - m)
                    order = np.lexsort((h, pair))
                    pair, h = pair[order], h[order]
                    both = np.bincount(pair[1:][(pair[1:] == pair[:-1]) & (h[1:] == h[:-1])], minlength=m)
                    linked = denominator * both >= numerator * (n[:m] + n[m:] - both)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(linked))

    a = texts.select(F.col("node").alias("u"), F.col("text").alias("a"))
    b = texts.select(F.col("node").alias("v"), F.col("text").alias("b"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(work, "u long, v long")


def _ones(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda t, x: t + F.bit_count(x))


def _alike(x: str, y: str, numerator: int, denominator: int, bits: int) -> Column:
    """Cheap tests of two rows (size, held, map, bits) that no similar pair fails (or, the last, one in 1e9), made before any text moves.

    Every bit that only one set's map has stands for a shingle that only this set has, which bounds what the two share.
    """
    of = lambda at, name: F.col(f"{at}.{name}")
    n1, n2 = of(x, "size"), of(y, "size")
    both = _ones(F.zip_with(of(x, "map"), of(y, "map"), lambda a, b: a.bitwiseAND(b)))
    shared = both + F.least(n1 - of(x, "held"), n2 - of(y, "held"))
    differing = _ones(F.zip_with(of(x, "bits"), of(y, "bits"), lambda a, b: a.bitwiseXOR(b)))
    return (F.least(n1, n2) * denominator >= F.greatest(n1, n2) * numerator) & (
        shared * (numerator + denominator) >= (n1 + n2) * numerator) & (
        differing <= most_differing(bits, numerator / denominator))


def parts_of(nodes: DataFrame, texts, words: int = SHINGLE_WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR,
             bits: int = 0, paired: int = PAIRED) -> DataFrame:
    """(node, root) of the components of all confirmed links of ``nodes`` (node, n, keys, bits, map), the roots left out.

    In a bucket every set is compared with the smallest node. When the links so far leave the bucket in several parts, up to
    ``paired`` sets outside of its largest part are compared with all others of other parts; if there are more, its sets
    are put into smaller buckets by a second shared band, then by a third, and so on. So no large group is ever paired, and
    a group of near copies costs a comparison for each. Comparisons are made on sizes and bit maps where buckets meet; only
    pairs that these cannot tell apart are confirmed. ``texts`` gives the texts of a table of nodes.
    """
    c = F.col
    facts = nodes.select("node", c("n").cast("int").alias("size"), _ones(c("map")).alias("held"), "map", "bits")

    def confirm(pairs):
        pairs = materialize(pairs, "pairs")
        if pairs.isEmpty():
            return pairs
        ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        return materialize(_confirmed(pairs, texts(ends), words, numerator, denominator), "links")

    def alike(x, y):
        return _alike(x, y, numerator, denominator, bits)

    members = nodes.select("node", c("node").alias("root"), F.explode("keys").alias("key")).withColumn("last", c("key"))
    parts = None
    while True:
        buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader"), F.min_by("root", "node").alias("leader_root"),
                                             F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 != r2").drop("r1", "r2")
        kept = materialize(members.join(buckets, "key"), "buckets")
        led = kept.where("node != leader and root != leader_root").select(c("leader").alias("u"), c("node").alias("v")).distinct()
        led = (led.join(facts.alias("x"), c("u") == c("x.node")).join(facts.alias("y"), c("v") == c("y.node"))
               .where(alike("x", "y")).select("u", "v"))
        made = confirm(led)
        parts = merged(parts, made)
        # The parts of a bucket; all but the largest are its strays. In a bucket of two all is said.
        rooted = kept.where("n > 2").select("key", "last", "node", "leader").join(parts.withColumnRenamed("root", "part"), "node", "left")
        rooted = rooted.select("key", "last", "node", "leader", F.coalesce("part", "node").alias("root"))
        open_ = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(
            F.max_by("root", "n").alias("main"), (F.sum("n") - F.max("n")).alias("strays")).where("strays > 0")
        many = materialize(rooted.join(open_, "key"), "open-buckets")
        few = many.where(c("strays") <= paired).where("node != leader")
        # A pair meets in the first of the buckets that its sets share here, and two strays meet once.
        own = few.groupBy("node").agg(F.collect_set("key").alias("own")).join(facts, "node")
        few = materialize(few.join(own, "node"), "met")
        x, y = few.where("root != main").alias("x"), few.alias("y")
        met = y.join(x, (c("x.key") == c("y.key")) & (c("x.root") != c("y.root")) & (
            (c("y.root") == c("y.main")) | (c("x.node") < c("y.node"))) & alike("x", "y") & (
            F.array_min(F.array_intersect("x.own", "y.own")) == c("x.key")))
        more = confirm(met.select(F.least("x.node", "y.node").alias("u"), F.greatest("x.node", "y.node").alias("v")).distinct())
        if not more.isEmpty():
            parts = merged(parts, more)
        again = many.where(c("strays") > paired).select("node", "root", "key", "last")
        if again.isEmpty():
            return parts
        if not more.isEmpty():
            moved = again.drop("root").join(parts.withColumnRenamed("root", "part"), "node", "left")
            again = moved.select("node", F.coalesce("part", "node").alias("root"), "key", "last")
        # Bands are taken in rising order, so that each set of shared bands makes one bucket.
        again = again.join(nodes.select("node", "keys"), "node").select(
            "node", "root", "key", F.explode(F.filter("keys", lambda k: k > c("last"))).alias("last"))
        members = materialize(again.select("node", "root", F.xxhash64("key", "last").alias("key"), "last"), "bands-again")
        if members.isEmpty():
            return parts


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = SHINGLE_WORDS,
                    numerator: int = NUMERATOR, denominator: int = DENOMINATOR, band_rows: int = BAND_ROWS,
                    miss: float = MISS, paired: int = PAIRED) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row for each row of ``docs``.

    A document is the set of its different shingles of ``words`` words (A-Z in lower case, cut at white space; fewer words
    make one shingle). Documents with denominator * intersection >= numerator * union are linked; the component id is the
    smallest id that can be reached, and the document of that id is kept. A pair of exactly that similarity is missed with
    probability ``miss``, a more similar one far more seldom (more often if it only shares a bucket with more than
    ``paired`` strays, where it must share a second band); no other pair is linked. Equal sets are one node, so copies
    cost no comparison. Null, empty and blank texts have no shingle and are linked with nothing: such a row is its own
    component and kept. A null id never is a component id unless its component has no other; then the id is null and all
    rows are kept. Rows of one id may repeat and are kept together. An empty table gives no rows.
    """
    bands = bands_for(band_rows, miss, numerator / denominator)
    base = drop_strays(docs, id_col, text_col).toDF("doc_id", "text")
    hashed = base.select("doc_id", "text", *_text_hashes(F.col("text")))
    prints = materialize(_prints(hashed, words, band_rows, bands), "minmax")
    full = prints.where("n > 0")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "of1", "of2")
    one = F.min_by(F.struct(F.col("doc_id").alias("least"), "of1", "of2", "n", "keys", "bits", "map"), place)
    nodes = full.groupBy("d1", "d2").agg(one.alias("one"))
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("node"), "d1", "d2", "one.*"), "minmax-nodes")

    def texts(ends):
        # One row of each set, found by its id and its text's hashes, so that copies of a text are dealt out evenly.
        wanted = nodes.join(ends, "node").select("node", "least", F.col("of1").alias("w1"), F.col("of2").alias("w2"))
        # Only texts whose hash is among the wanted move (a bit map of bounded size lets few others through).
        near = flagged(hashed, F.col("of1"), marked(wanted.select(F.col("w1").alias("h")))).where("often")
        meet = near.join(wanted, F.col("doc_id").eqNullSafe(F.col("least")) & (F.col("of1") == F.col("w1")) & (F.col("of2") == F.col("w2")))
        return meet.groupBy("node").agg(F.max("text").alias("text"))

    roots = parts_of(nodes.select("node", "n", "keys", "bits", "map"), texts, words, numerator, denominator,
                     2 * math.ceil(band_rows * bands / 2), paired)
    named = nodes.join(roots, "node", "left").select("node", "d1", "d2", "least", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("d1", "d2", "component_id")
    out = prints.select("doc_id", "n", "d1", "d2").join(named, ["d1", "d2"], "left")
    of = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), of.alias("component_id"), F.col("doc_id").eqNullSafe(of).alias("kept"))


def oracle_sql(relation: str = "documents") -> str:
    """DuckDB statement for the rows at two words and 80 %; ids must be unique."""
    return rf"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as w from {relation}),
s as (
  select doc_id, case when len(w) < 2 then w
    else list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) end as s from w),
u as materialized (select row_number() over () as id, s, len(s) as n, min(doc_id) as least from s where len(s) > 0 group by s),
e as materialized (select id, n, unnest(s) as g from u),
p as (select a.id as u, b.id as v, a.n + b.n as n, count(*) as shared from e a join e b on a.g = b.g and a.id < b.id
  and 100 * least(a.n, b.n) >= {NUMERATOR} * greatest(a.n, b.n) group by all),
l as materialized (select u, v from p where {DENOMINATOR} * shared >= {NUMERATOR} * (n - shared)),
d as materialized (select u, v from l union all select v, u from l),
r as (select id, id as seen from u union select r.id, d.v from r join d on d.u = r.seen),
c as (select r.id, min(u.least) as component_id from r join u on u.id = r.seen group by r.id)
select s.doc_id, len(s.s) as n_shingles, coalesce(c.component_id, s.doc_id) as component_id,
  coalesce(c.component_id, s.doc_id) = s.doc_id as kept
from s left join u on u.s = s.s left join c on c.id = u.id"""
