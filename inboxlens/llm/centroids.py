"""Centroid clustering (Lloyd's rounds) with Ptolemaic pivots, exact in whole numbers.

For any four points Ptolemy's inequality gives d(x,c) * d(p,q) >= |d(x,p) * d(c,q) - d(x,q) * d(c,p)|. The distances of
every vector to the pivots are computed once and kept with it; those of the centroids follow anew in each round. So fixed
pairs of pivots (p, q) bound the distance of a vector to each centroid from below, and only centroids whose bound does
not pass the distance of the best one are compared with the vector itself.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_strays, materialize

DIMENSIONS, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
#: Pairs of pivots; the pivots are among the first centroids.
PAIRS = 4
#: Largest size of a whole component, so that squared distances fit into 64 bits.
LARGEST = 1 << 28
#: Vectors compared at a time.
_ROWS = 4096
_SLACK = 16 * np.finfo(np.float64).eps


def usable(vector: Column, dimensions: int = DIMENSIONS) -> Column:
    """True for vectors with so many components, none of them null or not finite."""
    finite = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), F.lit(False)))
    return F.coalesce((F.size(vector) == dimensions) & finite, F.lit(False))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def _whole(x: np.ndarray, scale: int) -> np.ndarray:
    x = np.floor(x.astype(np.float64) * scale)
    if len(x) and np.abs(x).max() >= LARGEST:
        raise ValueError(f"a component is {LARGEST} or more after scaling: squared distances would not fit into 64 bits")
    return x.astype(np.int64)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` to all rows of ``b`` (few)."""
    return np.stack([((a - y) ** 2).sum(1) for y in b], 1) if len(b) else np.zeros((len(a), 0), np.int64)


def pivot_pairs(points: np.ndarray, pairs: int = PAIRS) -> list[tuple[int, int]]:
    """Up to ``pairs`` disjoint pairs of rows of ``points``, far ones first; rows at the same place make no pair."""
    far = _squares(points, points)
    found: list[tuple[int, int]] = []
    left = set(range(len(points)))
    while len(left) > 1 and len(found) < pairs:
        d, a, b = max((int(far[i, j]), -i, -j) for i in left for j in left if i < j)
        if not d:
            break
        found.append((-a, -b))
        left -= {-a, -b}
    return found


def nearest(x: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray,
            pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the nearest centroid, squared distance to it, and how many exact distances that took, of each row.

    ``to_pivots`` are the rows' distances to ``pivots``, whose rows 2i and 2i+1 are a pair. Bounds are rounded down by
    more than the errors of their 64-bit floats; a bound equal to the best distance still is checked, so that ties go to
    the smaller number.
    """
    low = np.zeros((len(x), len(centroids)))
    of = np.sqrt(_squares(centroids, pivots).astype(np.float64))
    for i in range(0, len(pivots), 2):
        apart = math.sqrt(int(((pivots[i] - pivots[i + 1]) ** 2).sum()))
        a, b = to_pivots[:, i, None] * of[None, :, i + 1], to_pivots[:, i + 1, None] * of[None, :, i]
        np.maximum(low, (np.abs(a - b) - _SLACK * (a + b)) / apart, out=low)
    low *= low * (1 - _SLACK)
    rows = np.arange(len(x))
    best = low.argmin(1)
    least = ((x - centroids[best]) ** 2).sum(1)
    left = low <= (least * (1 + _SLACK))[:, None]
    left[rows, best] = False
    checked = 1 + left.sum(1)
    for c in range(len(centroids)):
        own = np.flatnonzero(left[:, c])
        d = ((x[own] - centroids[c]) ** 2).sum(1)
        better = (d < least[own]) | ((d == least[own]) & (c < best[own]))
        best[own[better]], least[own[better]] = c, d[better]
    return best, least, checked


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, clusters: int = CLUSTERS,
            rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, pairs: int = PAIRS) -> DataFrame:
    """``(vec_id, cluster, distance, checked, cluster_inertia, inertia, centroid_sha256)`` for every usable vector.

    Components count as floor(``scale`` * x). The first centroids are the ``clusters`` vectors with the smallest
    SHA-256 of ``1:<id>`` (a null id: of ``1:``; ids that repeat: by the smaller vector), fewer if there are fewer. In
    each round every vector goes to the nearest centroid, the smaller number on ties, then each centroid with vectors
    becomes the floor of their mean. ``checked`` counts the exact distances of the last assignment. Vectors of another
    length, or with a null or infinite component, are left out; repeated rows count each; no vectors give no rows. A
    component of 2**28 or more is an error. Only centroids and their sums reach the driver (``clusters`` times
    ``dimensions`` numbers); each task adds up its own vectors first, so the size of a cluster does not matter.
    """
    rows = drop_strays(vectors, id_col, vector_col).toDF("vec_id", "v").where(usable(F.col("v"), dimensions))
    rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    order = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.orderBy(order, "v").limit(clusters).select("v").collect()
    centroids = _whole(np.array([r["v"] for r in first], np.float64).reshape(-1, dimensions), scale)
    pivots = centroids[[i for pair in pivot_pairs(centroids, pairs) for i in pair]]

    def prepare(batches):
        for b in batches:
            x = _whole(_matrix(b.column(1), dimensions), scale)
            far = np.sqrt(_squares(x, pivots).astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), pa.int32()), dimensions).cast(pa.list_(pa.int32())),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(pivots), pa.int32()), pa.array(far.ravel()))],
                names=["vec_id", "x", "far"])

    id_type = rows.schema["vec_id"].dataType.simpleString()
    ready = materialize(rows.mapInArrow(prepare, f"vec_id {id_type}, x array<int>, far array<double>"), "vectors")

    def assigned(batches, now):
        for b in batches:
            for i in range(0, b.num_rows, _ROWS):
                part = b.slice(i, _ROWS)
                x = _matrix(part.column("x"), dimensions).astype(np.int64)
                far = _matrix(part.column("far"), len(pivots)) if len(pivots) else np.zeros((len(x), 0))
                yield part, x, *nearest(x, far, now, pivots)

    def sums(now):
        def work(batches):
            total, n = np.zeros((len(now), dimensions), np.int64), np.zeros(len(now), np.int64)
            for _, x, best, _, _ in assigned(batches, now):
                for c in np.unique(best):
                    total[c] += x[best == c].sum(0)
                n += np.bincount(best, minlength=len(now))
            own = np.flatnonzero(n)
            if len(own):
                yield pa.RecordBatch.from_pydict({"cluster": own.astype(np.int32), "n": n[own], "sums": total[own].tolist()})
        return work

    for _ in range(rounds):
        parts = ready.mapInArrow(sums(centroids), "cluster int, n long, sums array<long>")
        parts = parts.select("cluster", "n", F.posexplode("sums").alias("j", "s")).groupBy("cluster", "j").agg(
            F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        centroids = centroids.copy()
        for r in parts.collect():
            centroids[r["cluster"], r["j"]] = int(r["s"]) // r["n"]

    def work(batches):
        for part, _, best, least, checked in assigned(batches, centroids):
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(best, pa.int32()), pa.array(least, pa.int64()),
                                              pa.array(checked, pa.int32())], names=["vec_id", "cluster", "distance", "checked"])

    found = materialize(ready.mapInArrow(work, f"vec_id {id_type}, cluster int, distance long, checked int"), "assigned")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    sizes = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # One row for each cluster; the digests of all of them are part of the plan.
    digest = reduce(lambda a, k: a.when(F.col("cluster") == k, digests[k]), range(len(digests)), F.when(F.lit(False), ""))
    sizes = sizes.crossJoin(F.broadcast(sizes.agg(F.sum("cluster_inertia").alias("inertia")))).withColumn("centroid_sha256", digest)
    return found.join(F.broadcast(sizes), "cluster").select(
        "vec_id", "cluster", "distance", "checked", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(relation: str = "embeddings", clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """DuckDB statement for the rows (without ``checked``) at the usual dimensions and scale; ids must be unique."""
    steps, last = [], "c0"
    for k in range(rounds):
        steps.append(_ASSIGN.format(k=k, c=last) + _UPDATE.format(k=k, c=last, n=k + 1))
        last = f"c{k + 1}"
    final = _ASSIGN.format(k=rounds, c=last)
    return f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as q from {relation}
  where len(embedding) = {DIMENSIONS} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {DIMENSIONS}),
c0 as (
  select (row_number() over (order by sha256('1:' || vec_id::varchar)) - 1)::int as k, q as c from v
  order by sha256('1:' || vec_id::varchar) limit {clusters}),
{"".join(steps)}{final.rstrip().rstrip(",")}
select a.vec_id, a.k as cluster, a.d as distance, (sum(a.d) over (partition by a.k))::bigint as cluster_inertia,
  (sum(a.d) over ())::bigint as inertia,
  sha256(array_to_string(c.c, ',')) as centroid_sha256
from a{rounds} a join {last} c using (k)"""


_ASSIGN = """a{k} as (
  select vec_id, q, arg_min(k, (d, k)) as k, min(d) as d from (
    select v.vec_id, v.q, c.k,
      list_sum(list_transform(list_zip(v.q, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
    from v cross join {c} c) group by vec_id, q),
"""
_UPDATE = """m{k} as (
  select k, j, sum(x) as s, count(*)::hugeint as n from (
    select k, unnest(q) as x, generate_subscripts(q, 1) as j from a{k}) group by k, j),
c{n} as (
  select c.k, coalesce(m.c, c.c) as c from {c} c left join (
    select k, list(((s - ((s % n + n) % n)) // n)::bigint order by j) as c from m{k} group by k) m using (k)),
"""
