"""Sender clustering: feature table, standardisation, best-of-n K-Means,
stable cluster ids, and per-cluster statistics and rankings.

K-Means runs as ``pyspark.ml`` jobs over the distributed feature table; only
the k centres live on the driver. The standardisation uses population
statistics (one global aggregate), as the audited tool does.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inboxlens.session import materialize

FEATURES = ["total_volume", "unread_count", "open_rate", "ignorance_score"]
DEFAULT_SEED = 42
DEFAULT_STARTS = 10


def feature_table(senders: DataFrame) -> DataFrame:
    """``(from, total_volume, unread_count, open_rate, ignorance_score)`` as DOUBLE, nulls -> 0."""
    return senders.select("from", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES])


def standardize(features: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each feature to mean 0 and population standard deviation 1; a constant column becomes 0.

    The columns named in ``keep`` are carried along as they are, called ``_raw_`` and their name.
    """
    stats = features.agg(*[x for c in FEATURES for x in (F.avg(c).alias(f"_m_{c}"),
                                                         F.stddev_pop(c).alias(f"_s_{c}"))])
    j = features.crossJoin(F.broadcast(stats))  # one row: fixed size
    return j.select("from", *[
        F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(F.lit(0.0)).alias(c)
        for c in FEATURES], *[F.col(c).alias(f"_raw_{c}") for c in keep])


def cluster_senders(senders: DataFrame, n_clusters: int = 5, **options) -> DataFrame:
    """The assignment of :func:`cluster_senders_with_costs` alone."""
    return cluster_senders_with_costs(senders, n_clusters, **options)[0]


def cost_of(clusters: DataFrame, senders: DataFrame) -> DataFrame:
    """One row: the squared distances of standardised senders to their cluster's mean (cost) and to the overall mean
    (one_cluster_cost), added up."""
    x = standardize(feature_table(senders)).join(clusters, "from")
    spread = sum((F.var_pop(c) for c in FEATURES), F.lit(0.0)) * F.count(F.lit(1))
    per = x.groupBy("cluster").agg(spread.alias("c"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("c").alias("cost")).crossJoin(x.agg(spread.alias("one_cluster_cost")))


def cluster_senders_with_costs(senders: DataFrame, n_clusters: int = 5, seed: int = DEFAULT_SEED,
                               starts: int = DEFAULT_STARTS, max_iter: int = 100,
                               parallel_starts: int = 10) -> tuple[DataFrame, list[float]]:
    """``(from, cluster)`` and the training cost of every start; with stable ids 0..k-1 (see :func:`stable_ids`).

    Best of ``starts`` K-Means runs (seeds ``seed``, ``seed+1``, ...) by
    training cost. Fewer senders than clusters gives an empty result; one
    cluster puts everyone in cluster 0.
    """
    if n_clusters <= 0:
        raise ValueError("n_clusters must be positive")
    spark = senders.sparkSession
    empty = spark.createDataFrame([], "from string, cluster int")
    # written once: the count, the statistics, the fits and the renumbering all read it
    feats = materialize(feature_table(senders), "cluster-features")
    n = feats.count()
    if n == 0 or n < n_clusters:
        return empty, []
    if n_clusters == 1:
        return feats.select("from", F.lit(0).alias("cluster")), []
    scaled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(
        standardize(feats, keep=("open_rate", "ignorance_score")))
    scaled = scaled.select("from", "features", "_raw_open_rate", "_raw_ignorance_score").persist(StorageLevel.MEMORY_AND_DISK)

    def fit(s: int):
        model = KMeans(k=n_clusters, seed=s, maxIter=max_iter, featuresCol="features",
                       predictionCol="raw_cluster").fit(scaled)
        return model.summary.trainingCost, s, model

    try:
        # the starts are independent Spark jobs; submitting them from a few
        # threads overlaps their scheduling and keeps executors busy
        with ThreadPoolExecutor(max_workers=min(starts, parallel_starts)) as pool:
            results = list(pool.map(fit, range(seed, seed + starts)))
        best = min(results, key=lambda r: (r[0], r[1]))
        assigned = best[2].transform(scaled).select(
            "from", F.col("raw_cluster").cast("int"), F.col("_raw_open_rate").alias("open_rate"),
            F.col("_raw_ignorance_score").alias("ignorance_score"))
        out = stable_ids(assigned)
        # written once so the k-means lineage is not replayed by every consumer
        return out.checkpoint(eager=True), [r[0] for r in results]
    finally:
        scaled.unpersist()


def stable_ids(assigned: DataFrame) -> DataFrame:
    """Renumber raw ids ``(from, raw_cluster, open_rate, ignorance_score)`` 0..k-1 by mean open rate asc, then
    mean score desc."""
    stats = assigned.groupBy("raw_cluster").agg(F.avg("open_rate").alias("_o"), F.avg("ignorance_score").alias("_s"))
    # k rows only: a single-partition window is bounded by the cluster count
    w = Window.orderBy(F.col("_o").asc(), F.col("_s").desc(), F.col("raw_cluster"))
    ids = stats.select("raw_cluster", (F.row_number().over(w) - 1).cast("int").alias("cluster"))
    return assigned.join(F.broadcast(ids), "raw_cluster").select("from", "cluster")


def cluster_members(clusters: DataFrame, senders: DataFrame) -> DataFrame:
    """Cluster assignment joined to the sender metrics on ``from``."""
    return clusters.join(senders, "from", "inner")


def cluster_stats(clusters: DataFrame, senders: DataFrame) -> DataFrame:
    """Per cluster: senders, e-mails, unread, mean open rate, mean score; worst open rate first."""
    m = cluster_members(clusters, senders)
    return (m.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("senders"), F.sum("total_volume").cast("long").alias("total_emails"),
        F.sum("unread_count").cast("long").alias("total_unread"),
        F.avg("open_rate").alias("avg_open_rate"), F.avg("ignorance_score").alias("avg_ignorance"))
        .orderBy(F.col("avg_open_rate").asc(), F.col("cluster")))


def top_per_cluster(clusters: DataFrame, senders: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` highest scores in each cluster (partial WindowGroupLimit before the shuffle)."""
    m = cluster_members(clusters, senders)
    w = Window.partitionBy("cluster").orderBy(F.col("ignorance_score").desc(), F.col("from"))
    return (m.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select("cluster", "rank", "from", "total_volume", "open_rate", "ignorance_score"))
