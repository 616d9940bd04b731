"""Composite reports: each command of the audit tool as a set of DataFrames.

A report reads the sender table several times, so it is first written to the
shared checkpoint folder (:func:`materialize`): later parts read it back
instead of recomputing the aggregation, and a lost executor only costs a
re-read, not a replay of the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inboxlens.operators import clusters as CL
from inboxlens.operators import content as CT
from inboxlens.operators import messages as MS
from inboxlens.operators import metrics as MT
from inboxlens.operators import refresh as RF
from inboxlens.operators import senders as SN
from inboxlens.schemas import DEFAULT_CACHE_TTL_DAYS, LABEL_TRASH
from inboxlens.session import materialize, shared_dir
from inboxlens.sources.listing import bounded_listing
from inboxlens.sources.senders_io import load_senders, save_senders

LONG_SCHEMA = "section string, rank int, item string, metric string, value double"


# ---------------------------------------------------------------------------
# J1: audit
# ---------------------------------------------------------------------------

def audit(listing: DataFrame, cache: DataFrame, fetch, as_of=None, refresh: bool = False,
          ttl_days: int = DEFAULT_CACHE_TTL_DAYS, out_dir: str | None = None,
          allow_prune_all: bool = False, max_emails: int | None = None, include_labels=(),
          exclude_labels=(LABEL_TRASH,), senders_out: str | None = None) -> dict[str, DataFrame]:
    """Refresh the cache for ``listing`` and aggregate the listed messages.

    ``fetch`` maps the fetch plan ``(id, reason)`` to fetched cache rows (the
    mail-service client lives outside Spark). With ``max_emails`` the listing
    is the mailbox ``(id, ts, labelIds)`` and bounded first, newest messages
    that pass the label filters; ``senders_out`` names a folder to which the
    sender table is written as CSV. Returns the new cache (pruned to the
    listing), the removed entries, the change feed (each id ``added``,
    ``replaced``, ``kept`` or ``removed``), the message table and the sender table.

    Listing, plan and fetched rows are each written once under the shared
    folder, so every message is fetched once whatever reads the result. The
    refreshed cache (the newer copy of each id wins) meets the listing in one
    join; listing ids are counted per id first, so one listed twice is read
    twice, as listed. The result is written partitioned by whether the id is
    still listed: the new cache, the pruned ids and the message table are then
    partition-pruned scans of that write.

    An empty listing gives an empty sender table; it empties the cache only
    with ``allow_prune_all=True`` (otherwise the cache is kept as it is).
    """
    spark = cache.sparkSession
    if max_emails is not None:
        listing = bounded_listing(listing, max_emails, include_labels, exclude_labels)
    listing = materialize(listing.select("id"), "audit-listing")
    if not allow_prune_all and listing.isEmpty():
        messages = MS.extract(cache.limit(0), as_of)
        found = {"plan": listing.select("id", F.lit("missing").alias("reason")), "fetched": cache.limit(0),
                 "cache": cache, "removed": cache.limit(0), "changes": cache.select("id", F.lit("kept").alias("change")),
                 "messages": messages,
                 "senders": SN.aggregate_and_score(messages), "path": None}
    else:
        found = _refreshed(listing, cache, fetch, as_of, refresh, ttl_days, out_dir or shared_dir(spark, "audit-cache"))
    if senders_out is not None:
        save_senders(SN.sort_by_score(found["senders"]), senders_out)
        found["senders"] = load_senders(spark, senders_out)
    return found


def _refreshed(listing: DataFrame, cache: DataFrame, fetch, as_of, refresh: bool, ttl_days: int, path: str) -> dict:
    plan = materialize(RF.fetch_plan(listing, cache, refresh, ttl_days, as_of), "audit-plan")
    fetched = materialize(fetch(plan), "audit-fetched")
    listed = listing.groupBy("id").agg(F.count(F.lit(1)).alias("_listed"))
    # The cache's bodies are read once: changes() joins them to what was fetched, and the listing meets the same partitions.
    flagged = (RF.changes(cache, fetched).join(listed, "id", "left")
               .withColumn("state", F.when(F.col("_listed").isNotNull(), F.lit("listed")).otherwise(F.lit("removed"))))
    flagged.write.mode("overwrite").partitionBy("state").parquet(path)
    snap = cache.sparkSession.read.parquet(path)
    kept = snap.where(F.col("state") == "listed").drop("state", "_listed", "change")
    removed = snap.where(F.col("state") == "removed").drop("state", "_listed", "change")
    feed = snap.select("id", F.when(F.col("state") == "removed", F.lit("removed")).otherwise(F.col("change")).alias("change"))
    listed_rows = MS.extract(snap.where(F.col("state") == "listed"), as_of, keep=["_listed"])
    # the sender table weights each cached message by how often it is listed: an id
    # listed many times is never replicated into one task
    senders = SN.aggregate_and_score(listed_rows, weight="_listed")
    # the message table keeps one row per listing occurrence, as listed (computed only if used)
    messages = (listed_rows.withColumn("_occurrence", F.explode(F.sequence(F.lit(1), F.col("_listed").cast("int"))))
                .drop("_occurrence", "_listed"))
    return {"plan": plan, "fetched": fetched, "cache": kept, "removed": removed, "changes": feed, "messages": messages,
            "senders": senders, "path": path}


# ---------------------------------------------------------------------------
# long-table helper
# ---------------------------------------------------------------------------

def to_long(df: DataFrame, section: str, metrics: list[str], item: str | None = None,
            rank: str | None = None) -> DataFrame:
    """Unpivot ``metrics`` of ``df`` into ``(section, rank, item, metric, value)`` rows."""
    stack = ", ".join(f"'{m}', CAST(`{m}` AS DOUBLE)" for m in metrics)
    base = df.select(
        F.lit(section).alias("section"),
        (F.col(rank).cast("int") if rank else F.lit(None).cast("int")).alias("rank"),
        (F.col(item).cast("string") if item else F.lit(None).cast("string")).alias("item"),
        *[F.col(f"`{m}`") for m in metrics])
    return base.selectExpr("section", "rank", "item", f"stack({len(metrics)}, {stack}) AS (metric, value)")


def _ranked(df: DataFrame, order: list) -> DataFrame:
    # only applied to limited (<= 10 row) frames
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


# ---------------------------------------------------------------------------
# J2 / J3 / J4
# ---------------------------------------------------------------------------

def report_parts(senders: DataFrame) -> dict[str, DataFrame]:
    """The full report as separate frames (the sender table is written once first)."""
    s = materialize(senders, "report-senders")
    by_score = [F.col("ignorance_score").desc(), F.col("from")]
    by_volume = [F.col("total_volume").desc(), F.col("from")]
    return {
        "status": MT.overall_metrics(s),
        "distribution": MT.distribution_summary(s),
        "engagement": MT.tier_overview(s),
        "categories": MT.category_distribution(s),
        "top_noise_makers": _ranked(SN.top_noise_makers(s, 10), by_score),
        "unsubscribe": _ranked(SN.unsubscribe_candidates(s, 5), by_volume),
        "review": _ranked(SN.review_candidates(s, 5, low_engagement_only=True), by_score),
        "keep": _ranked(SN.top_engaged(s, 3), by_volume),
        "top_priorities": _ranked(SN.top_noise_makers(s, 3), by_score),
    }


STATUS_METRICS = ["total_senders", "total_emails", "unread_percentage", "average_open_rate",
                  "senders_never_opened", "top_ignorance_score"]


def generate_report(senders: DataFrame, brief: bool = False) -> DataFrame:
    """The full report as one long ``(section, rank, item, metric, value)`` table;
    ``brief`` keeps the headline status and the top 3 noise makers."""
    p = report_parts(senders)
    status = to_long(p["status"], "status", STATUS_METRICS)
    if brief:
        return status.where(F.col("metric").isin(*STATUS_METRICS[:4])).unionByName(
            to_long(p["top_priorities"], "top_priorities", ["total_volume", "ignorance_score"], "from", "rank"))
    parts = [
        status,
        to_long(p["distribution"], "distribution",
                ["top10_volume_emails", "top10_volume_pct", "top10_noise_emails", "top10_noise_pct",
                 "zero_open_senders", "zero_open_emails", "zero_open_pct", "high_volume_senders",
                 "high_volume_emails", "high_volume_pct"]),
        to_long(p["engagement"], "engagement", ["senders", "emails", "share_pct"], "tier_name", "tier_rank"),
        to_long(p["categories"], "categories", ["emails", "share_pct"], "category", "category_rank"),
        to_long(p["top_noise_makers"], "top_noise_makers", ["total_volume", "open_rate", "ignorance_score"],
                "from", "rank"),
        to_long(p["unsubscribe"], "unsubscribe", ["total_volume"], "from", "rank"),
        to_long(p["review"], "review", ["total_volume", "open_rate"], "from", "rank"),
        to_long(p["keep"], "keep", ["total_volume", "open_rate"], "from", "rank"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cleanup_report(senders: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Status, optional comparison with a baseline metrics row, top 10, unsubscribe and review lists."""
    s = materialize(senders, "cleanup-senders")
    m = MT.overall_metrics(s)
    by_score = [F.col("ignorance_score").desc(), F.col("from")]
    out = to_long(m, "status", ["total_senders", "total_emails", "unread_percentage", "average_open_rate",
                                "senders_never_opened", "top_ignorance_score"])
    if baseline is not None:
        out = out.unionByName(to_long(MT.compare_metrics(baseline, m), "improvement",
                                      ["unread_improvement", "top_score_reduction", "top_score_reduction_pct",
                                       "open_rate_improvement"]))
    out = out.unionByName(to_long(_ranked(SN.top_noise_makers(s, 10), by_score), "top_noise_makers",
                                  ["total_volume", "open_rate", "ignorance_score"], "from", "rank"))
    out = out.unionByName(to_long(_ranked(SN.unsubscribe_candidates(s, 5),
                                          [F.col("total_volume").desc(), F.col("from")]),
                                  "unsubscribe", ["total_volume"], "from", "rank"))
    return out.unionByName(to_long(_ranked(SN.review_candidates(s, 5), by_score), "review",
                                   ["total_volume", "open_rate"], "from", "rank"))


def analyze_engagement(senders: DataFrame, tier: str = "all") -> DataFrame:
    """``all``: tier overview plus the top 3 high-tier senders; one tier: its full listing."""
    if tier != "all":
        return SN.tier_listing(senders, tier)
    s = materialize(senders, "engagement-senders")
    over = to_long(MT.tier_overview(s), "tiers", ["senders", "emails", "share_pct", "avg_open_rate"],
                   "tier_name", "tier_rank")
    top = to_long(_ranked(SN.top_engaged(s, 3), [F.col("total_volume").desc(), F.col("from")]),
                  "top_high_engagement", ["total_volume", "open_rate"], "from", "rank")
    return over.unionByName(top)


# ---------------------------------------------------------------------------
# J5: content patterns
# ---------------------------------------------------------------------------

def _pairs(col_name: str, a: str, b: str):
    return F.array_join(F.transform(F.col(col_name), lambda x: F.concat(x[a], F.lit(" ("), x[b].cast("string"),
                                                                        F.lit(")"))), ", ")


def analyze_patterns(messages: DataFrame, senders: DataFrame, top_n: int = 5, by: str = "volume",
                     content_features: bool = True, gazetteer: DataFrame | None = None,
                     hide_zero_intents: bool = False, flat: bool = True) -> DataFrame:
    """Per top sender: sample subject, e-mail count, top 10 keywords, top 5
    entities per label, top 3 intents. Senders without snippets are skipped
    after the top-n cut.

    The top-n senders are semi-joined to the
    messages, so only their mail is tokenised. Both the chosen senders and
    their messages are written once to the shared folder: the six branches
    below (counts, subjects, keywords, intents, entities, assembly) read them
    instead of re-running the sender aggregation and the scan each time.
    """
    top = materialize(SN.top_senders_for_patterns(senders, top_n, by).select("from", "rank"), "pattern-senders")
    mine = materialize(messages.join(top.select("from"), "from", "left_semi"), "pattern-messages")
    snippets = CT.sender_snippets(mine)
    counts = CT.snippet_counts(mine)
    subjects = CT.first_subject(mine)
    kw = CT.top_keywords(mine, 10).groupBy("from").agg(
        F.sort_array(F.collect_list(F.struct("rank", "keyword", "n"))).alias("_kw"))  # <= 10 per sender
    intents = CT.top_intents(snippets, 3, "from", gazetteer, content_features=content_features)
    if hide_zero_intents:
        intents = intents.where(F.col("score") > 0)
    it = intents.groupBy("from").agg(F.sort_array(F.collect_list(F.struct("rank", "intent", "score"))).alias("_it"))
    # every side below holds at most top_n rows, a number the user chooses: Spark decides how to join
    out = (top.join(counts, "from", "inner").join(subjects, "from", "left").join(kw, "from", "left")
           .join(it, "from", "left"))
    if content_features:
        ents = CT.top_entities(mine, gazetteer, 5)
        ent = (ents.groupBy("from", "label")
               .agg(F.sort_array(F.collect_list(F.struct("rank", "entity", "n"))).alias("_e"))  # <= 5 each
               .groupBy("from").agg(F.sort_array(F.collect_list(F.struct("label", "_e"))).alias("_ents")))
        out = out.join(ent, "from", "left")
    else:
        out = out.withColumn("_ents", F.lit(None).cast("array<struct<label:string,_e:array<struct<rank:int,"
                                                       "entity:string,n:bigint>>>>"))
    out = out.withColumn("nlp_used", F.lit(bool(content_features)))
    if not flat:
        return out
    ent_txt = F.array_join(F.transform(F.col("_ents"), lambda x: F.concat(
        x["label"], F.lit(": "), F.array_join(F.transform(x["_e"], lambda e: F.concat(
            e["entity"], F.lit(" ("), e["n"].cast("string"), F.lit(")"))), ", "))), "; ")
    return out.select(
        "from", "rank", F.coalesce("sample_subject", F.lit("")).alias("sample_subject"),
        F.col("email_count").cast("long").alias("email_count"),
        F.coalesce(_pairs("_kw", "keyword", "n"), F.lit("")).alias("top_keywords"),
        # with zero scores hidden, a sender left with no intent reads "unknown"
        F.coalesce(_pairs("_it", "intent", "score"), F.lit("unknown" if hide_zero_intents else "")).alias("top_intents"),
        F.coalesce(ent_txt, F.lit("")).alias("top_entities"), "nlp_used")


# ---------------------------------------------------------------------------
# J6 / J7
# ---------------------------------------------------------------------------

def analyze_clusters(senders: DataFrame, n_clusters: int = 5, clusters: DataFrame | None = None) -> dict[str, DataFrame]:
    """Assignment, statistics and top senders per cluster; ``clusters`` gives an assignment made before."""
    s = materialize(senders, "cluster-senders")
    if clusters is None:
        clusters = CL.cluster_senders(s, n_clusters)
    return {"clusters": clusters, "stats": CL.cluster_stats(clusters, s),
            "top": CL.top_per_cluster(clusters, s, 5)}


def cluster_report(parts: dict[str, DataFrame]) -> DataFrame:
    """Statistics and top senders of :func:`analyze_clusters` as one long table."""
    stats = to_long(parts["stats"], "stats", ["senders", "total_emails", "total_unread", "avg_open_rate", "avg_ignorance"],
                    "cluster")
    top = parts["top"].select(F.concat(F.lit("top in cluster "), F.col("cluster").cast("string")).alias("s"), "rank", "from",
                              "total_volume", "open_rate", "ignorance_score")
    long = to_long(top.withColumn("_i", F.struct("s", "from")).withColumn("from", F.to_json("_i")), "", ["total_volume",
                   "open_rate", "ignorance_score"], "from", "rank")
    pair = F.from_json("item", "s string, `from` string")
    return stats.unionByName(long.select(pair["s"].alias("section"), "rank", pair["from"].alias("item"), "metric", "value"))


def sender_report(senders: DataFrame, pattern: str) -> DataFrame:
    return SN.sender_lookup(senders, pattern)
