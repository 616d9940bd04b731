"""

Each query reads the whole test tables through the mail-shaped views of
``inboxlens.fixtures.views`` and runs the library operators on them. Doubles
are rounded to 6 places in the returned frames (and in the oracle SQL) so the
value hashes compare engine results, not last-bit float noise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inboxlens.fixtures import views as V
from inboxlens.functions.numbers import percentage, percentage_text
from inboxlens.functions.tiers import tier_rank
from inboxlens.operators import clusters as CL
from inboxlens.operators import content as CT
from inboxlens.operators import messages as MS
from inboxlens.operators import metrics as MT
from inboxlens.operators import refresh as RF
from inboxlens.operators import rules as RL
from inboxlens.operators import senders as SN
from inboxlens.operators import shares as SH
from inboxlens.plans import reports as RP
from inboxlens.session import shared_dir
from inboxlens.sources import bucketed as SB
from inboxlens.sources import cache as SC
from inboxlens.sources import listing as SL
from inboxlens.sources import mailbox as MB
from inboxlens.sources import senders_io as SIO
from inboxlens.streaming import AuditPaths, current_senders, start_incremental_audit

# The training-data operators live in one optional subpackage; without it everything else still works.
try:
    import corpus_pipeline
    from inboxlens.llm import queries as llm_queries
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "inboxlens.llm"):
        raise
    LLM_QUERIES, LLM_ORACLES = {}, {}
else:
    LLM_QUERIES = {**llm_queries.QUERIES, "pipeline": corpus_pipeline.run}
    LLM_ORACLES = {**llm_queries.ORACLE_SQL, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL
                                                else {})}

FLAGSHIP_SF = "/root/testdata/sf0.001"
LOOKUP_PATTERN = "CUST1[0-9]{2}@"
BEFORE_AS_OF = "1998-01-01 00:00:00"


def _r(df: DataFrame) -> DataFrame:
    """Round every DOUBLE column to 6 places, keeping column order."""
    return df.select(*[F.round(F.col(f"`{f.name}`"), 6).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


# ---------------------------------------------------------------------------
# shared inputs
# ---------------------------------------------------------------------------

def _senders_v1(spark, sf, as_of=V.ORDERS_AS_OF):
    return SN.aggregate_and_score(V.mail_orders(spark, sf, as_of))


def _senders_v2(spark, sf):
    return SN.aggregate_and_score(V.mail_events(spark, sf))


def _gaz(spark, sf):
    return V.gazetteer(spark, sf, [("ORG", "newsletter")])


def _before_senders(spark, sf):
    m = V.mail_orders(spark, sf, BEFORE_AS_OF).where(F.col("ts") < F.lit(BEFORE_AS_OF).cast("timestamp"))
    return SN.aggregate_and_score(m)


def _flat_cache(cache: DataFrame) -> DataFrame:
    fmt = F.when(F.col("response").isNotNull(), F.lit("wrapped")).otherwise(F.lit("flat"))
    m = cache.select("id", fmt.alias("item_format"), "fetched_at", SC.response_of().alias("msg"))
    return m.select("id", "item_format", "fetched_at", F.col("msg.snippet").alias("snippet"),
                    F.array_join(F.col("msg.labelIds"), ",").alias("labels"),
                    F.size(F.col("msg.payload.headers")).cast("int").alias("n_headers"))


def _refresh(spark, sf):
    listing = V.mailbox(spark, sf)
    old = V.earlier_cache(spark, sf)
    return RP.audit(listing, old, lambda plan: V.fetch_results(spark, sf, plan), as_of=V.ORDERS_AS_OF)


# ---------------------------------------------------------------------------
# queries
# ---------------------------------------------------------------------------

def q_e1(spark, sf):
    return _r(_senders_v1(spark, sf))


def q_c13(spark, sf):
    return _r(SN.audit_summary(_senders_v1(spark, sf), 10))


def q_f1(spark, sf):
    return _r(SN.sort_by_score(_senders_v1(spark, sf)).select("from", "ignorance_score"))


def q_f2(spark, sf):
    return _r(SN.top_noise_makers(_senders_v1(spark, sf), 10))


def q_e2(spark, sf):
    return _r(MT.overall_metrics(_senders_v1(spark, sf)))


def q_e3(spark, sf):
    return _r(MT.distribution_summary(_senders_v2(spark, sf)))


def q_e4(spark, sf):
    return _r(MT.tier_overview(_senders_v1(spark, sf)))


def q_e5(spark, sf):
    return _r(MT.category_distribution(_senders_v1(spark, sf)))


def q_e6(spark, sf):
    return _r(SN.engagement_tiers(_senders_v1(spark, sf)))


def q_c12(spark, sf):
    return _r(SN.filter_matches(_senders_v2(spark, sf)))


def q_f3(spark, sf):
    return _r(SN.unsubscribe_candidates(_senders_v1(spark, sf), 5))


def q_f4(spark, sf):
    return _r(SN.review_candidates(_senders_v1(spark, sf), 5))


def q_f4b(spark, sf):
    return _r(SN.review_candidates(_senders_v1(spark, sf), 5, low_engagement_only=True))


def q_f5(spark, sf):
    return _r(SN.top_engaged(_senders_v1(spark, sf), 3))


def q_f6(spark, sf):
    s = _senders_v1(spark, sf)
    high, medium, low, zero = (SN.tier_listing(s, t) for t in ("high", "medium", "low", "zero"))
    return _r(high.unionByName(medium).unionByName(low).unionByName(zero))


def q_c10(spark, sf):
    return _r(SN.sender_lookup(_senders_v1(spark, sf), LOOKUP_PATTERN))


def q_j7(spark, sf):
    return _r(RP.sender_report(_senders_v2(spark, sf), "user1[0-9]@"))


def q_i1(spark, sf):
    before = MT.overall_metrics(_before_senders(spark, sf))
    after = MT.overall_metrics(_senders_v1(spark, sf))
    return _r(MT.compare_metrics(before, after))


def q_i2(spark, sf):
    return _r(MT.health_score(MT.overall_metrics(_senders_v1(spark, sf))))


def q_i3(spark, sf):
    return _r(MT.success_bands(_senders_v1(spark, sf)))


def q_c5(spark, sf):
    s = _senders_v1(spark, sf)
    total = s.agg(F.sum("total_volume").alias("_all"))     # one row: the cross join is a broadcast of it
    return _r(s.crossJoin(total).select("from", "total_volume",
                                        percentage("total_volume", "_all").alias("share_pct")))


def q_c5_text(spark, sf):
    s = _senders_v1(spark, sf)
    total = s.agg(F.sum("total_volume").alias("_all"))
    return _r(s.crossJoin(total).select("from", "total_volume", percentage("total_volume", "_all").alias("share_pct"),
                                        percentage_text("total_volume", "_all").alias("share_text")))


def q_c8_text(spark, sf):
    return CT.subject_words(V.mail_docs(spark, sf, True)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def q_c9_text(spark, sf):
    return CT.subject_class_counts(V.mail_docs(spark, sf, True))


def q_h1_labels(spark, sf):
    return CT.message_entities(V.mail_customers(spark, sf), V.customer_gazetteer(spark, sf)).select("id", "label", "entity")


def q_f8_labels(spark, sf):
    return CT.top_entities(V.mail_customers(spark, sf), V.customer_gazetteer(spark, sf), 5)


def q_c2(spark, sf):
    return MS.process_messages(V.mail_cache(spark, sf), V.mailbox(spark, sf), V.ORDERS_AS_OF)


def q_c1(spark, sf):
    return MS.extract(V.mail_cache(spark, sf), V.ORDERS_AS_OF).select("id", "from", "subject", "date")


def q_c3(spark, sf):
    return MS.extract(V.mail_cache(spark, sf), V.ORDERS_AS_OF).select("id", "date", "age_days")


def q_c4(spark, sf):
    return MS.extract(V.mail_cache(spark, sf), V.ORDERS_AS_OF).select(
        "id", "unread", "starred", "important", "social", "updates", "promotions")


def q_c11(spark, sf):
    return MS.drop_undated(MS.extract(V.mail_cache(spark, sf), V.ORDERS_AS_OF)).select("id", "from", "age_days")


def q_a3(spark, sf):
    return _flat_cache(V.mail_cache(spark, sf))


def q_a1(spark, sf):
    path = shared_dir(spark, "cache-json")
    SC.save_cache(V.mail_cache(spark, sf), path, "json")
    return _flat_cache(SC.load_cache(spark, path, "json"))


def q_a1_legacy(spark, sf):
    """One JSON object ``{id: item}`` per file, some two thousand messages each."""
    cache = V.mail_cache(spark, sf)
    files = cache.count() // 2000 + 1
    item = F.struct(*[c for c in cache.columns if c != "id"])
    objects = cache.groupBy(F.pmod(F.xxhash64("id"), F.lit(files)).alias("file")).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("id", item)))).alias("value"))
    path = shared_dir(spark, "cache-legacy")
    objects.repartition(files, "file").sortWithinPartitions("file").write.option("maxRecordsPerFile", 1).partitionBy(
        "file").text(path)
    return _flat_cache(SC.load_cache(spark, f"{path}/*/*.txt", "legacy"))


def q_a2(spark, sf):
    path = shared_dir(spark, "cache-parquet")
    SC.save_cache(V.mail_cache(spark, sf), path, "parquet")
    return _flat_cache(SC.load_cache(spark, path, "parquet"))


def q_a4(spark, sf):
    path = shared_dir(spark, "senders-csv")
    SIO.save_senders(_senders_v1(spark, sf), path, "csv")
    return _r(SIO.load_senders(spark, path, "csv"))


def q_a5(spark, sf):
    path = shared_dir(spark, "senders-parquet")
    SIO.save_senders(_senders_v1(spark, sf), path, "parquet")
    return _r(SIO.load_senders(spark, path, "parquet"))


def q_a6(spark, sf):
    lst = SL.bounded_listing(V.mailbox(spark, sf), 2000, exclude_labels=("TRASH", "CATEGORY_PROMOTIONS"))
    return lst.select("id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


def q_e1b(spark, sf):
    """E1 straight from the raw nested cache: written as JSON lines, read back, extracted, aggregated."""
    path = shared_dir(spark, "raw-cache-json")
    SC.save_cache(V.mail_cache(spark, sf), path, "json")
    return _r(SN.aggregate_and_score(MS.extract(SC.load_cache(spark, path, "json"), V.ORDERS_AS_OF)))


def q_s1(spark, sf):
    """The streaming incremental audit: the cache arrives as two file batches (orders before 1998, then the
    rest plus a fresh fetch of every open order); the final sender table is E1 over the whole cache."""
    root = shared_dir(spark, "stream-audit")
    orders = V.table(spark, sf, "orders")
    early = orders.where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    late = orders.where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    refetch = (V.cache_rows(orders.where(F.col("o_orderstatus") == "O"))
               .withColumn("fetched_at", F.lit("2001-08-31T00:00:00+00:00")))
    V.cache_rows(early).write.mode("overwrite").json(f"{root}/incoming/b1")
    V.cache_rows(late).unionByName(refetch).write.mode("overwrite").json(f"{root}/incoming/b2")
    # one micro-batch takes as many files as the first delivery has (a file list, not the data)
    per_batch = max(1, len(spark.read.json(f"{root}/incoming/b1").inputFiles()))
    paths = AuditPaths(f"{root}/incoming/*", f"{root}/log", f"{root}/checkpoint", target=20_000, every=2)
    start_incremental_audit(spark, paths, "json", as_of=V.ORDERS_AS_OF,
                            max_files_per_trigger=per_batch).awaitTermination()
    return _r(current_senders(spark, paths))


def q_b1(spark, sf):
    return RF.stale_entries(V.mail_cache(spark, sf), 7, V.ORDERS_AS_OF).select("id", "stale")


def q_b2(spark, sf):
    return _refresh(spark, sf)["plan"]


def q_b3(spark, sf):
    listing = V.mailbox(spark, sf)
    old = V.earlier_cache(spark, sf)
    plan = RF.fetch_plan(listing, old, False, 7, V.ORDERS_AS_OF)
    return RF.upsert(old, V.fetch_results(spark, sf, plan)).select("id", "fetched_at")


def q_b3_feed(spark, sf):
    return _refresh(spark, sf)["changes"]


def _mail_service(spark, sf) -> dict:
    """The mailbox of the refresh scenario behind a mail service; messages in status P can't be fetched."""
    box = V.mailbox(spark, sf)
    MB.register(spark, "mailbox", MB.ExportedMailbox)
    return MB.export(box, V.fetch_results(spark, sf, box), shared_dir(spark, "mail-service"))


def q_a6_source(spark, sf):
    box = MB.listing(spark, "mailbox", **_mail_service(spark, sf))
    lst = SL.bounded_listing(box, 2000, exclude_labels=("TRASH", "CATEGORY_PROMOTIONS"))
    return lst.select("id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


def q_a6_bounds(spark, sf):
    """Time bounds are pushed into the source, which skips the pages outside of them."""
    box = MB.listing(spark, "mailbox", **_mail_service(spark, sf))
    some = box.where((F.col("ts") >= F.lit("1997-03-01").cast("timestamp")) & (F.col("ts") < F.lit("1997-06-01").cast("timestamp")))
    return some.select("id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.array_join("labelIds", ",").alias("labels"))


def q_a6_stream(spark, sf):
    """The listing as a stream, page by page, into a table."""
    options, path = _mail_service(spark, sf), shared_dir(spark, "listing-stream")
    pages = spark.readStream.format("mailbox").options(**options).load()
    q = pages.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(
        availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(MB.LISTING).parquet(f"{path}/rows").select("id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


def q_j1_source(spark, sf):
    """The audit with listing and fetch through the mail service's data source."""
    options = _mail_service(spark, sf)
    found = RP.audit(MB.listing(spark, "mailbox", **options), V.earlier_cache(spark, sf),
                     lambda plan: MB.fetch(spark, plan, "mailbox", requests=8, **options), as_of=V.ORDERS_AS_OF)
    return _r(found["senders"])


def q_b4(spark, sf):
    return _refresh(spark, sf)["removed"].select("id")


def q_j1(spark, sf):
    return _r(_refresh(spark, sf)["senders"])


def q_d1(spark, sf):
    return MS.process_messages(V.earlier_cache(spark, sf), V.mailbox(spark, sf), V.ORDERS_AS_OF).select("id", "from")


def q_d2(spark, sf):
    c = V.earlier_cache(spark, sf).select("id", "fetched_at", F.lit(True).alias("_c"))
    j = V.mailbox(spark, sf).select("id").join(c, "id", "left")
    return j.select("id", F.coalesce("_c", F.lit(False)).alias("cached"), "fetched_at")


def q_d3(spark, sf):
    kept, removed = RF.prune(V.earlier_cache(spark, sf), V.mailbox(spark, sf))
    return kept.select("id", F.lit(True).alias("listed")).unionByName(
        removed.select("id", F.lit(False).alias("listed")))


def q_d_bucketed(spark, sf):
    """D1 to D3 over a cache kept in buckets by id: only the listing is shuffled."""
    cache = SB.load_bucketed(spark, SB.save_bucketed(V.earlier_cache(spark, sf), 8))
    return SB.listing_state(V.mailbox(spark, sf), cache)


def q_e_running(spark, sf):
    return _r(SH.running_shares(_senders_v1(spark, sf)))


def q_e_holders(spark, sf):
    return _r(SH.smallest_holders(_senders_v1(spark, sf), 80.0).select("from", "total_volume", "place"))


def q_e_cube(spark, sf):
    return _r(SH.engagement_cube(V.mail_orders(spark, sf)))


def q_d4(spark, sf):
    top = SN.top_senders_for_patterns(_senders_v2(spark, sf), 5, "volume").select("from")
    return CT.sender_snippets(V.mail_events(spark, sf)).join(F.broadcast(top), "from").select("from", "id")


def q_d5(spark, sf):
    return CT.first_subject(V.mail_docs(spark, sf))


def q_c6(spark, sf):
    return CT.cleaned(V.mail_docs(spark, sf))


def q_c7(spark, sf):
    k = CT.message_keywords(V.mail_docs(spark, sf))
    return k.groupBy("id", "keyword").agg(F.count(F.lit(1)).alias("n"))


def q_c8(spark, sf):
    return CT.subject_words(V.mail_docs(spark, sf)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def q_c9(spark, sf):
    return CT.subject_class_counts(V.mail_docs(spark, sf))


def q_c9_events(spark, sf):
    return CT.subject_class_counts(V.mail_events(spark, sf))


def q_e7(spark, sf):
    return CT.sender_subjects(V.mail_docs(spark, sf))


def q_e7_cache(spark, sf):
    return CT.cache_subjects(V.mail_cache(spark, sf))


def q_e8(spark, sf):
    return CT.sender_snippets(V.mail_events(spark, sf))


def q_e9(spark, sf):
    return CT.top_senders_by_subjects(V.mail_events(spark, sf), 10)


def q_e10(spark, sf):
    return CT.keyword_counts(V.mail_docs(spark, sf))


def q_f7(spark, sf):
    return CT.top_keywords(V.mail_docs(spark, sf), 10)


def q_e13(spark, sf):
    return CT.snippet_counts(V.mail_events(spark, sf))


def q_f12(spark, sf):
    return _r(SN.top_senders_for_patterns(_senders_v2(spark, sf), 5, "volume")
              .select("from", "total_volume", "ignorance_score", "rank"))


def q_f12b(spark, sf):
    return _r(SN.top_senders_for_patterns(_senders_v2(spark, sf), 5, "ignorance")
              .select("from", "total_volume", "ignorance_score", "rank"))


def q_h1(spark, sf):
    return CT.message_entities(V.mail_events(spark, sf), _gaz(spark, sf)).select("id", "label", "entity")


def q_e11(spark, sf):
    return CT.entity_counts(V.mail_events(spark, sf), _gaz(spark, sf))


def q_f8(spark, sf):
    return CT.top_entities(V.mail_events(spark, sf), _gaz(spark, sf), 5)


def q_h2(spark, sf):
    t = CT.top_intents(V.mail_events(spark, sf), 1, "id", _gaz(spark, sf), per_row=True)
    return t.select("id", "intent", "score")


def q_h2_scores(spark, sf):
    s = CT.intent_scores(CT.sender_snippets(V.mail_events(spark, sf)), "from", _gaz(spark, sf))
    return s.select("from", "intent", "score")


def q_f9(spark, sf):
    return CT.top_intents(CT.sender_snippets(V.mail_events(spark, sf)), 3, "from", _gaz(spark, sf))


def q_h4(spark, sf):
    return RP.analyze_patterns(V.mail_events(spark, sf), _senders_v2(spark, sf), 5, "volume",
                               gazetteer=_gaz(spark, sf))


def q_h3(spark, sf):
    return RP.analyze_patterns(V.mail_events(spark, sf), _senders_v2(spark, sf), 5, "volume",
                               content_features=False, gazetteer=_gaz(spark, sf))


def q_j5(spark, sf):
    return RP.analyze_patterns(V.mail_events(spark, sf), _senders_v2(spark, sf), 5, "ignorance",
                               gazetteer=_gaz(spark, sf), hide_zero_intents=True)


def q_i4(spark, sf):
    ev = V.mail_events(spark, sf)
    top = CT.top_intents(CT.sender_snippets(ev), 1, "from", _gaz(spark, sf))
    return _r(RL.recommend_actions(SN.aggregate_and_score(ev), top))


def q_g1(spark, sf):
    return _r(CL.feature_table(_senders_v1(spark, sf)))


def q_g2(spark, sf):
    return _r(CL.standardize(CL.feature_table(_senders_v1(spark, sf))))


def q_g3(spark, sf):
    """What holds for the best of ten starts, whatever the random numbers: one row of facts."""
    s = _senders_v1(spark, sf)
    found, costs = CL.cluster_senders_with_costs(s, 5)
    means = found.join(s, "from").groupBy("cluster").agg(F.avg("open_rate").alias("o"))
    order = means.agg(F.count(F.lit(1)).alias("clusters"), F.sort_array(F.collect_list(F.struct("cluster", "o"))).alias("m"))
    rising = F.forall(F.sequence(F.lit(1), F.size("m") - 1), lambda i: F.element_at("m", i)["o"] <= F.element_at("m", i + 1)["o"])
    cost = CL.cost_of(found, s)
    facts = s.agg(F.count(F.lit(1)).alias("senders")).crossJoin(found.agg(F.count_distinct("from").alias("assigned"))).crossJoin(
        order.select("clusters", rising.alias("ids_follow_open_rate"))).crossJoin(cost)
    return facts.select("senders", "assigned", "clusters", "ids_follow_open_rate",
                        (F.col("cost") <= F.lit(min(costs) * (1 + 1e-6))).alias("cheapest_of_the_starts"),
                        (F.col("cost") < F.col("one_cluster_cost")).alias("beats_one_cluster"))


def q_g4(spark, sf):
    raw = _senders_v1(spark, sf).select("from", (F.col("total_volume") % 7).cast("int").alias("raw_cluster"), "open_rate",
                                        "ignorance_score")
    return CL.stable_ids(raw)


def _tier_clusters(s):
    """A cluster table that SQL can state too: tier numbers, senders without a tier in cluster 4."""
    rank = F.coalesce(tier_rank(SN.engagement_tier("open_rate")) - 1, F.lit(4))
    return s.select("from", rank.cast("int").alias("cluster"))


def q_e12(spark, sf):
    s = _senders_v1(spark, sf)
    return _r(CL.cluster_stats(_tier_clusters(s), s))


def q_f10(spark, sf):
    s = _senders_v1(spark, sf)
    ranked = CL.cluster_stats(_tier_clusters(s), s)
    place = F.row_number().over(Window.orderBy("avg_open_rate", "cluster"))      # five rows
    return _r(ranked.select("cluster", "avg_open_rate", place.cast("long").alias("place")))


def q_f11(spark, sf):
    s = _senders_v1(spark, sf)
    return _r(CL.top_per_cluster(_tier_clusters(s), s, 5))


def q_d6(spark, sf):
    s = _senders_v1(spark, sf)
    return _r(CL.cluster_members(_tier_clusters(s), s).select("from", "cluster", "total_volume", "open_rate", "ignorance_score"))


def q_j6(spark, sf):
    s = _senders_v1(spark, sf)
    return _r(RP.cluster_report(RP.analyze_clusters(s, clusters=_tier_clusters(s))))


def q_j2(spark, sf):
    return _r(RP.generate_report(_senders_v1(spark, sf)))


def q_j2_brief(spark, sf):
    return _r(RP.generate_report(_senders_v1(spark, sf), brief=True))


def q_j3(spark, sf):
    before = MT.overall_metrics(_before_senders(spark, sf))
    return _r(RP.cleanup_report(_senders_v1(spark, sf), before))


def q_j4(spark, sf):
    return _r(RP.analyze_engagement(_senders_v1(spark, sf), "all"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "a1_load_cache": q_a1,
    "a1_load_legacy_cache": q_a1_legacy,
    "c5_percentage_text": q_c5_text,
    "c8_filter_common_words_text": q_c8_text,
    "c9_subject_classes_text": q_c9_text,
    "h1_extract_entities_all_labels": q_h1_labels,
    "f8_top_entities_all_labels": q_f8_labels,
    "g4_stable_ids": q_g4,
    "a2_save_cache": q_a2,
    "a3_unwrap_response": q_a3,
    "a4_load_audit_data": q_a4,
    "a5_save_report": q_a5,
    "a6_bounded_listing": q_a6,
    "b1_stale_entries": q_b1,
    "b2_fetch_plan": q_b2,
    "b3_upsert_fetched": q_b3,
    "b3b_change_feed": q_b3_feed,
    "a6b_mailbox_source": q_a6_source,
    "a6c_mailbox_time_bounds": q_a6_bounds,
    "a6d_mailbox_stream": q_a6_stream,
    "j1b_audit_mailbox_source": q_j1_source,
    "b4_prune_cache": q_b4,
    "c1_get_header": q_c1,
    "c2_process_messages": q_c2,
    "c3_age_days": q_c3,
    "c4_label_flags": q_c4,
    "c5_percentage": q_c5,
    "c6_preprocess_text": q_c6,
    "c7_extract_keywords": q_c7,
    "c8_filter_common_words": q_c8,
    "c9_subject_classes": q_c9,
    "c9_subject_classes_events": q_c9_events,
    "c10_sender_lookup": q_c10,
    "c11_drop_undated": q_c11,
    "c12_sender_filters": q_c12,
    "c13_audit_summary": q_c13,
    "d1_listing_cache_inner": q_d1,
    "d2_listing_cache_left": q_d2,
    "d3_cache_listing_semi_anti": q_d3,
    "d1d2d3_bucketed_cache": q_d_bucketed,
    "e14_running_shares": q_e_running,
    "e14b_smallest_holders": q_e_holders,
    "e15_tier_category_month": q_e_cube,
    "d4_top_senders_snippets": q_d4,
    "d5_first_subject": q_d5,
    "d6_cluster_metrics_join": q_d6,
    "e1_aggregate_and_score": q_e1,
    "e1b_aggregate_from_raw_cache": q_e1b,
    "e2_overall_metrics": q_e2,
    "e3_distribution_summary": q_e3,
    "e4_tier_overview": q_e4,
    "e5_category_distribution": q_e5,
    "e6_engagement_tiers": q_e6,
    "e7_sender_subjects": q_e7,
    "e7b_cache_subjects": q_e7_cache,
    "e8_sender_snippets": q_e8,
    "e9_top_senders_by_volume": q_e9,
    "e10_keyword_frequency": q_e10,
    "e11_entity_frequency": q_e11,
    "e12_cluster_stats": q_e12,
    "e13_snippet_counts": q_e13,
    "f1_sort_by_score": q_f1,
    "f2_top_noise_makers": q_f2,
    "f3_unsubscribe_candidates": q_f3,
    "f4_review_candidates": q_f4,
    "f4b_review_low_engagement": q_f4b,
    "f5_top_engaged": q_f5,
    "f6_tier_listing": q_f6,
    "f7_top_keywords": q_f7,
    "f8_top_entities": q_f8,
    "f9_top_intents": q_f9,
    "f10_clusters_by_open_rate": q_f10,
    "f11_top_per_cluster": q_f11,
    "f12_pattern_senders_by_volume": q_f12,
    "f12b_pattern_senders_by_ignorance": q_f12b,
    "g1_feature_table": q_g1,
    "g2_standardize": q_g2,
    "g3_cluster_senders": q_g3,
    "h1_extract_entities": q_h1,
    "h2_infer_intent": q_h2,
    "h2_intent_scores": q_h2_scores,
    "h3_patterns_without_nlp": q_h3,
    "h4_title_patterns": q_h4,
    "i1_compare_metrics": q_i1,
    "i2_health_score": q_i2,
    "i3_success_bands": q_i3,
    "i4_intent_actions": q_i4,
    "j1_audit": q_j1,
    "j2_report": q_j2,
    "j2_brief_report": q_j2_brief,
    "j3_cleanup_report": q_j3,
    "j4_engagement": q_j4,
    "j5_analyze_patterns": q_j5,
    "j6_analyze_clusters": q_j6,
    "j7_sender": q_j7,
    "s1_incremental_audit_stream": q_s1,
}


def _in_utc(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Ages are whole UTC days: pin the session zone before the plan is analysed."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the audit's top-10 noise makers over sf0.001."""
    return _in_utc(q_c13)(spark, FLAGSHIP_SF)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _in_utc(v) for k, v in {**QUERIES, **LLM_QUERIES}.items()}


def oracle_sql() -> dict[str, str]:
    from inboxlens.fixtures.oracle_queries import ORACLES
    return {k: v for k, v in {**ORACLES, **LLM_ORACLES}.items() if k in QUERIES or k in LLM_QUERIES}
