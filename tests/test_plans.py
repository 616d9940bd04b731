"""Plan-shape checks: the physical plans we rely on for scale."""

from inboxlens.fixtures import views as V
from inboxlens.operators import clusters as CL
from inboxlens.operators import content as CT
from inboxlens.operators import metrics as MT
from inboxlens.operators import senders as SN
from inboxlens.sources import listing as SL
from tests.conftest import SF001


def _plan(df):
    df.write.format("noop").mode("overwrite").save()   # run so AQE shows its final plan
    return df._jdf.queryExecution().executedPlan().toString()


def test_e1_partial_aggregation_and_pruning(spark):
    s = SN.aggregate_and_score(V.mail_orders(spark, SF001))
    p = s._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in p and "PythonUDF" not in p
    scan = V.mail_orders(spark, SF001).select("from")._jdf.queryExecution().executedPlan().toString()
    assert "o_orderpriority" not in scan.split("ReadSchema")[-1].split("\n")[0]


def test_listing_pushdown_and_topn(spark):
    lst = SL.bounded_listing(V.mailbox(spark, SF001), 100)
    p = lst._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in p
    assert "GreaterThanOrEqual(o_orderdate" in p


def test_keyword_topk_uses_group_limit(spark):
    p = CT.top_keywords(V.mail_docs(spark, SF001), 10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in p


def test_small_dimensions_broadcast(spark):
    msgs = V.mail_events(spark, SF001)
    p = _plan(CT.intent_scores(CT.sender_snippets(msgs), "from"))
    assert "BroadcastHashJoin" in p


def test_counts_gather_nothing_and_tokenise_once(spark):
    docs = V.mail_docs(spark, SF001)
    events = V.mail_events(spark, SF001)
    gaz = V.gazetteer(spark, SF001, [("ORG", "newsletter")])
    for df in (CT.keyword_counts(docs), CT.entity_counts(events, gaz), CT.intent_scores(events, "from", gaz)):
        p = _plan(df)
        assert "collect_list" not in p and "PythonUDF" not in p
    p = _plan(CT.top_intents(events, 3, "from", gaz))
    assert "Window" not in p                          # ranking is row-local
    p = _plan(CT.top_intents(events, 3, "from"))
    assert p.count("Generate explode") == 1          # the words of each text are exploded once


def test_no_query_input_is_repartitioned_and_the_sender_table_is_not_sorted(spark):
    s = SN.aggregate_and_score(V.mail_orders(spark, SF001))
    p = _plan(s)
    assert "RoundRobin" not in p and "rangepartitioning" not in p and p.count("Exchange hashpartitioning") == 1
    p = _plan(MT.tier_overview(s))
    assert p.count("Scan parquet") == 1
    assert "rangepartitioning" not in _plan(SN.engagement_tiers(s))

def test_cluster_topk_uses_group_limit(spark):
    from inboxlens.operators import clusters as CL
    s = SN.aggregate_and_score(V.mail_orders(spark, SF001))
    c = CL.cluster_senders(s, 3, starts=2)
    assert "WindowGroupLimit" in _plan(CL.top_per_cluster(c, s, 5))


def test_audit_reads_the_cache_bodies_once(spark):
    from inboxlens.operators import refresh as RF
    cache = V.earlier_cache(spark, SF001)
    fetched = V.fetch_results(spark, SF001, V.mailbox(spark, SF001))
    p = RF.changes(cache, fetched)._jdf.queryExecution().executedPlan().toString()
    bodies = [line for line in p.split("\n") if "FileScan" in line and "o_orderpriority#" in line]   # long schemas are cut
    # One scan of the cache, one of what was fetched, one full outer join.
    assert len(bodies) == 2 and p.count("FullOuter") == 1 and p.count("Join") == p.count("FullOuter") + p.count("LeftSemi")


def test_intents_of_single_messages_and_cluster_features_need_no_shuffle(spark):
    events = V.mail_events(spark, SF001)
    p = _plan(CT.top_intents(events, 1, "id", per_row=True))
    assert "Exchange" not in p and "Generate explode" not in p
    by_row = {tuple(r) for r in CT.intent_scores(events, "id", per_row=True).collect()}
    assert by_row == {tuple(r) for r in CT.intent_scores(events, "id").collect()}
    scaled = CL.standardize(CL.feature_table(SN.aggregate_and_score(V.mail_orders(spark, SF001))), keep=("open_rate",))
    assert "SortMergeJoin" not in _plan(scaled) and "_raw_open_rate" in scaled.columns


def test_a_repeated_sender_is_clustered_once_for_each_row(spark):
    rows = [("a", 1, 0, 0.0, 1.0), ("a", 1, 0, 0.0, 1.0), ("b", 90, 3, 80.0, 2.0), ("c", 50, 9, 10.0, 9.0)]
    senders = spark.createDataFrame(rows, "`from` string, total_volume long, unread_count long, open_rate double, ignorance_score double")
    got = CL.cluster_senders(senders, 2, starts=2).collect()
    assert sorted(r["from"] for r in got) == ["a", "a", "b", "c"]


def test_subject_classes_run_in_generated_code(spark):
    df = CT.subject_class_counts(CT.sender_subjects(V.mail_events(spark, SF001)))
    assert "exists(" not in _plan(df)
