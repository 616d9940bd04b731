import pytest

from inboxlens.operators import metrics as MT
from inboxlens.operators import senders as SN
from tests.fixtures import as_dict, f1, f2, f3


def test_aggregate_and_score_f3(spark):
    out = as_dict(SN.aggregate_and_score(f3(spark)))
    s1, s2 = out["sender1@example.com"], out["sender2@example.com"]
    assert (s1["total_volume"], s1["unread_count"], s1["starred_count"], s1["important_count"]) == (2, 1, 1, 0)
    assert (s1["social_count"], s1["updates_count"], s1["promotions_count"]) == (0, 1, 0)
    assert s1["open_rate"] == 50.0 and s1["ignorance_score"] == 100.0
    assert s1["avg_recency_days"] == 1.5
    assert (s2["total_volume"], s2["unread_count"]) == (3, 2)
    assert s2["open_rate"] == pytest.approx(33.333333, rel=1e-6)
    assert s2["ignorance_score"] == pytest.approx(200.0)


def test_aggregate_drops_undated_and_sorts_by_score(spark):
    df = f3(spark).unionByName(spark.createDataFrame(
        [("sender3@example.com", "id6", True, False, False, False, False, False, None)], f3(spark).schema))
    out = SN.sort_by_score(SN.aggregate_and_score(df)).collect()
    assert [r["from"] for r in out] == ["sender2@example.com", "sender1@example.com"]


def test_aggregate_empty(spark):
    assert SN.aggregate_and_score(f3(spark).limit(0)).count() == 0


def test_overall_metrics_f1(spark):
    m = MT.overall_metrics(f1(spark)).first()
    assert m.total_emails == 63
    assert m.unread_percentage == pytest.approx(46 / 63 * 100)
    assert m.average_open_rate == pytest.approx(40.0)
    assert m.senders_never_opened == 1
    assert m.top_ignorance_score == 2250
    assert m.total_senders == 5


def test_overall_metrics_empty(spark):
    m = MT.overall_metrics(f1(spark).limit(0)).first()
    assert (m.total_emails, m.unread_percentage, m.average_open_rate, m.senders_never_opened,
            m.top_ignorance_score) == (0, 0.0, 0.0, 0, 0.0)


def test_top_noise_makers(spark):
    top = [r.ignorance_score for r in SN.top_noise_makers(f1(spark), 3).collect()]
    assert top == [2250, 1500, 500]
    assert SN.top_noise_makers(f1(spark), 10).count() == 5
    assert SN.top_noise_makers(f1(spark).limit(0), 10).count() == 0


def test_sender_lookup(spark):
    hit = SN.sender_lookup(f1(spark), "newsletter").collect()
    assert len(hit) == 1 and hit[0].sender == "newsletter@company.com"
    assert hit[0].total_emails == 25 and hit[0].unread_count == 22
    assert SN.sender_lookup(f1(spark), "nonexistent").count() == 0
    assert SN.sender_lookup(f1(spark), "NEWSLETTER").count() == 1
    assert SN.sender_lookup(f1(spark), "company.com", literal=True).count() == 1


def test_tiers_f1(spark):
    t = {r["from"]: r.tier for r in SN.engagement_tiers(f1(spark)).collect()}
    assert t == {"bank@bank.com": "high", "test@example.com": "medium", "important@service.com": "medium",
                 "newsletter@company.com": "low", "promo@store.com": "zero"}


def test_tier_edges(spark):
    rates = [0.0, 0.5, 1.0, 49.99, 50.0, 79.99, 80.0, 100.0]
    want = ["zero", None, "low", "low", "medium", "medium", "high", "high"]
    df = spark.createDataFrame([(f"s{i}", r) for i, r in enumerate(rates)], "from string, open_rate double")
    got = {r["from"]: r.tier for r in SN.with_tier(df).collect()}
    assert [got[f"s{i}"] for i in range(len(rates))] == want


def test_category_distribution_f2(spark):
    rows = [(r.category, r.emails, round(r.share_pct, 1)) for r in MT.category_distribution(f2(spark)).collect()]
    assert rows == [("Updates", 30, 47.6), ("Promotions", 22, 34.9), ("Important", 11, 17.5)]


def test_distribution_f2(spark):
    d = MT.distribution_summary(f2(spark)).first()
    assert (d.zero_open_senders, d.zero_open_emails, round(d.zero_open_pct, 1)) == (1, 15, 23.8)
    assert (d.high_volume_senders, d.high_volume_emails) == (0, 0)
    assert d.top10_volume_emails == 63


def test_recommendations_f2(spark):
    assert [r["from"] for r in SN.review_candidates(f2(spark), 5).collect()] == ["newsletter@company.com"]
    assert [r["from"] for r in SN.review_candidates(f2(spark), 5, True).collect()] == ["newsletter@company.com"]
    assert [r["from"] for r in SN.top_engaged(f2(spark), 3).collect()] == ["bank@bank.com"]
    assert [r["from"] for r in SN.unsubscribe_candidates(f2(spark), 5).collect()] == ["promo@store.com"]


def test_tier_listing(spark):
    rows = SN.tier_listing(f1(spark), "medium").collect()
    assert [r["from"] for r in rows] == ["test@example.com", "important@service.com"]
    with pytest.raises(ValueError):
        SN.tier_listing(f1(spark), "bogus")


def test_tier_overview(spark):
    rows = MT.tier_overview(f1(spark)).collect()
    assert [(r.tier, r.senders, r.emails) for r in rows] == [("high", 1, 5), ("medium", 2, 18), ("low", 1, 25),
                                                             ("zero", 1, 15)]


def test_filter_matches(spark):
    got = sorted((r["from"], r.filter) for r in SN.filter_matches(f1(spark)).collect())
    assert ("promo@store.com", "never_opened") in got
    assert ("newsletter@company.com", "at_least_20_low_open") in got
    assert not any(f == "over_50" for _, f in got)


def test_pattern_sender_choice(spark):
    by_vol = [r["from"] for r in SN.top_senders_for_patterns(f1(spark), 2, "volume").collect()]
    assert by_vol == ["newsletter@company.com", "promo@store.com"]
    with pytest.raises(ValueError):
        SN.top_senders_for_patterns(f1(spark), 2, "bogus")


def test_weighted_equals_replicated(spark):
    from pyspark.sql import functions as F
    base = f3(spark).withColumn("w", F.when(F.col("id") == "id3", 3).otherwise(1))
    replicated = base.withColumn("_r", F.explode(F.sequence(F.lit(1), F.col("w")))).drop("_r")
    a = sorted(SN.aggregate_and_score(replicated.drop("w")).collect())
    b = sorted(SN.aggregate_and_score(base, weight="w").collect())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x["from"] == y["from"] and x.total_volume == y.total_volume and x.unread_count == y.unread_count
        assert x.avg_recency_days == pytest.approx(y.avg_recency_days)
        assert x.ignorance_score == pytest.approx(y.ignorance_score)
