"""Composite reports on the F2 sender table (values the audited tool's command tests assert)."""

from inboxlens.plans import reports as RP
from tests.fixtures import f1, f2


def _rows(df):
    return {(r.section, r.rank, r.item, r.metric): r.value for r in df.collect()}


def test_full_report(spark):
    r = _rows(RP.generate_report(f2(spark)))
    assert r[("status", None, None, "total_senders")] == 5 and r[("status", None, None, "total_emails")] == 63
    assert r[("categories", 1, "Updates", "emails")] == 30
    assert ("categories", 3, "Social", "emails") not in r
    assert r[("top_noise_makers", 1, "newsletter@company.com", "ignorance_score")] == 2250
    assert r[("unsubscribe", 1, "promo@store.com", "total_volume")] == 15
    assert r[("review", 1, "newsletter@company.com", "total_volume")] == 25
    assert r[("keep", 1, "bank@bank.com", "total_volume")] == 5
    assert round(r[("distribution", None, None, "zero_open_pct")], 1) == 23.8
    assert r[("engagement", 2, "Medium Engagement (50-79%)", "senders")] == 2


def test_brief_report(spark):
    r = _rows(RP.generate_report(f2(spark), brief=True))
    assert [k for k in r if k[0] == "top_priorities" and k[3] == "ignorance_score"] == [
        ("top_priorities", 1, "newsletter@company.com", "ignorance_score"),
        ("top_priorities", 2, "promo@store.com", "ignorance_score"),
        ("top_priorities", 3, "test@example.com", "ignorance_score")]
    assert r[("status", None, None, "total_emails")] == 63


def test_cleanup_report_with_baseline(spark):
    from inboxlens.operators import metrics as MT
    base = MT.overall_metrics(f1(spark).where("`from` != 'bank@bank.com'"))
    r = _rows(RP.cleanup_report(f1(spark), base))
    assert r[("status", None, None, "total_senders")] == 5
    assert r[("improvement", None, None, "top_score_reduction")] == 0
    assert r[("review", 1, "newsletter@company.com", "open_rate")] == 10.0


def test_engagement(spark):
    r = _rows(RP.analyze_engagement(f1(spark), "all"))
    assert r[("tiers", 1, "High Engagement (80-100%)", "senders")] == 1
    assert r[("top_high_engagement", 1, "bank@bank.com", "total_volume")] == 5
    zero = RP.analyze_engagement(f1(spark), "zero").collect()
    assert [x["from"] for x in zero] == ["promo@store.com"]


def test_clusters_report(spark):
    out = RP.analyze_clusters(f1(spark), 3)
    stats = out["stats"].collect()
    assert sum(r.senders for r in stats) == 5 and sum(r.total_emails for r in stats) == 63
    assert [r.cluster for r in stats] == [0, 1, 2]
    assert RP.analyze_clusters(f1(spark).limit(2), 5)["clusters"].count() == 0
