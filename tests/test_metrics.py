import pytest

from inboxlens.functions.numbers import percentage, percentage_text
from inboxlens.operators import metrics as MT


def _m(spark, unread, top, open_rate):
    return spark.createDataFrame([(unread, top, open_rate)],
                                 "unread_percentage double, top_ignorance_score double, average_open_rate double")


def test_compare_metrics(spark):
    c = MT.compare_metrics(_m(spark, 80.0, 3000.0, 10.0), _m(spark, 70.0, 2000.0, 15.0)).first()
    assert c.unread_improvement == 10.0 and c.top_score_reduction == 1000.0
    assert c.top_score_reduction_pct == pytest.approx(33.333333, rel=1e-6)
    assert c.open_rate_improvement == 5.0


def test_compare_identical_and_zero(spark):
    c = MT.compare_metrics(_m(spark, 50.0, 100.0, 5.0), _m(spark, 50.0, 100.0, 5.0)).first()
    assert (c.unread_improvement, c.top_score_reduction, c.top_score_reduction_pct, c.open_rate_improvement) == \
        (0.0, 0.0, 0.0, 0.0)
    z = MT.compare_metrics(_m(spark, 0.0, 0.0, 0.0), _m(spark, 0.0, 0.0, 0.0)).first()
    assert z.top_score_reduction_pct is None


def test_percentage(spark):
    df = spark.createDataFrame([(25, 100), (1, 3), (0, 100), (0, 0)], "v long, t long")
    out = df.select(percentage("v", "t").alias("p"), percentage_text("v", "t").alias("s")).collect()
    assert [r.s for r in out] == ["25.0%", "33.3%", "0.0%", "0.0%"]
    assert out[1].p == pytest.approx(100 / 3)


def test_health_score(spark):
    m = spark.createDataFrame([(90.0, 10.0), (50.0, 50.0), (100.0, 0.0)],
                              "average_open_rate double, unread_percentage double")
    got = [(r.health_score, r.health_band) for r in MT.health_score(m).collect()]
    assert got == [(90.0, "Excellent"), (50.0, "Critical"), (100.0, "Excellent")]


def test_success_bands(spark):
    from tests.fixtures import f1
    b = MT.success_bands(f1(spark)).first()
    assert b.unread_rate == pytest.approx(46 / 63 * 100) and b.unread_band == "Needs attention"
    assert b.zero_engagement_share == pytest.approx(20.0) and b.zero_engagement_band == "Problematic"
    assert b.high_engagement_band is None
