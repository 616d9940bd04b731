"""One sender holding a third of all mail: results stay whole and the plans
stay partial-aggregated (no task receives the hot sender's raw rows)."""

from pyspark.sql import functions as F

from inboxlens.fixtures import views as V
from inboxlens.operators import content as CT
from inboxlens.operators import senders as SN
from tests.conftest import SF01


def _skewed_orders(spark):
    m = V.mail_orders(spark, SF01)
    hot = (F.abs(F.hash("id")) % 3) == 0            # about a third of the rows
    return m.withColumn("from", F.when(hot, F.lit("hot@example.com")).otherwise(F.col("from")))


def test_hot_sender_volume_whole(spark):
    m = _skewed_orders(spark)
    s = SN.aggregate_and_score(m)
    hot = s.where(F.col("from") == "hot@example.com").first()
    want = m.where((F.col("from") == "hot@example.com") & F.col("age_days").isNotNull()).count()
    assert hot.total_volume == want and want > m.count() / 4
    assert s.agg(F.sum("total_volume")).first()[0] == m.where(F.col("age_days").isNotNull()).count()
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan


def test_hot_sender_keywords(spark):
    docs = V.mail_docs(spark, SF01)
    hot = (F.abs(F.hash("id")) % 3) == 0
    docs = docs.withColumn("from", F.when(hot, F.lit("hot@example.com")).otherwise(F.col("from")))
    top = CT.top_keywords(docs, 10)
    rows = top.where(F.col("from") == "hot@example.com").orderBy("rank").collect()
    assert len(rows) == 10
    brute = (CT.keyword_counts(docs).where(F.col("from") == "hot@example.com")
             .orderBy(F.col("n").desc(), F.col("keyword")).limit(10).collect())
    assert [(r.keyword, r.n) for r in rows] == [(r.keyword, r.n) for r in brute]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
