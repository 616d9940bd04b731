"""Running shares, the counts over several dimensions, and caches kept in buckets."""

import random

import pytest
from pyspark.sql import functions as F

from inboxlens.fixtures import views as V
from inboxlens.operators import refresh as RF
from inboxlens.operators import shares as SH
from inboxlens.sources import bucketed as SB
from tests.conftest import SF001


@pytest.mark.parametrize("ranges", [1, 7, None])
def test_running_shares_equal_a_plain_loop(spark, ranges):
    rnd = random.Random(3)
    rows = [(f"s{k}", rnd.choice([0, 1, 1, 1, 2, 5, 900])) for k in range(500)] + [("none", None)]
    got = SH.running_shares(spark.createDataFrame(rows, "from string, total_volume long"), ranges=ranges).collect()
    total, run = sum(n or 0 for _, n in rows), 0
    want = sorted(((who, n or 0) for who, n in rows), key=lambda r: (-r[1], r[0]))
    by = {r["from"]: r for r in got}
    for place, (who, n) in enumerate(want, 1):
        run += n
        assert (by[who]["place"], by[who]["running"]) == (place, run) and abs(by[who]["share_pct"] - run / total * 100) < 1e-9
    few = SH.smallest_holders(spark.createDataFrame(rows, "from string, total_volume long"), 80.0, ranges=ranges).collect()
    least, held = 0, 0
    while held < 0.8 * total:
        held, least = held + want[least][1], least + 1
    assert sorted(r["place"] for r in few) == list(range(1, least + 1))


def test_running_shares_of_nothing(spark):
    none = spark.createDataFrame([], "from string, total_volume long")
    assert SH.running_shares(none).count() == 0 and SH.smallest_holders(none).count() == 0
    zero = spark.createDataFrame([("a", 0), ("b", 0)], "from string, total_volume long")
    assert [r["share_pct"] for r in SH.running_shares(zero).collect()] == [0.0, 0.0] and SH.smallest_holders(zero).count() == 0


def test_no_window_over_all_senders(spark):
    p = SH.running_shares(V.mail_orders(spark, SF001).groupBy("from").agg(F.count(F.lit(1)).alias("total_volume")))
    p.collect()
    plan = p._jdf.queryExecution().executedPlan().toString()
    # What goes to one task are the ranges' sums, after they were added up.
    for at in [i for i in range(len(plan)) if plan.startswith("Exchange SinglePartition", i)]:
        assert "HashAggregate(keys=[_p" in plan[at:at + 700]


def test_cube_reads_the_messages_once(spark):
    cube = SH.engagement_cube(V.mail_orders(spark, SF001))
    p = cube._jdf.queryExecution().executedPlan().toString()
    assert p.count("FileScan") == 1 and p.count("Expand") >= 1
    rows = cube.collect()
    every = {r["category"]: r["emails"] for r in rows if r["level"] == 5}
    assert every["any"] == V.mail_orders(spark, SF001).count() and set(every) == {"any", *SH.CATEGORIES}
    by = {(r["tier"], r["month"]): r["emails"] for r in SH.totals(cube, "tier", "month").collect()}
    assert sum(by.values()) == sum(every.values())
    with pytest.raises(ValueError):
        SH.totals(cube, "month")


def test_bucketed_cache_is_not_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        old, box = V.earlier_cache(spark, SF001), V.mailbox(spark, SF001)
        cache = SB.load_bucketed(spark, SB.save_bucketed(old, 8))
        listed = SB.load_bucketed(spark, SB.save_bucketed(box.select("id"), 8))
        for df, exchanges in ((SB.listing_state(box, cache), 1), (SB.listing_state(listed, cache), 0),
                              (RF.fetch_plan(listed, cache, as_of=V.ORDERS_AS_OF), 0), (RF.prune(cache, listed)[0], 0),
                              (RF.prune(cache, listed)[1], 0), (cache.join(listed, "id"), 0)):
            p = df._jdf.queryExecution().executedPlan().toString()
            assert p.count("Exchange hashpartitioning") == exchanges and "Bucketed: true" in p
            df.count()
        plain = RF.fetch_plan(box, old, as_of=V.ORDERS_AS_OF)
        assert sorted(RF.fetch_plan(listed, cache, as_of=V.ORDERS_AS_OF).collect()) == sorted(plain.collect())
        # A changed cache is joined bucket by bucket too: what was fetched is all that moves.
        fetched = V.fetch_results(spark, SF001, box)
        p = RF.changes(cache, fetched)._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in p
        assert sorted(map(str, RF.changes(cache, fetched).collect())) == sorted(map(str, RF.changes(old, fetched).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
