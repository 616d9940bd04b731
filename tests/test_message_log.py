"""The message log against a plain model, with retries, late deliveries, removals, compactions and splits."""

import os
import random

import pytest
from pyspark.sql import functions as F

from inboxlens.operators import messages as MS
from inboxlens.operators import refresh as RF
from inboxlens.operators import senders as SN
from inboxlens.schemas import CACHE
from inboxlens.streaming import message_log as ML
from tests.fixtures import cache_item

AS_OF = "2024-02-10 00:00:00"


def _items(spark, rows):
    """(id, day fetched, sender, unread) -> cache rows."""
    return cache_item(spark, [(i, f"2024-01-{day:02}T00:00:00", True, [("From", who), ("Date", f"Mon, {1 + day % 5} Jan 2024 10:00:00 +0000")],
                               "", ["UNREAD"] if unread else []) for i, day, who, unread in rows])


def _rows(df):
    return sorted((r["id"], r["fetched_at"], r["response"]["labelIds"], r["response"]["payload"]["headers"][0]["value"]) for r in df.collect())


def _expected(model):
    return sorted((i, f"2024-01-{day:02}T00:00:00", ["UNREAD"] if unread else [], who) for i, (day, who, unread) in model.items())


def _senders(df):
    return sorted(tuple(r) for r in df.collect())


def test_log_follows_a_plain_model(spark, tmp_dir):
    log = ML.MessageLog(os.path.join(tmp_dir, "log"), target=25, few=2, every=2)
    rnd, model = random.Random(4), {}
    for seq in range(5):
        batch = [(f"m{rnd.randrange(120)}", rnd.randrange(1, 28), f"s{rnd.randrange(4)}", rnd.random() < 0.5) for _ in range(30)]
        batch = list({(i, day): (i, day, who, unread) for i, day, who, unread in batch}.values())   # no ties but equal rows
        listing, gone = None, set()
        if seq == 3:
            gone = set(rnd.sample(sorted(model), 15))
            listing = spark.createDataFrame([(i,) for i in {*model, *(b[0] for b in batch)} - gone], "id string")
        for _ in range(2 if seq == 3 else 1):                          # this batch is run again after a failure
            ML.append(spark, log, _items(spark, [*batch, batch[0]]), seq, AS_OF, listing)
        for i, day, who, unread in sorted(batch, key=lambda b: b[1]):
            if i not in model or day >= model[i][0]:
                model[i] = (day, who, unread)
        for i in gone:
            model.pop(i, None)
        if seq > 2:
            assert _rows(ML.snapshot(spark, log)) == _expected(model)
    want = SN.aggregate_and_score(MS.extract(ML.snapshot(spark, log), AS_OF))
    assert _senders(ML.sender_table(spark, log)) == _senders(want)
    at = ML.state(spark, log)
    known = ML.buckets(spark, log, at.base)
    assert len(known) > 2 and max(b.depth for b in known) >= 2
    # The buckets share out all hashes: their parts of the whole add up to one.
    assert sum(2.0 ** -b.depth for b in known) == 1.0
    some = spark.createDataFrame([("m1",), ("m7",), ("none",)], "id string")
    assert _rows(ML.lookup(spark, log, some)) == [r for r in _expected(model) if r[0] in ("m1", "m7")]


def _written(root):
    return {os.path.join(d, n): os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(root) for n in names}


def test_a_small_batch_writes_a_small_delta(spark, tmp_dir):
    root = os.path.join(tmp_dir, "log")
    log = ML.MessageLog(root, target=500, few=4, every=1)
    ML.append(spark, log, _items(spark, [(f"m{i}", 3, f"s{i % 50}", True) for i in range(4000)]), 0, AS_OF)
    log = ML.MessageLog(root, target=500, few=4, every=50)
    before = _written(root)
    assert len(ML.buckets(spark, log, ML.state(spark, log).base)) >= 8
    ML.append(spark, log, _items(spark, [(f"m{i}", 9, "s1", False) for i in range(100)]), 1, AS_OF)
    after = _written(root)
    new = {n for n in after if after[n] != before.get(n)}
    assert all(f"{os.sep}seq=1{os.sep}" in n for n in new)             # no bucket, no other batch is written again
    assert spark.read.parquet(f"{root}/delta/seq=1").count() == 100
    assert spark.read.parquet(f"{root}/change/seq=1").count() == 50    # the senders that lose or gain a message
    assert ML.snapshot(spark, log).count() == 4000
    by = {r["from"]: r for r in ML.sender_table(spark, log).collect()}
    assert by["s1"]["total_volume"] == 80 - 2 + 100 and by["s1"]["unread_count"] == 78 and by["s2"]["total_volume"] == 78


def test_ages_follow_as_of_and_old_versions_go(spark, tmp_dir):
    root = os.path.join(tmp_dir, "log")
    log = ML.MessageLog(root, target=10, few=3, every=1)
    for seq in range(3):
        as_of = AS_OF if seq < 2 else "2024-02-20 00:00:00"
        ML.append(spark, log, _items(spark, [(f"m{seq}-{i}", 2, "s", False) for i in range(12)]), seq, as_of)
    [row] = ML.sender_table(spark, log).collect()
    assert row["total_volume"] == 36 and row["avg_recency_days"] == 47.0
    ML.append(spark, log, _items(spark, []), 3, None)                  # nothing came, and ages are as of now
    assert ML.snapshot(spark, log).count() == 36 and ML.sender_table(spark, log).first()["avg_recency_days"] > 300
    assert ML.numbers(spark, f"{root}/state", "seq") == [2, 3]
    assert len(ML.numbers(spark, f"{root}/buckets", "version")) <= 2


def test_empty_log(spark, tmp_dir):
    log = ML.MessageLog(os.path.join(tmp_dir, "log"))
    assert ML.snapshot(spark, log).count() == 0 and ML.sender_table(spark, log).count() == 0
    ML.append(spark, log, _items(spark, []).withColumn("id", F.lit(None).cast("string")), 0, AS_OF)
    assert ML.snapshot(spark, log).count() == 0 and ML.sender_table(spark, log).count() == 0


@pytest.mark.parametrize("swap", [False, True])
def test_change_feed_is_one_join(spark, swap):
    cache = _items(spark, [("same", 3, "a", False), ("old", 3, "b", False), ("late", 9, "c", False)])
    fetched = _items(spark, [("new", 5, "d", False), ("old", 5, "e", False), ("old", 4, "x", False), ("late", 5, "y", False)])
    if swap:
        cache, fetched = fetched.where("fetched_at <> '2024-01-04T00:00:00'"), cache
    out = RF.changes(cache, fetched)
    got = {(r["id"], r["change"], r["response"]["payload"]["headers"][0]["value"]) for r in out.collect()}
    if swap:
        assert got == {("same", "added", "a"), ("new", "kept", "d"), ("old", "kept", "e"), ("late", "replaced", "c")}
    else:
        assert got == {("same", "kept", "a"), ("new", "added", "d"), ("old", "replaced", "e"), ("late", "kept", "c")}


def test_rows_of_one_bucket_are_not_dealt_by_bucket(spark):
    """With one bucket, as before the first compaction, all rows used to meet in one task."""
    rows = spark.range(0, 4000, 1, 4).select(F.concat(F.lit("m"), "id").alias("id"))
    for known in ([ML.Bucket(0, 0, -1, 0, -1)], [ML.Bucket(1, 0, 0, 5, 0), ML.Bucket(2, 2, -1, 0, 1), ML.Bucket(2, 3, 1, 7, 1)]):
        placed = ML.in_buckets(rows, known)
        plan = placed._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning(depth" not in plan
        assert placed.count() == placed.select("id").distinct().count() == 4000
        assert placed.select(F.spark_partition_id().alias("p")).distinct().count() == 4


def test_deltas_are_dealt_by_id_before_they_are_sorted(spark):
    cols = [F.lit(None).cast(f.dataType).alias(f.name) for f in CACHE.fields[1:]]
    deltas = spark.range(0, 300, 1, 3).select(F.concat(F.lit("m"), F.col("id") % 200).alias("id"), *cols,
                                              (F.col("id") >= 250).alias("gone"), F.col("id").alias("seq"))
    newest = ML._newest(deltas)
    steps = [x for x in newest._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x or "Aggregate" in x]
    assert steps and "Exchange" in steps[-1]                           # the lowest step of all
    assert newest.count() == 200 and newest.where("gone").count() == 50
