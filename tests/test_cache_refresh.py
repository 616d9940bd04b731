import json
import os

from pyspark.sql import functions as F

from inboxlens.operators import content as CT
from inboxlens.operators import messages as MS
from inboxlens.operators import refresh as RF
from inboxlens.sources import cache as SC
from inboxlens.sources import listing as SL
from inboxlens.sources import senders_io as SIO
from tests.fixtures import cache_item, f2

AS_OF = "2024-01-10 00:00:00"


def _legacy_file(path, obj):
    with open(path, "w") as f:
        json.dump(obj, f)


def test_load_legacy_map(spark, tmp_dir):
    p = os.path.join(tmp_dir, "cache.json")
    _legacy_file(p, {
        "m1": {"snippet": "hi", "labelIds": ["UNREAD"], "payload": {"headers": [{"name": "From", "value": "a@x"}]}},
        "m2": {"fetched_at": "2024-01-09T00:00:00+00:00",
               "response": {"snippet": "yo", "labelIds": [], "payload": {"headers": [{"name": "from", "value": "b@x"}]}}},
    })
    c = SC.load_cache(spark, p, "legacy")
    rows = {r.id: r for r in MS.extract(c, AS_OF).collect()}
    assert rows["m1"]["from"] == "a@x" and rows["m1"].unread is True
    assert rows["m2"]["from"] == "b@x" and rows["m2"].snippet == "yo"


def test_load_missing_and_corrupt(spark, tmp_dir):
    assert SC.load_cache(spark, os.path.join(tmp_dir, "nope.json"), "legacy").count() == 0
    assert SC.load_cache(spark, os.path.join(tmp_dir, "nope"), "parquet").count() == 0
    p = os.path.join(tmp_dir, "bad.json")
    with open(p, "w") as f:
        f.write("invalid json content")
    assert SC.load_cache(spark, p, "legacy").count() == 0


def test_save_load_roundtrip(spark, tmp_dir):
    c = cache_item(spark, [("m1", None, False, [("From", "a@x")], "s", ["UNREAD"]),
                           ("m2", "2024-01-01T00:00:00", True, [("From", "b@x")], "", [])])
    for fmt in ("parquet", "json"):
        p = os.path.join(tmp_dir, f"c-{fmt}")
        assert SC.save_cache(c, p, fmt)
        back = SC.load_cache(spark, p, fmt)
        assert sorted(back.collect()) == sorted(c.collect())


def test_unwrap_and_header_defaults(spark):
    c = cache_item(spark, [
        ("m1", None, False, [("FROM", "a@x"), ("Subject", "Hello"), ("subject", "Second")], "s1", ["STARRED"]),
        ("m2", "2024-01-01T00:00:00", True, [("Date", "Mon, 1 Jan 2024 10:00:00 +0000")], "", None),
        ("m3", "2024-01-01T00:00:00", True, None, None, ["CATEGORY_SOCIAL"]),
        ("m4", None, False, [("From", "")], "x", []),
    ])
    r = {x.id: x for x in MS.extract(c, AS_OF).collect()}
    assert r["m1"]["from"] == "a@x" and r["m1"].subject == "Hello" and r["m1"].starred
    assert r["m2"]["from"] == "Unknown" and r["m2"].subject == "No Subject" and r["m2"].age_days == 8
    assert r["m2"].unread is False
    assert r["m3"]["from"] == "Unknown" and r["m3"].date == "Unknown" and r["m3"].age_days is None
    assert r["m3"].social and r["m3"].snippet == ""
    assert r["m4"]["from"] == ""


def test_subjects_and_snippets(spark):
    c = cache_item(spark, [
        ("m1", None, False, [("From", "sender1"), ("Subject", "s-a")], "snip a", []),
        ("m2", None, False, [("From", "sender1"), ("Subject", "s-b")], "", []),
        ("m3", None, True, [("From", "sender2")], "snip c", []),
        ("m4", None, True, None, "", []),
    ])
    subj = CT.cache_subjects(c)
    counts = subj.groupBy("from").count()
    assert {r["from"]: r["count"] for r in counts.collect()} == {"sender1": 2, "sender2": 1, "Unknown": 1}
    # a missing Subject is '' in the subject map (the message table says "No Subject")
    assert {r.id: r.subject for r in subj.collect()}["m3"] == ""
    assert {r.id: r.subject for r in MS.extract(c, AS_OF).collect()}["m3"] == "No Subject"
    assert {r["from"] for r in CT.cache_snippets(c).collect()} == {"sender1", "sender2"}
    first = {r["from"]: r.sample_subject for r in CT.first_subject(CT.cache_subjects(c)).collect()}
    assert first["sender1"] == "s-a" and first["sender2"] == ""


def test_staleness(spark):
    df = spark.createDataFrame([("a", None), ("b", "2024-01-08T00:00:00"), ("c", "2023-12-31T00:00:00+00:00"),
                                ("d", "not-a-date"), ("e", "2024-01-03T00:00:00Z")], "id string, fetched_at string")
    got = {r.id: r.stale for r in RF.with_staleness(df, 7, AS_OF).collect()}
    assert got == {"a": True, "b": False, "c": True, "d": True, "e": True}


def test_prune(spark):
    c = cache_item(spark, [(i, None, False, [], "", []) for i in ("msg1", "msg2", "msg3")])
    kept, removed = RF.prune(c, spark.createDataFrame([("msg1",), ("msg3",)], "id string"))
    assert sorted(r.id for r in kept.collect()) == ["msg1", "msg3"]
    assert [r.id for r in removed.collect()] == ["msg2"]
    kept2, removed2 = RF.prune(c.where("id != 'msg3'"),
                               spark.createDataFrame([("msg1",), ("msg2",), ("msg3",)], "id string"))
    assert removed2.count() == 0 and kept2.count() == 2


def test_fetch_plan_and_upsert(spark):
    cache = cache_item(spark, [("fresh", "2024-01-09T00:00:00", True, [("From", "a")], "", []),
                               ("old", "2023-12-01T00:00:00", True, [("From", "b")], "", []),
                               ("gone", "2024-01-09T00:00:00", True, [("From", "c")], "", [])])
    listing = spark.createDataFrame([("fresh",), ("old",), ("new",), ("fail",)], "id string")
    plan = {r.id: r.reason for r in RF.fetch_plan(listing, cache, False, 7, AS_OF).collect()}
    assert plan == {"old": "stale", "new": "missing", "fail": "missing"}
    assert len(RF.fetch_plan(listing, cache, True, 7, AS_OF).collect()) == 4
    fetched = cache_item(spark, [("old", "2024-01-10T00:00:00", True, [("From", "b2")], "", []),
                                 ("new", "2024-01-10T00:00:00", True, [("From", "d")], "", []),
                                 ("new", "2024-01-10T01:00:00", True, [("From", "d2")], "", [])])
    up = RF.upsert(cache, fetched)
    got = {r.id: r for r in MS.extract(up, AS_OF).collect()}
    assert set(got) == {"fresh", "old", "gone", "new"}
    assert got["old"]["from"] == "b2" and got["new"]["from"] == "d2"
    msgs = MS.process_messages(up, listing, AS_OF)
    assert sorted(r.id for r in msgs.collect()) == ["fresh", "new", "old"]


def test_bounded_listing(spark):
    mb = spark.createDataFrame([("a", "2024-01-01 00:00:00", ["INBOX"]), ("b", "2024-01-03 00:00:00", ["TRASH"]),
                                ("c", "2024-01-02 00:00:00", None), ("d", "2024-01-02 00:00:00", ["UNREAD"])],
                               "id string, ts string, labelIds array<string>").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r.id for r in SL.bounded_listing(mb, 2).collect()] == ["c", "d"]
    assert [r.id for r in SL.bounded_listing(mb, 10, include_labels=["UNREAD"]).collect()] == ["d"]


def test_sender_table_csv_roundtrip(spark, tmp_dir):
    p = os.path.join(tmp_dir, "senders")
    SIO.save_senders(f2(spark), p, "csv")
    back = SIO.load_senders(spark, p, "csv")
    assert dict(back.dtypes)["total_volume"] == "bigint" and dict(back.dtypes)["open_rate"] == "double"
    assert sorted(back.collect()) == sorted(f2(spark).collect())
    assert SIO.load_senders(spark, os.path.join(tmp_dir, "missing.csv")).count() == 0


def test_audit_plan_end_to_end(spark, tmp_dir):
    from inboxlens.plans import reports as RP
    d = "Mon, 1 Jan 2024 10:00:00 +0000"
    cache = cache_item(spark, [("m1", "2024-01-09T00:00:00", True, [("From", "a@x"), ("Date", d)], "", ["UNREAD"]),
                               ("m2", "2023-12-01T00:00:00", True, [("From", "b@x"), ("Date", d)], "", []),
                               ("gone", "2024-01-09T00:00:00", True, [("From", "c@x"), ("Date", d)], "", [])])
    listing = spark.createDataFrame([("m1",), ("m2",), ("m3",), ("m1",)], "id string")
    fetched = cache_item(spark, [("m2", "2024-01-10T00:00:00", True, [("From", "b@x"), ("Date", d)], "", ["UNREAD"]),
                                 ("m3", "2024-01-10T00:00:00", True, [("From", "b@x"), ("Date", d)], "", [])])
    out = RP.audit(listing, cache, lambda plan: fetched.join(plan.select("id"), "id", "left_semi"), AS_OF,
                   out_dir=os.path.join(tmp_dir, "audit"))
    assert sorted(r.id for r in out["cache"].collect()) == ["m1", "m2", "m3"]
    assert [r.id for r in out["removed"].collect()] == ["gone"]
    assert sorted(r.id for r in out["messages"].collect()) == ["m1", "m1", "m2", "m3"]   # listed twice, read twice
    s = {r["from"]: r for r in out["senders"].collect()}
    assert s["a@x"].total_volume == 2 and s["a@x"].unread_count == 2
    assert s["b@x"].total_volume == 2 and s["b@x"].unread_count == 1


def test_audit_empty_listing_keeps_cache(spark, tmp_dir):
    from inboxlens.plans import reports as RP
    cache = cache_item(spark, [("m1", None, True, [("From", "a@x")], "", [])])
    empty = spark.createDataFrame([], "id string")
    out = RP.audit(empty, cache, lambda plan: plan, AS_OF)
    assert out["senders"].count() == 0 and out["cache"].count() == 1 and out["removed"].count() == 0
    out = RP.audit(empty, cache, lambda plan: cache.limit(0), AS_OF, out_dir=os.path.join(tmp_dir, "a2"),
                   allow_prune_all=True)
    assert out["cache"].count() == 0 and out["removed"].count() == 1


def test_messages_partitioned_by_month(spark, tmp_dir):
    from inboxlens.sources import load_messages, save_messages
    c = cache_item(spark, [("m1", None, True, [("From", "a@x"), ("Date", "Mon, 1 Jan 2024 10:00:00 +0000")], "", []),
                           ("m2", None, True, [("From", "a@x"), ("Date", "Thu, 15 Feb 2024 10:00:00 +0000")], "", []),
                           ("m3", None, True, [("From", "b@x"), ("Date", "Unknown")], "", [])])
    p = os.path.join(tmp_dir, "messages")
    save_messages(MS.extract(c, AS_OF), p)
    assert sorted(r.id for r in load_messages(spark, p).collect()) == ["m1", "m2", "m3"]
    feb = load_messages(spark, p, since="2024-02-01 00:00:00")
    assert [r.id for r in feb.collect()] == ["m2"]
    plan = feb._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    assert load_messages(spark, os.path.join(tmp_dir, "none")).count() == 0
