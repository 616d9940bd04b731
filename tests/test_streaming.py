import os

from inboxlens.streaming import AuditPaths, apply_batch, current_senders, latest_snapshot, start_incremental_audit
from tests.fixtures import cache_item

AS_OF = "2024-01-10 00:00:00"


def test_incremental_audit(spark, tmp_dir):
    src = os.path.join(tmp_dir, "incoming")
    # each batch lands in its own folder; the source watches all of them
    paths = AuditPaths(os.path.join(src, "*"), os.path.join(tmp_dir, "log"), os.path.join(tmp_dir, "ckpt"))
    d = "Mon, 1 Jan 2024 10:00:00 +0000"
    b1 = cache_item(spark, [("m1", "2024-01-09T00:00:00", True, [("From", "a@x"), ("Date", d)], "", ["UNREAD"]),
                            ("m2", "2024-01-09T00:00:00", True, [("From", "a@x"), ("Date", d)], "", [])])
    b1.write.mode("append").json(os.path.join(src, "b1"))
    q = start_incremental_audit(spark, paths, "json", as_of=AS_OF)
    q.awaitTermination()
    s = {r["from"]: r for r in current_senders(spark, paths).collect()}
    assert s["a@x"].total_volume == 2 and s["a@x"].unread_count == 1

    # a refetch of m1 (now read) and a new message from another sender
    b2 = cache_item(spark, [("m1", "2024-01-10T00:00:00", True, [("From", "a@x"), ("Date", d)], "", []),
                            ("m3", "2024-01-10T00:00:00", True, [("From", "b@x"), ("Date", d)], "", ["UNREAD"])])
    b2.write.mode("append").json(os.path.join(src, "b2"))
    q = start_incremental_audit(spark, paths, "json", as_of=AS_OF)
    q.awaitTermination()
    s = {r["from"]: r for r in current_senders(spark, paths).collect()}
    assert s["a@x"].total_volume == 2 and s["a@x"].unread_count == 0
    assert s["b@x"].unread_count == 1
    assert latest_snapshot(spark, paths).count() == 3


def _items(spark, *rows):
    d = "Mon, 1 Jan 2024 10:00:00 +0000"
    return cache_item(spark, [(i, f"2024-01-{day:02}T00:00:00", True, [("From", who), ("Date", d)], "", labels)
                              for i, day, who, labels in rows])


def test_late_deliveries_restarts_and_removals(spark, tmp_dir):
    paths = AuditPaths("", os.path.join(tmp_dir, "log"), "", target=8, few=3, every=2)
    first = _items(spark, *[(f"m{i}", 5, f"s{i % 3}", ["UNREAD"] if i % 2 else []) for i in range(40)])
    apply_batch(spark, first, 0, paths, AS_OF)
    assert sum(r["total_volume"] for r in current_senders(spark, paths).collect()) == 40
    late = _items(spark, ("m1", 2, "other", []), ("m2", 9, "s2", ["UNREAD"]))      # m1 came before, m2 is newer
    for _ in range(2):                                                             # the batch is run again after a failure
        apply_batch(spark, late, 1, paths, AS_OF)
        got = {r["from"]: (r["total_volume"], r["unread_count"]) for r in current_senders(spark, paths).collect()}
        assert got == {"s0": (14, 7), "s1": (13, 7), "s2": (13, 7)}
    assert latest_snapshot(spark, paths).count() == 40
    apply_batch(spark, late.limit(0), 2, paths, AS_OF)                             # nothing came
    apply_batch(spark, _items(spark, ("m2", 9, "s2", [])), 3, paths, "2024-01-12 00:00:00")
    got = {r["from"]: (r["total_volume"], r["unread_count"], r["avg_recency_days"]) for r in current_senders(spark, paths).collect()}
    assert got == {"s0": (14, 7, 10.0), "s1": (13, 7, 10.0), "s2": (13, 6, 10.0)}  # ages of all messages are new
    apply_batch(spark, late.limit(0), 4, paths, "2024-01-12 00:00:00", listing=first.select("id").where("id != 'm1'"))
    assert latest_snapshot(spark, paths).count() == 39
    assert sum(r["total_volume"] for r in current_senders(spark, paths).collect()) == 39
