"""The mailbox as a data source: pages, pushed bounds, patience, failing partitions, streams."""

import datetime as dt
import os

import pyarrow as pa
import pyarrow.parquet  # noqa: F401
import pytest
from pyspark.sql import functions as F

from inboxlens.fixtures import views as V
from inboxlens.plans import reports as RP
from inboxlens.sources import mailbox as MB
from tests.conftest import SF001

PAGES = {f"p{k}": [(f"m{k}-{i}", dt.datetime(2024, 1, 1 + k, i), ["INBOX"] if i % 2 else None) for i in range(5)] for k in range(6)}


class Slow(MB.ExportedMailbox):
    """Puts off the first two times that each page or batch is asked for."""

    def __init__(self, options):
        super().__init__(options)
        self.asked = {}

    def _wait(self, what):
        self.asked[what] = self.asked.get(what, 0) + 1
        if self.asked[what] <= 2:
            raise MB.Busy

    def read(self, page):
        self._wait(page)
        return super().read(page)

    def get(self, ids):
        self._wait(tuple(ids))
        return super().get(ids)


class Counted:
    """A listing from memory that notes which pages are read, and as many pages as the folder ``seen`` has files named up*."""

    def __init__(self, options):
        self.seen, self.limit = options["seen"], int(options.get("pages", len(PAGES)))

    def pages(self):
        up = sum(n.startswith("up") for n in os.listdir(self.seen))
        return sorted(PAGES)[:up or self.limit]

    def bounds(self, page):
        return (PAGES[page][0][1], PAGES[page][-1][1]) if page != "p5" else None

    def read(self, page):
        open(os.path.join(self.seen, f"read-{page}"), "a").close()
        ids, ts, labels = zip(*PAGES[page])
        return pa.table({"id": ids, "ts": pa.array(ts, pa.timestamp("us", "UTC")), "labelIds": pa.array(labels, pa.list_(pa.string()))})

    def get(self, ids):
        raise NotImplementedError


def _read(tmp_dir):
    return sorted(n.removeprefix("read-") for n in os.listdir(tmp_dir) if n.startswith("read-"))


def test_bounds_and_ids_reach_the_source(spark, tmp_dir):
    MB.register(spark, "counted", Counted)
    box = MB.listing(spark, "counted", seen=tmp_dir)
    since = box.where((F.col("ts") >= F.lit("2024-01-03 02:00:00").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-05").cast("timestamp")))
    want = [i for rows in PAGES.values() for i, t, _ in rows if dt.datetime(2024, 1, 3, 2) <= t < dt.datetime(2024, 1, 5)]
    assert sorted(r["id"] for r in since.collect()) == sorted(want)
    assert _read(tmp_dir) == ["p2", "p3", "p5"]                        # p5 does not tell its bounds
    assert [r["id"] for r in box.where(F.col("id").isin("m1-1", "m4-2", "none")).orderBy("id").collect()] == ["m1-1", "m4-2"]
    # A test that the source does not know is left to Spark.
    assert box.where(F.array_contains("labelIds", "INBOX")).count() == 12 and box.count() == 30
    assert {r["ts"] for r in box.where("id = 'm0-3'").select(F.date_format("ts", "HH:mm").alias("ts")).collect()} == {"03:00"}


def test_nothing_listed(spark, tmp_dir):
    MB.register(spark, "counted", Counted)
    assert MB.listing(spark, "counted", seen=tmp_dir, pages="0").count() == 0


def test_patience_has_an_end_and_waits_grow():
    waits, left = [], [5]

    def ask():
        left[0] -= 1
        if left[0] >= 0:
            raise MB.Busy
        return "there"
    assert MB.patiently(ask, retries=5, first_wait=1.0, sleep=waits.append) == "there"
    assert len(waits) == 5 and all(2 ** k <= w <= 2 ** (k + 1) for k, w in enumerate(waits))
    left[0] = 9
    with pytest.raises(MB.Busy):
        MB.patiently(ask, retries=2, sleep=waits.append)
    assert MB.patiently(lambda: 7, retries=0) == 7


@pytest.mark.parametrize("client", [MB.ExportedMailbox, Slow])
def test_every_id_is_fetched_once_even_from_a_slow_service(spark, tmp_dir, client):
    box = V.mailbox(spark, SF001)
    options = MB.export(box, V.fetch_results(spark, SF001, box), os.path.join(tmp_dir, "service"), parts=4)
    MB.register(spark, "mailbox-test", client, first_wait=0.01, batch=60)
    listed = MB.listing(spark, "mailbox-test", **options)
    assert sorted(r["id"] for r in listed.collect()) == sorted(r["id"] for r in box.collect())
    plan = box.select("id").unionByName(box.select("id")).unionByName(spark.createDataFrame([("unknown",)], "id string"))
    got = sorted(map(str, MB.fetch(spark, plan, "mailbox-test", requests=5, **options).collect()))
    assert got == sorted(map(str, V.fetch_results(spark, SF001, box).collect())) and len(got) == len(set(got)) > 100
    assert MB.fetch(spark, plan.limit(0), "mailbox-test", **options).count() == 0


def test_partitions_that_give_up_fail_the_job_and_leave_nothing(spark, tmp_dir):
    box = V.mailbox(spark, SF001)
    options = MB.export(box, V.fetch_results(spark, SF001, box), os.path.join(tmp_dir, "service"), parts=4)
    MB.register(spark, "mailbox-test", Slow, retries=1, first_wait=0.01)
    with pytest.raises(Exception, match="Busy"):
        MB.listing(spark, "mailbox-test", **options).count()


def test_audit_through_the_source_equals_the_plain_one(spark, tmp_dir):
    box, old = V.mailbox(spark, SF001), V.earlier_cache(spark, SF001)
    options = MB.export(box, V.fetch_results(spark, SF001, box), os.path.join(tmp_dir, "service"), parts=4)
    MB.register(spark, "mailbox-test", Slow, first_wait=0.01)
    found = RP.audit(MB.listing(spark, "mailbox-test", **options), old,
                     lambda plan: MB.fetch(spark, plan, "mailbox-test", requests=3, **options), as_of=V.ORDERS_AS_OF)
    plain = RP.audit(box, old, lambda plan: V.fetch_results(spark, SF001, plan), as_of=V.ORDERS_AS_OF)
    assert sorted(map(str, found["senders"].collect())) == sorted(map(str, plain["senders"].collect()))
    assert found["fetched"].count() == found["fetched"].select("id").distinct().count() == plain["fetched"].count()


def test_new_pages_come_as_a_stream(spark, tmp_dir):
    MB.register(spark, "counted", Counted)
    seen, out = os.path.join(tmp_dir, "seen"), os.path.join(tmp_dir, "out")
    os.makedirs(seen)

    def run():
        pages = spark.readStream.format("counted").options(seen=seen).load()
        pages.writeStream.format("parquet").option("path", out).option("checkpointLocation", os.path.join(tmp_dir, "checkpoint")).trigger(
            availableNow=True).start().awaitTermination()
        return sorted(r["id"] for r in spark.read.parquet(out).collect())
    for many in (2, 2, 5):
        for k in range(many):
            open(os.path.join(seen, f"up{k}"), "a").close()
        assert run() == sorted(i for p in sorted(PAGES)[:many] for i, _, _ in PAGES[p])
    with pytest.raises(Exception, match="only the listing is a stream"):
        spark.readStream.format("counted").options(seen=seen, table="messages").load().writeStream.format("noop").start().awaitTermination()


def test_ids_are_asked_for_in_order_and_row_groups_read_once(spark, tmp_dir, monkeypatch):
    """Every batch used to read whole folders of messages."""
    monkeypatch.setattr(MB, "GROUP_BYTES", 4096)
    monkeypatch.setattr(MB, "PLAN_ROWS", 70)
    box = V.mailbox(spark, SF001)
    sent = V.fetch_results(spark, SF001, box)
    sent = sent.unionByName(sent.where("id like '%7'"))                # an id may be there twice
    options = MB.export(box, sent, os.path.join(tmp_dir, "service"), parts=3)
    plan = os.path.join(tmp_dir, "plan")
    monkeypatch.setattr(MB, "shared_dir", lambda *_: plan)
    MB.register(spark, "mailbox-test", MB.ExportedMailbox, batch=20)
    got = MB.fetch(spark, box.select("id"), "mailbox-test", requests=2, **options)
    want = sorted(map(str, sent.collect()))
    assert sorted(map(str, got.collect())) == want
    files = [pa.parquet.read_table(f)["id"].to_pylist() for f in MB._part_files(plan)]
    assert len(files) > 4 and all(f == sorted(f) and len(f) <= 70 for f in files)
    files.sort()
    assert all(a[-1] < b[0] for a, b in zip(files, files[1:], strict=False))

    read = []
    mail = MB.ExportedMailbox(options)
    plain = pa.parquet.ParquetFile.read_row_group
    monkeypatch.setattr(pa.parquet.ParquetFile, "read_row_group", lambda f, i, **k: read.append(i) or plain(f, i, **k))
    ids = sorted(r["id"] for r in box.collect())
    rows = sum(mail.get(ids[i:i + 20]).num_rows for i in range(0, len(ids), 20))
    assert rows == len(want) and 6 < len(read) <= sum(len(g) for g in mail.groups.values())
    assert mail.get(["0", "zz"]).num_rows == 0
