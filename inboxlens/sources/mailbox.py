"""A mailbox as a Spark data source, batch and streaming.

A mail service is reached through a small client (:class:`MailClient`): it names pages, reads a page, and gets messages by
id. :func:`register` makes such a client a data source, so that listing and fetching are ordinary distributed scans:

* ``listing``: a partition for each page; time bounds of a query are pushed down, skip whole pages at planning and
  filter the rows of the others;
* ``messages``: a partition for each part of a written fetch plan, which asks for its ids in batches;
* as a stream: the listing's pages as they appear; an offset is the name of the last page read.

A request that the service puts off (:class:`Busy`) is repeated inside its partition with growing waits. A page or batch
is passed on only when it is complete, so that no row comes twice; when the waits are used up the task fails, and Spark
runs that partition again.
"""

from __future__ import annotations

import datetime as dt
import random
import sys
import time
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import Protocol

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan,
                                    GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual)
from pyspark.sql.pandas.types import to_arrow_schema

from inboxlens.schemas import CACHE
from inboxlens.session import shared_dir

# Readers run in Python workers; they are shipped with the job, so executors need not have the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LISTING = "id string, ts timestamp, labelIds array<string>"
#: Ids of one request, requests repeated before a partition gives up, and the first and the longest wait in seconds.
BATCH, RETRIES, FIRST_WAIT, LONGEST_WAIT = 100, 6, 0.5, 60.0
#: Ids in a file of a fetch plan, which is a partition of the fetch, and bytes of a row group of exported messages.
PLAN_ROWS, GROUP_BYTES = 100_000, 1 << 20


class Busy(Exception):
    """The service asks to come again later."""


class MailClient(Protocol):
    """What the source needs of a mail service. Clients are made in the driver and in every task anew."""

    def pages(self) -> list[str]:
        """Names of the listing's pages in rising order; a page once named does not change."""

    def bounds(self, page: str) -> tuple[dt.datetime, dt.datetime] | None:
        """Times of the oldest and the newest message of a page (UTC, no zone), if known without reading it."""

    def read(self, page: str) -> pa.Table:
        """The page's messages: id, ts (UTC), labelIds."""

    def get(self, ids: list[str]) -> pa.Table:
        """Cache rows of those ids that can be fetched; the others are absent."""


def patiently(ask: Callable, retries: int = RETRIES, first_wait: float = FIRST_WAIT, sleep: Callable = time.sleep):
    """``ask()``, repeated while it raises :class:`Busy`: waits double up to LONGEST_WAIT, each with as much jitter again."""
    for k in range(retries + 1):
        try:
            return ask()
        except Busy:
            if k == retries:
                raise
            sleep(min(LONGEST_WAIT, first_wait * 2 ** k) * (1 + random.random()))


class Page(InputPartition):
    def __init__(self, name: str):
        self.name = name


class PlanPart(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _files(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder that Spark names with or without a scheme."""
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def _part_files(path: str) -> list[str]:
    fs, root = _files(path)
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted(x.path for x in found if x.is_file and x.base_name.endswith(".parquet") and x.size)


def _utc(value) -> dt.datetime:
    """A pushed time as UTC without a zone."""
    return value if value.tzinfo is None else value.astimezone(dt.UTC).replace(tzinfo=None)


class _TimeBounds:
    """The pushed filters on ``ts`` and ``id``: what a page must overlap, and what its rows must pass."""

    def __init__(self):
        self.tests: list[tuple[str, str, object]] = []

    def push(self, filters):
        """Takes over the comparisons it can do; gives back the others."""
        names = {GreaterThan: "greater", GreaterThanOrEqual: "greater_equal", LessThan: "less", LessThanOrEqual: "less_equal",
                 EqualTo: "equal"}
        for f in filters:
            column = getattr(f, "attribute", ())
            if type(f) in names and column == ("ts",) and isinstance(f.value, dt.datetime):
                self.tests.append(("ts", names[type(f)], _utc(f.value)))
            elif isinstance(f, EqualTo) and column == ("id",):
                self.tests.append(("id", "is_in", (f.value,)))
            elif isinstance(f, In) and column == ("id",):
                self.tests.append(("id", "is_in", tuple(f.value)))
            else:
                yield f

    def overlap(self, bounds: tuple[dt.datetime, dt.datetime] | None) -> bool:
        if bounds is None:
            return True
        low, high = map(_utc, bounds)
        holds = {"greater": lambda v: high > v, "greater_equal": lambda v: high >= v, "less": lambda v: low < v,
                 "less_equal": lambda v: low <= v, "equal": lambda v: low <= v <= high}
        return all(holds[how](value) for column, how, value in self.tests if column == "ts")

    def rows(self, table: pa.Table) -> pa.Table:
        for column, how, value in self.tests:
            if how == "is_in":
                keep = pc.is_in(table[column], pa.array(value, pa.string()))
            else:
                keep = getattr(pc, how)(table[column].cast(pa.timestamp("us")), pa.scalar(value, pa.timestamp("us")))
            table = table.filter(keep)
        return table


def register(spark: SparkSession, name: str, client: Callable[[dict], MailClient], *, retries: int = RETRIES,
             first_wait: float = FIRST_WAIT, batch: int = BATCH) -> None:
    """Make ``spark.read.format(name)`` and ``spark.readStream.format(name)`` read through ``client(options)``.

    Option ``table``: ``listing`` (the default) or ``messages``; ``plan`` (for messages): the folder of a written fetch
    plan. Registering a name again replaces its client.
    """
    ask = lambda what: patiently(what, retries, first_wait)
    # The client is shipped like the readers.
    cloudpickle.register_pickle_by_value(sys.modules[client.__module__])

    class ListingReader(DataSourceReader):
        def __init__(self, options: dict, schema):
            self.options, self.schema, self.bounds = options, schema, _TimeBounds()

        def pushFilters(self, filters):  # noqa: N802
            return self.bounds.push(filters)

        def partitions(self):
            mail = client(self.options)
            pages = [p for p in ask(mail.pages) if self.bounds.overlap(ask(lambda: mail.bounds(p)))]
            return [Page(p) for p in pages]

        def read(self, partition):
            if partition is None:                      # no pages at all
                return
            mail = client(self.options)
            yield from _batches(self.bounds.rows(ask(lambda: mail.read(partition.name))), self.schema)

    class MessageReader(DataSourceReader):
        def __init__(self, options: dict, schema):
            self.options, self.schema = options, schema

        def partitions(self):
            return [PlanPart(p) for p in _part_files(self.options["plan"])]

        def read(self, partition):
            if partition is None:                      # an empty plan
                return
            mail, (fs, _) = client(self.options), _files(self.options["plan"])
            for part in pads.dataset(partition.path, filesystem=fs).to_batches(columns=["id"]):
                ids = part.column(0).to_pylist()
                for i in range(0, len(ids), batch):
                    own = ids[i:i + batch]
                    yield from _batches(ask(lambda: mail.get(own)), self.schema)  # noqa: B023 - asked at once

    class ListingStream(DataSourceStreamReader):
        def __init__(self, options: dict, schema):
            self.options, self.schema = options, schema

        def initialOffset(self):  # noqa: N802
            return {"after": ""}

        def latestOffset(self):  # noqa: N802
            return {"after": max(ask(client(self.options).pages), default="")}

        def partitions(self, start, end):
            return [Page(p) for p in ask(client(self.options).pages) if start["after"] < p <= end["after"]]

        def read(self, partition):
            mail = client(self.options)
            yield from _batches(ask(lambda: mail.read(partition.name)), self.schema)

    class Mailbox(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return LISTING if self.options.get("table", "listing") == "listing" else CACHE

        def reader(self, schema):
            return (ListingReader if self.options.get("table", "listing") == "listing" else MessageReader)(dict(self.options), schema)

        def streamReader(self, schema):  # noqa: N802
            if self.options.get("table", "listing") != "listing":
                raise ValueError("only the listing is a stream: messages are fetched by a plan")
            return ListingStream(dict(self.options), schema)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Mailbox)


def _batches(table: pa.Table, schema) -> Iterator[pa.RecordBatch]:
    """The table's rows in the types that Spark expects."""
    wanted = to_arrow_schema(schema)
    yield from table.select(wanted.names).cast(wanted).combine_chunks().to_batches()


def listing(spark: SparkSession, name: str, **options) -> DataFrame:
    """The mailbox ``(id, ts, labelIds)`` through the registered source ``name``."""
    return spark.read.format(name).options(table="listing", **options).load()


def fetch(spark: SparkSession, plan: DataFrame, name: str, requests: int | None = None, **options) -> DataFrame:
    """Cache rows of the ids of ``plan``, each asked for once; ids that can't be fetched are absent.

    The plan is written in rising order of ids, in ``requests`` parts if given, so that a service finds ids asked for
    together close to each other; each file of a part, PLAN_ROWS ids at most, is a partition of the scan.
    """
    path = shared_dir(spark, "fetch-plan")
    ids = plan.select("id").distinct()
    ids = ids.repartitionByRange(requests, "id") if requests else ids.repartitionByRange("id")
    ids.sortWithinPartitions("id").write.option("maxRecordsPerFile", PLAN_ROWS).parquet(path)
    return spark.read.format(name).options(table="messages", plan=path, **options).load()


# ---------------------------------------------------------------------------
# a mailbox kept as files
# ---------------------------------------------------------------------------

class ExportedMailbox:
    """A mailbox exported to Parquet by :func:`export`: a page for each listing file, messages in folders by a hash of the id.

    Of the messages it knows the bounds of every row group and holds the last one read of each folder, so that ids in
    rising order read each row group once.
    """

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.fs, self.root = _files(self.path)
        self.parts = int(options["parts"])
        self.groups: dict[int, list[tuple[str, str, str, int]]] = {}
        self.reach: dict[int, list[str]] = {}
        self.opened: dict[int, tuple[str, pq.ParquetFile]] = {}
        self.held: dict[int, tuple[tuple[str, int], pa.Table, dict[str, list[int]]]] = {}

    def pages(self) -> list[str]:
        return _part_files(f"{self.path}/listing")

    def bounds(self, page: str) -> tuple[dt.datetime, dt.datetime] | None:
        with self.fs.open_input_file(page) as f:
            meta = pq.ParquetFile(f).metadata
        at = meta.schema.names.index("micros")
        stats = [meta.row_group(i).column(at).statistics for i in range(meta.num_row_groups)]
        if not stats or any(s is None or not s.has_min_max for s in stats):
            return None
        at_micros = lambda m: dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=m)
        return at_micros(min(s.min for s in stats)), at_micros(max(s.max for s in stats))

    def read(self, page: str) -> pa.Table:
        rows = pads.dataset(page, filesystem=self.fs, format="parquet").to_table(columns=["id", "micros", "labelIds"])
        return rows.set_column(1, "ts", rows["micros"].cast(pa.timestamp("us", tz="UTC")))

    def get(self, ids: list[str]) -> pa.Table:
        by: dict[int, list[str]] = {}
        for i in ids:
            by.setdefault(_part_of(i, self.parts), []).append(i)
        found = [rows for k, own in by.items() for rows in self._find(k, sorted(set(own)))]
        return pa.concat_tables(found) if found else to_arrow_schema(CACHE).empty_table()

    def _find(self, k: int, ids: list[str]) -> Iterator[pa.Table]:
        """The messages of ``ids`` (rising) in folder ``k``."""
        if k not in self.groups:
            self.groups[k] = sorted(g for name in _part_files(f"{self.path}/messages/part={k}") for g in self._bounds_of(name))
            self.reach[k] = list(accumulate((high for _, high, _, _ in self.groups[k]), max))
        groups = self.groups[k]
        for i in range(bisect_left(self.reach[k], ids[0]), len(groups)):
            low, high, name, number = groups[i]
            if low > ids[-1]:
                return
            at = bisect_left(ids, low)
            if at < len(ids) and ids[at] <= high:
                rows, places = self._group(k, name, number)
                wanted = [p for x in ids[at:] for p in places.get(x, ())]
                if wanted:
                    yield rows.take(wanted)

    def _open(self, name: str) -> pq.ParquetFile:
        return pq.ParquetFile(self.fs.open_input_file(name))

    def _bounds_of(self, name: str) -> Iterator[tuple[str, str, str, int]]:
        """(first id, last id, file, number) of a file's row groups; without statistics every id may be there."""
        with self._open(name) as f:
            at = f.metadata.schema.names.index("id")
            for i in range(f.metadata.num_row_groups):
                s = f.metadata.row_group(i).column(at).statistics
                known = s is not None and s.has_min_max
                yield (s.min, s.max, name, i) if known else ("", chr(sys.maxunicode), name, i)

    def _group(self, k: int, name: str, number: int) -> tuple[pa.Table, dict[str, list[int]]]:
        """A row group and the places of each id in it."""
        if k not in self.held or self.held[k][0] != (name, number):
            if k not in self.opened or self.opened[k][0] != name:
                if k in self.opened:
                    self.opened.pop(k)[1].close()
                self.opened[k] = name, self._open(name)
            rows = self.opened[k][1].read_row_group(number, columns=CACHE.fieldNames()).select(CACHE.fieldNames())
            places: dict[str, list[int]] = {}
            for p, x in enumerate(rows["id"].to_pylist()):
                places.setdefault(x, []).append(p)
            self.held[k] = (name, number), rows, places
        return self.held[k][1:]


def _part_of(message_id: str, parts: int) -> int:
    return zlib.crc32(message_id.encode()) % parts


def export(mailbox: DataFrame, messages: DataFrame, path: str, parts: int = 16) -> dict[str, str]:
    """Write a mailbox ``(id, ts, labelIds)``, ranged by time into pages, and its cache rows by a hash of the id, then by id.

    Gives the options with which :class:`ExportedMailbox` reads it.
    """
    # Times as microseconds since 1970: the files then have bounds, and no session's zone matters.
    mailbox.select("id", F.unix_micros("ts").alias("micros"), "labelIds").repartitionByRange("micros").sortWithinPartitions(
        "micros").write.parquet(f"{path}/listing")
    part = F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(parts)).cast("int")
    placed = messages.select(*CACHE.fieldNames(), part.alias("part")).repartitionByRange("part", "id")
    placed.sortWithinPartitions("part", "id").write.option("parquet.block.size", GROUP_BYTES).partitionBy("part").parquet(
        f"{path}/messages")
    return {"path": path, "parts": str(parts)}
