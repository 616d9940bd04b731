"""The message snapshot as a merge-on-read log.

A batch adds a delta: the rows that are newer than what the log holds, and marks for removed ids. Nothing else is written,
so a batch costs in proportion to itself. Readers merge: of an id the delta with the highest number counts, else the row
of the base. The base is cut into buckets by the leading bits of the id's hash; now and then a few buckets take in their
deltas (:func:`compact`), and one that has grown past ``target`` rows is split by further bits, as in extendible hashing.

Layout under ``root``; a folder counts only once it has been written to its end:

* ``delta/seq=n``: cache columns and ``gone``;
* ``base/version=n/depth=d/prefix=p``: rows whose hash begins with the d bits p, as of the compaction after batch n;
* ``buckets/version=n``: the directory, a row for each bucket: depth, prefix, version of its rows (-1: none), their number,
  and ``upto``, the last batch they include;
* ``change/seq=n``: what batch n changed in the counts of each sender; ``full/seq=n``: the counts of all senders;
* ``state/seq=n``: one row, written last: the versions of base and full counts that go with batch n, and ``as_of``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inboxlens.operators import messages as MS
from inboxlens.operators import refresh as RF
from inboxlens.operators import senders as SN
from inboxlens.schemas import CACHE, SENDERS
from inboxlens.session import materialize

#: Rows of a bucket before it is split, buckets merged by one compaction, batches between compactions.
TARGET_ROWS, FEW, EVERY = 1_000_000, 8, 16


_DELTA = T.StructType([*CACHE.fields, T.StructField("gone", T.BooleanType())])


@dataclass(frozen=True)
class MessageLog:
    root: str
    target: int = TARGET_ROWS
    few: int = FEW
    every: int = EVERY


@dataclass(frozen=True)
class Bucket:
    depth: int
    prefix: int
    version: int
    rows: int
    upto: int


@dataclass(frozen=True)
class State:
    seq: int = -1
    base: int = -1
    full: int = -1
    as_of: str = ""


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def numbers(spark: SparkSession, root: str, key: str) -> list[int]:
    """The numbers n of the complete folders ``key=n`` under ``root`` (a listing of names, no data)."""
    fs, path = _path(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    found = sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{key}="))
    done = lambda n: _path(spark, f"{root}/{key}={n}/_SUCCESS")[1]
    return [n for n in found if fs.exists(done(n))]


def state(spark: SparkSession, log: MessageLog, before: int | None = None) -> State:
    """The newest committed state (of a batch below ``before``)."""
    known = [n for n in numbers(spark, f"{log.root}/state", "seq") if before is None or n < before]
    if not known:
        return State()
    row = spark.read.parquet(f"{log.root}/state/seq={known[-1]}").first()
    return State(known[-1], row["base"], row["full"], row["as_of"])


def buckets(spark: SparkSession, log: MessageLog, base: int) -> list[Bucket]:
    """The directory: one row for each bucket, of which there are as many as ``target`` goes into the rows."""
    if base < 0:
        return [Bucket(0, 0, -1, 0, -1)]
    rows = spark.read.parquet(f"{log.root}/buckets/version={base}").collect()
    return sorted((Bucket(**r.asDict()) for r in rows), key=lambda b: (b.depth, b.prefix))


def _prefix(depth: Column) -> Column:
    """The leading ``depth`` bits of the id's hash."""
    h = F.xxhash64("id")
    return F.when(depth == 0, F.lit(0).cast("long")).otherwise(
        F.call_function("shiftrightunsigned", h, (F.lit(64) - depth).cast("int")))


def in_buckets(rows: DataFrame, known: list[Bucket]) -> DataFrame:
    """``rows`` with the bucket that each id falls into (depth, prefix, version, upto, and ``held``, its rows).

    The directory is broadcast: dealt by bucket, all rows of a log of few buckets would meet in as few tasks.
    """
    spark = rows.sparkSession
    table = spark.createDataFrame([(b.depth, b.prefix, b.version, b.rows, b.upto) for b in known],
                                  "depth int, prefix long, version long, held long, upto long")
    depths = sorted({b.depth for b in known})
    placed = rows.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths])))
    return placed.withColumn("prefix", _prefix(F.col("depth"))).join(F.broadcast(table), ["depth", "prefix"])


def _deltas(spark: SparkSession, log: MessageLog, seqs: list[int]) -> DataFrame:
    """(cache columns, gone, seq) of the named batches."""
    folders = [f"{log.root}/delta/seq={n}" for n in seqs]
    if not folders:
        return spark.createDataFrame([], CACHE).select("*", F.lit(False).alias("gone"), F.lit(0).cast("long").alias("seq"))
    read = spark.read.schema(_DELTA).option("basePath", f"{log.root}/delta").parquet(*folders)
    return read.select(*CACHE.fieldNames(), "gone", F.col("seq").cast("long").alias("seq"))


def _base(spark: SparkSession, log: MessageLog, known: list[Bucket]) -> DataFrame:
    folders = [f"{log.root}/base/version={b.version}/depth={b.depth}/prefix={b.prefix}" for b in known if b.version >= 0]
    if not folders:
        return spark.createDataFrame([], CACHE)
    return spark.read.option("basePath", f"{log.root}/base").schema(CACHE).parquet(*folders).select(*CACHE.fieldNames())


def _pending(spark: SparkSession, log: MessageLog, known: list[Bucket], last: int) -> list[int]:
    """Batches up to ``last`` that some bucket has not taken in."""
    first = min(b.upto for b in known)
    return [n for n in numbers(spark, f"{log.root}/delta", "seq") if first < n <= last]


def _newest(deltas: DataFrame) -> DataFrame:
    """Of every id the row of the highest batch. A batch has an id once; a bucket that took it in holds the same row.

    Rows are dealt by id first: a file's rows rarely share an id, and sorting them before the shuffle takes a file's memory.
    """
    cols = [*CACHE.fieldNames()[1:], "gone"]
    return deltas.repartition("id").groupBy("id").agg(F.max_by(F.struct(*cols), "seq").alias("r")).select("id", *[F.col(f"r.{c}") for c in cols])


def _merged(base: DataFrame, deltas: DataFrame) -> DataFrame:
    """The base's rows of ids without a delta, and the newest deltas that are not removals."""
    newest = _newest(deltas)
    kept = base.join(newest.select("id"), "id", "left_anti")
    return kept.unionByName(newest.where(~F.col("gone")).select(*CACHE.fieldNames()))


def snapshot(spark: SparkSession, log: MessageLog, at: State | None = None) -> DataFrame:
    """All messages of the log, as cache rows. The deltas meet the base in an anti-join of ids."""
    at = at or state(spark, log)
    known = buckets(spark, log, at.base)
    return _merged(_base(spark, log, known), _deltas(spark, log, _pending(spark, log, known, at.seq)))


def lookup(spark: SparkSession, log: MessageLog, ids: DataFrame, at: State | None = None) -> DataFrame:
    """The messages of ``ids`` (id, different ones): only the buckets that these fall into are read."""
    at = at or state(spark, log)
    known = buckets(spark, log, at.base)
    hit = {(r["depth"], r["prefix"]) for r in in_buckets(ids.select("id"), known).select("depth", "prefix").distinct().collect()}
    base = _base(spark, log, [b for b in known if (b.depth, b.prefix) in hit])
    deltas = _deltas(spark, log, _pending(spark, log, known, at.seq))
    return _merged(base.join(ids, "id", "left_semi"), deltas.join(ids, "id", "left_semi"))


def _counts(rows: DataFrame, as_of) -> DataFrame:
    """Counts per sender of ``rows`` (cache columns and ``sign``, 1 for what comes and -1 for what goes)."""
    counts = SN.sender_counts(MS.extract(rows, as_of, keep=["sign"]), "sign")
    return counts.groupBy("from").agg(*[F.sum(F.col(c) * F.col("sign")).alias(c) for c in counts.columns if c not in ("from", "sign")])


def append(spark: SparkSession, log: MessageLog, batch: DataFrame, seq: int, as_of=None,
           listing: DataFrame | None = None) -> State:
    """Add batch number ``seq``; safe to run again for the same number, with the same result.

    Of an id the newest fetch counts, within the batch and against the log (the batch on equal stamps); rows without an
    id are left out. With a ``listing`` (id) all other ids are removed: that reads the log's ids, but writes only marks
    for those that go. The counts per sender are changed by what goes and what comes. Ages depend on ``as_of``: for
    another one, or none, all counts are made anew.
    """
    cols, before, stamp = CACHE.fieldNames(), state(spark, log, seq), str(as_of)
    new = RF.latest_per_id(batch.select(*cols).where(F.col("id").isNotNull()))
    new = materialize(new, "log-batch")
    old = materialize(lookup(spark, log, new.select("id"), before), "log-old")
    accepted = RF.newer(new, old)
    delta = accepted.withColumn("gone", F.lit(False))
    leaves = old.join(accepted.select("id"), "id", "left_semi")
    if listing is not None:
        listed = listing.select("id").distinct()
        delta = delta.join(listed, "id", "left_semi")
        lost = materialize(snapshot(spark, log, before).join(listed, "id", "left_anti"), "log-lost")
        delta = delta.unionByName(lost.withColumn("gone", F.lit(True)))
        leaves = leaves.join(listed, "id", "left_semi").unionByName(lost)
    # Narrow bodies: a mark needs the id alone.
    delta = delta.select("id", *[F.when(~F.col("gone"), F.col(c)).alias(c) for c in cols[1:]], "gone")
    delta.write.mode("overwrite").parquet(f"{log.root}/delta/seq={seq}")
    written = spark.read.parquet(f"{log.root}/delta/seq={seq}").where(~F.col("gone"))
    now = State(seq, before.base, before.full, stamp)
    if as_of is None or (before.seq >= 0 and before.as_of != stamp):
        every = snapshot(spark, log, now).withColumn("sign", F.lit(1))
        _counts(every, as_of).write.mode("overwrite").parquet(f"{log.root}/full/seq={seq}")
        now = State(seq, before.base, seq, stamp)
    else:
        moved = written.select(*cols, F.lit(1).alias("sign")).unionByName(leaves.select(*cols, F.lit(-1).alias("sign")))
        _counts(moved, as_of).write.mode("overwrite").parquet(f"{log.root}/change/seq={seq}")
    if len(_pending(spark, log, buckets(spark, log, now.base), seq)) >= log.every:
        now = compact(spark, log, now)
    row = spark.createDataFrame([(now.base, now.full, now.as_of)], "base long, full long, as_of string")
    row.coalesce(1).write.mode("overwrite").parquet(f"{log.root}/state/seq={seq}")
    _clean(spark, log, [before, now])
    return now


def compact(spark: SparkSession, log: MessageLog, at: State) -> State:
    """Merge the deltas of a few buckets into their rows, those first that have waited longest; split what has grown.

    Buckets without a delta are up to date as they are. The counts' changes are added up to new full counts.
    """
    known = buckets(spark, log, at.base)
    deltas = _deltas(spark, log, _pending(spark, log, known, at.seq))
    waiting = in_buckets(deltas.select("id", "seq"), known).where("seq > upto").groupBy("depth", "prefix", "upto", "held").agg(
        F.count(F.lit(1)).alias("n"))
    waiting = materialize(waiting, "log-waiting")
    due = {(r["depth"], r["prefix"]): r["held"] + r["n"] for r in waiting.orderBy("upto", F.desc("n")).limit(log.few).collect()}
    # At most a row for each bucket, like the directory itself.
    late = {(r["depth"], r["prefix"]) for r in waiting.select("depth", "prefix").collect()} - set(due)
    chosen = [b for b in known if (b.depth, b.prefix) in due]
    made: list[Bucket] = []
    if chosen:
        rows = _merged(_base(spark, log, chosen), in_buckets(deltas, known).join(
            F.broadcast(spark.createDataFrame([(b.depth, b.prefix) for b in chosen], "depth int, prefix long")), ["depth", "prefix"],
            "left_semi").select(*CACHE.fieldNames(), "gone", "seq"))
        # New depth of each chosen bucket: as many further bits as bring its parts below the target.
        deeper = {(b.depth, b.prefix): b.depth + max(0, math.ceil(math.log2(due[b.depth, b.prefix] / log.target))) for b in chosen}
        inside = lambda b: _prefix(F.lit(b[0])) == b[1]
        depth = reduce(lambda a, x: a.when(inside(x[0]), x[1]), deeper.items(), F.when(F.lit(False), 0))
        placed = rows.withColumn("depth", depth).withColumn("prefix", _prefix(F.col("depth")))
        path = f"{log.root}/base/version={at.seq}"
        placed.hint("rebalance", "depth", "prefix").write.mode("overwrite").partitionBy("depth", "prefix").parquet(path)
        back = spark.read.schema("id string, depth int, prefix long").parquet(path)
        sizes = {(r["depth"], r["prefix"]): r["n"] for r in back.groupBy("depth", "prefix").agg(F.count(F.lit(1)).alias("n")).collect()}
        # A chosen bucket is replaced by all of its parts, empty ones too.
        for (d, p), to in deeper.items():
            for q in range(p << (to - d), (p + 1) << (to - d)):
                n = sizes.get((to, q), 0)
                made.append(Bucket(to, q, at.seq if n else -1, n, at.seq))
    kept = [b if (b.depth, b.prefix) in late else Bucket(b.depth, b.prefix, b.version, b.rows, at.seq)
            for b in known if (b.depth, b.prefix) not in due]
    table = spark.createDataFrame([(b.depth, b.prefix, b.version, b.rows, b.upto) for b in [*kept, *made]],
                                  "depth int, prefix long, version long, rows long, upto long")
    table.coalesce(1).write.mode("overwrite").parquet(f"{log.root}/buckets/version={at.seq}")
    total = _sender_counts(spark, log, at)
    if total is not None and at.full != at.seq:
        sums = total.groupBy("from").agg(*[F.sum(c).alias(c) for c in total.columns if c != "from"])
        sums.write.mode("overwrite").parquet(f"{log.root}/full/seq={at.seq}")
        return State(at.seq, at.seq, at.seq, at.as_of)
    return State(at.seq, at.seq, at.full, at.as_of)


def _sender_counts(spark: SparkSession, log: MessageLog, at: State) -> DataFrame | None:
    folders = [f"{log.root}/full/seq={at.full}"] if at.full >= 0 else []
    folders += [f"{log.root}/change/seq={n}" for n in numbers(spark, f"{log.root}/change", "seq") if at.full < n <= at.seq]
    return reduce(DataFrame.unionByName, [spark.read.parquet(f) for f in folders]) if folders else None


def sender_table(spark: SparkSession, log: MessageLog) -> DataFrame:
    """The sender table (E1) of the newest state, from the counts alone."""
    counts = _sender_counts(spark, log, state(spark, log))
    return spark.createDataFrame([], SENDERS) if counts is None else SN.score_counts(counts)


def _clean(spark: SparkSession, log: MessageLog, used: list[State]) -> None:
    """Delete what neither of the ``used`` states reads: a reader of the state before is not disturbed."""
    keep = {"base": set(), "buckets": {s.base for s in used}, "full": {s.full for s in used}, "state": {s.seq for s in used}}
    last = max(s.seq for s in used)
    upto = last
    for s in used:
        known = buckets(spark, log, s.base)
        keep["base"] |= {b.version for b in known}
        upto = min(upto, *(b.upto for b in known))
    changed = min(s.full for s in used)
    for kind, key, gone in (
            ("base", "version", lambda n: n not in keep["base"]), ("buckets", "version", lambda n: n not in keep["buckets"]),
            ("full", "seq", lambda n: n not in keep["full"]), ("state", "seq", lambda n: n not in keep["state"]),
            ("delta", "seq", lambda n: n <= upto), ("change", "seq", lambda n: n <= changed)):
        for n in numbers(spark, f"{log.root}/{kind}", key):
            if n < last and gone(n):
                fs, path = _path(spark, f"{log.root}/{kind}/{key}={n}")
                fs.delete(path, True)
