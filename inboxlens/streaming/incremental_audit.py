"""Incremental audit as a Structured Streaming job.

Fetched messages arrive as files (one cache row each, JSON lines or Parquet). Every micro-batch is appended to a
merge-on-read log of messages (:mod:`inboxlens.streaming.message_log`): it writes in proportion to its own rows, keeps the
newest fetch of each id however late the other arrives, and changes the counts per sender by what goes and what comes.
The sender table is read from these counts. A retried batch gives the same state again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from inboxlens.schemas import CACHE
from inboxlens.streaming import message_log as ML


@dataclass
class AuditPaths:
    source: str         # directory the fetched message files land in
    log: str            # root of the message log
    checkpoint: str     # streaming checkpoint of this query
    target: int = ML.TARGET_ROWS  # rows of a bucket of the log before it is split
    few: int = ML.FEW             # buckets that one compaction merges
    every: int = ML.EVERY         # batches between compactions

    def message_log(self) -> ML.MessageLog:
        return ML.MessageLog(self.log, self.target, self.few, self.every)


def latest_snapshot(spark: SparkSession, paths: AuditPaths) -> DataFrame:
    """The messages as of the newest batch, or an empty cache."""
    return ML.snapshot(spark, paths.message_log())


def current_senders(spark: SparkSession, paths: AuditPaths) -> DataFrame:
    """The sender table as of the newest batch, or an empty one."""
    return ML.sender_table(spark, paths.message_log())


def apply_batch(spark: SparkSession, batch: DataFrame, epoch: int, paths: AuditPaths, as_of=None,
                listing: DataFrame | None = None) -> None:
    """One refresh step; safe to run again for the same ``epoch``. With a ``listing`` all other ids are removed."""
    ML.append(spark, paths.message_log(), batch, epoch, as_of, listing)


def start_incremental_audit(spark: SparkSession, paths: AuditPaths, fmt: str = "json", as_of=None,
                            listing: DataFrame | None = None, available_now: bool = True,
                            processing_time: str | None = None,
                            max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the streaming refresh; ``available_now`` processes what is there and stops."""
    reader = spark.readStream.schema(CACHE).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(paths.source)

    def run(batch: DataFrame, epoch: int) -> None:
        apply_batch(spark, batch, epoch, paths, as_of, listing)

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", paths.checkpoint)
    if processing_time:
        w = w.trigger(processingTime=processing_time)
    elif available_now:
        w = w.trigger(availableNow=True)
    return w.start()
