"""The message table on storage, partitioned by month of the message time.

Audits bounded in time (``since`` / ``until``) then read only the months they
need: the month filter becomes a partition filter of the scan, so whole
directories are skipped without opening their files. Undated messages go to
the null-month partition.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inboxlens.functions.dates import as_of_column, with_date_ts
from inboxlens.schemas import MESSAGES


def save_messages(messages: DataFrame, path: str) -> None:
    """Write messages (the 12 columns, plus ``ts`` if present) partitioned by ``month``."""
    m = messages if "ts" in messages.columns else with_date_ts(messages, "date", "ts")
    (m.withColumn("month", F.date_format("ts", "yyyy-MM"))
      .write.mode("overwrite").partitionBy("month").parquet(path))


def load_messages(spark: SparkSession, path: str, since=None, until=None) -> DataFrame:
    """Read stored messages, pruned to the months overlapping ``[since, until)``.

    The month bounds prune partitions; the exact ``ts`` bounds then trim the
    edge months. A missing path gives an empty table.
    """
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return spark.createDataFrame([], MESSAGES).withColumn("ts", F.lit(None).cast("timestamp"))
        raise
    if since is not None:
        lo = as_of_column(since)
        df = df.where((F.col("month") >= F.date_format(lo, "yyyy-MM")) & (F.col("ts") >= lo))
    if until is not None:
        hi = as_of_column(until)
        df = df.where((F.col("month") <= F.date_format(hi, "yyyy-MM")) & (F.col("ts") < hi))
    return df.drop("month")
