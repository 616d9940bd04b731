"""The sender table ("noise report") on storage."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inboxlens.schemas import SENDERS

log = logging.getLogger(__name__)

#: Standard quoting: a quote within a quoted field is doubled.
_CSV = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
_TYPES = {f.name: f.dataType for f in SENDERS.fields}


def load_senders(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Read a sender table; columns are matched by header name, in any order.

    Known columns get their declared types, and a value that does not fit its
    type is an error; a missing file gives an empty table with the full schema.
    CSV fields may hold commas, quotes and line breaks, quoted as usual.
    """
    try:
        if fmt == "csv":
            raw = spark.read.options(**_CSV).option("inferSchema", False).option("multiLine", True).csv(path)
        elif fmt == "parquet":
            raw = spark.read.parquet(path)
        else:
            raise ValueError(f"unknown sender table format: {fmt}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            log.warning("%s not found; run the audit first", path)
            return spark.createDataFrame([], SENDERS)
        raise
    def typed(c: str):
        text = F.col(f"`{c}`")
        value = text.try_cast(_TYPES[c])
        problem = F.concat(F.lit(f"sender table: {c} cannot be "), text.cast("string"))
        return F.when(text.isNotNull() & value.isNull(), F.raise_error(problem).cast(_TYPES[c])).otherwise(value)

    return raw.select(*[(typed(c) if c in _TYPES else F.col(f"`{c}`")).alias(c) for c in raw.columns])


def save_senders(senders: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write the sender table; CSV gets a header row and no index column."""
    w = senders.write.mode("overwrite")
    if fmt == "csv":
        w.options(**_CSV).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unknown sender table format: {fmt}")
