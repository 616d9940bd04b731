"""The message cache: one row per message id.

Layouts read here:

* ``parquet`` / ``json`` (JSON lines): rows of :data:`inboxlens.schemas.CACHE`;
  this is the layout to keep at scale.
* ``legacy``: one JSON object ``{id: item}`` per file, as single-machine tools
  write it. A whole file is one record, hence one task: convert it once with
  :func:`save_cache` and stay on rows afterwards.

Both the wrapped item ``{fetched_at, response}`` and the older flat item
(message fields at the top level) are accepted; :func:`response_of` unwraps.
"""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inboxlens.schemas import CACHE, CACHE_MAP

log = logging.getLogger(__name__)


def empty_cache(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CACHE)


def load_cache(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read the cache; a missing path gives an empty cache, bad legacy JSON gives no rows."""
    try:
        if fmt == "parquet":
            df = spark.read.schema(CACHE).parquet(path)
        elif fmt == "json":
            df = spark.read.schema(CACHE).option("mode", "DROPMALFORMED").json(path)
        elif fmt == "legacy":
            raw = spark.read.text(path, wholetext=True)
            entries = raw.select(F.explode(F.from_json("value", CACHE_MAP)).alias("id", "item"))
            df = entries.select("id", *[F.col("item")[f.name].alias(f.name) for f in CACHE.fields if f.name != "id"])
        else:
            raise ValueError(f"unknown cache format: {fmt}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            log.warning("cache %s not found, starting empty", path)
            return empty_cache(spark)
        raise
    # a broken line or entry has no id
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CACHE.fields]).where(F.col("id").isNotNull())


def save_cache(cache: DataFrame, path: str, fmt: str = "parquet") -> bool:
    """Write the cache to ``path`` (never the path it was read from).

    Write errors are logged and reported as ``False`` rather than raised.
    """
    try:
        w = cache.select(*[f.name for f in CACHE.fields]).write.mode("overwrite")
        if fmt == "parquet":
            w.parquet(path)
        elif fmt == "json":
            w.json(path)
        else:
            raise ValueError(f"unknown cache format: {fmt}")
        return True
    except (OSError, AnalysisException) as e:  # pragma: no cover - depends on storage
        log.error("failed to save cache to %s: %s", path, e)
        return False


def response_of(cache: DataFrame | None = None) -> Column:
    """The message of a cache row: ``response`` when wrapped, else the flat fields."""
    flat = F.struct(F.col("snippet").alias("snippet"), F.col("labelIds").alias("labelIds"),
                    F.col("payload").alias("payload"))
    return F.when(F.col("response").isNotNull(), F.col("response")).otherwise(flat)
