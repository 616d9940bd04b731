"""Session construction and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app: str = "inboxlens",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every operator assumes.

    Session time zone is UTC (ages and staleness are whole UTC days), AQE is on
    so skewed senders get split at run time, and the UI stays off.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            # Large task results are dropped unless the driver host is loopback.
            b = (b.config("spark.driver.host", "127.0.0.1")
                  .config("spark.driver.bindAddress", "127.0.0.1")
                  .config("spark.driver.memory", os.environ.get("INBOXLENS_DRIVER_MEMORY", "12g")))
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may do without: a private folder is then created and
    registered as the checkpoint directory. On a cluster a missing setting is
    an error, as executors would write to folders that nobody else sees.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - no SparkContext in this client: use the configured folder
        sc = None
    if sc is not None and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d and sc is not None:
        d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if sc is not None and not sc.master.startswith("local") or sc is None or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="inboxlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if sc is None:
        return d
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def shared_dir(spark: SparkSession, *parts: str, unique: bool = True) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    root = checkpoint_root(spark).rstrip("/")
    leaf = "/".join(parts) if parts else "tables"
    if unique:
        leaf = f"{leaf}-{uuid.uuid4().hex[:12]}"
    return f"{root}/inboxlens/{leaf}"


def materialize(df, name: str):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage: consumers re-read the written table, and a lost executor
    costs a re-read rather than a replay of everything before it.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
