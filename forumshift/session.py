"""Session construction and shared-storage helpers.

Everything that needs durable intermediate storage (lineage cuts, written
round-trip tables, streaming checkpoints) goes under the folder the cluster
names in ``spark.checkpoint.dir``.  Only when that setting is absent (local
tests) do we create one ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def is_local(master: str | None) -> bool:
    """One JVM on this machine (``local``, ``local[n]``), not ``local-cluster`` or a cluster."""
    return bool(master) and (master == "local" or master.startswith("local["))


def get_spark(master: str | None = None, app: str = "forumshift",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every job here assumes.

    * AQE on: coalesces small shuffle partitions, splits skewed ones and turns
      joins whose measured build side is small into broadcast joins.
    * UTC session time zone: driver parquet timestamps carry no zone.
    * UI off: no server is opened.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions is None and is_local(master):
        # a cluster's own value stays: it is sized for the cluster, not for this machine
        shuffle_partitions = int(os.environ.get("BENCH_CPUS") or os.cpu_count() or 8)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = (
        builder
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("FORUMSHIFT_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if not is_local(sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="forumshift-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
