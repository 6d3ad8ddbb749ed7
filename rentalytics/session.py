"""Session construction and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job here relies on: runtime re-planning, skew splitting and
# a fixed UTC clock so parsed dates do not depend on the machine.
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Large-cluster sizing (~100 TB inputs): many initial shuffle partitions that
# AQE coalesces to ~256 MB each, 256 MB scan splits, skew splitting above
# 5x the median partition, and a broadcast threshold that stays small.
CLUSTER_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
}


def build_session(master: str | None = None, app_name: str = "rentalytics",
                  shuffle_partitions: int | None = None, extra: dict | None = None,
                  cluster: bool = False) -> SparkSession:
    """Create (or reuse) a session with the defaults above.

    On a cluster leave ``master`` unset, pass ``cluster=True`` for the sizing
    in ``CLUSTER_DEFAULTS`` and name ``spark.checkpoint.dir`` (a shared
    folder) in ``extra`` or through the submit configuration.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_DEFAULTS, **(CLUSTER_DEFAULTS if cluster else {})}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and written intermediate tables.

    Read from ``spark.checkpoint.dir`` (what the cluster names).  Only a
    local-mode session with nothing configured gets a fresh scratch folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server owns the checkpoint folder
        if not configured:
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        return configured.rstrip("/")
    configured = configured or sc.getCheckpointDir()
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="rentalytics-")
    sc.setCheckpointDir(folder)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for one written intermediate."""
    return os.path.join(shared_dir(spark), "tables", f"{name}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df):
    """``df`` written once as parquet in the shared folder and read back:
    later passes prune columns and push filters into the written data, and a
    lost executor costs a re-read, not a recomputation of everything upstream."""
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
