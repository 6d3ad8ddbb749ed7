"""Partition-count guards."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread_small_scan(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread a scan that arrives in fewer partitions than the session's
    parallelism (e.g. one file with a single row group) round-robin, so the
    per-row work after it - parsing, text lengths, joins with wide lookups -
    runs on every core.  With many files or row groups (the large-data case)
    this returns ``df`` unchanged and adds no shuffle."""
    try:
        target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        current = df.rdd.getNumPartitions()
    except Exception:  # no RDD view (e.g. a Spark Connect session): leave the scan as is
        return df
    return df.repartition(target) if current < target else df
