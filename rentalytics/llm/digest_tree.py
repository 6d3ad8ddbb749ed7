"""Exact dedup by a tree-merge of sorted digest runs.

Every scan partition gives one run: its digests, sorted, with the best row
of each.  In each round ``FAN_IN`` neighbouring runs are merged into one,
keeping the best row and the count per digest, until one run is left.  The
winners then go back down the same tree, from merged run to its parts.

A digest is in a run once, so a text that a third of all rows share costs
one entry per run and never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FAN_IN = 8
# Equal digests count as equal texts only if a second hash and the length agree too.
DIGEST = ("digest", "check", "n_bytes")


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), common.SPACES, "")


def digest_runs(docs: DataFrame) -> DataFrame:
    """One narrow row per row of ``docs``: run, row id, digests, and ``best``,
    whose smallest value stays (longest original, smallest doc_id, null last)."""
    plain = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"),
                        normalised(F.col("text")).alias("plain"))
    return plain.select(
        F.spark_partition_id().alias("run"),
        F.struct((-F.length("text")).alias("longest"), F.col("doc_id").isNull().alias("no_id"),
                 "doc_id", F.monotonically_increasing_id().alias("row")).alias("best"),
        F.unhex(F.sha2(F.col("plain").cast("binary"), 256)).alias("digest"),
        F.xxhash64("plain").alias("check"),
        F.octet_length("plain").alias("n_bytes"))


def exact_dedup(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree without white space (null counts as
    empty); the row with the most code points, then the smallest doc_id,
    stays.  A null doc_id comes after all others; of fully repeated rows
    exactly one stays.  An empty table gives no rows.
    """
    rows = common.written(digest_runs(docs), "digests")
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    levels = [common.written(
        rows.groupBy("run", *DIGEST).agg(F.min("best").alias("best"), F.count(F.lit(1)).alias("n")), "run0")]
    while runs > 1:
        merged = (levels[-1].withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
                  .groupBy("run", *DIGEST).agg(F.min("best").alias("best"), F.sum("n").alias("n")))
        levels.append(common.written(merged, f"run{len(levels)}"))
        runs = -(-runs // fan_in)
    won = levels.pop().select("run", *DIGEST, F.col("best").alias("winner"), "n")
    while levels:
        parts = levels.pop().select("run", *DIGEST)
        above = won.withColumnRenamed("run", "above")
        won = (parts.withColumn("above", F.floor(F.col("run") / fan_in).cast("int"))
               .join(above, ["above", *DIGEST]).select("run", *DIGEST, "winner", "n"))
    return rows.join(won, ["run", *DIGEST]).select(
        F.col("best.doc_id").alias("doc_id"), F.col("winner.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"), (F.col("best.row") == F.col("winner.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def op2_digest_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents),
g AS (
  SELECT doc_id, h, count(*) OVER (PARTITION BY h) AS group_size,
         first_value(doc_id) OVER (PARTITION BY h ORDER BY len DESC, doc_id NULLS LAST) AS keep_id
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, h AS text_sha256 FROM g
"""
