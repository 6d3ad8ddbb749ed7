"""Connected components of a link table by large-star / small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (columns u, v, long): root is
    the smallest node its links reach.

    Each round moves links towards smaller nodes: a node's larger neighbours
    are linked to its smallest one, then its smaller ones are.  The table
    never has more links than before and rounds grow with the logarithm of
    the nodes.  A node with many links costs aggregation and a join whose
    skewed side Spark splits, never a list in one task.
    """
    edges = common.written(
        links.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while (now := _checksum(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
        large = (both.join(least, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("least").alias("v")).distinct())
        large = common.written(large, "large_star")
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        small = (large.join(least, "u").where(F.col("v") != F.col("least"))
                 .select(F.col("v").alias("u"), F.col("least").alias("v"))
                 .unionByName(least.select("u", F.col("least").alias("v"))).distinct())
        edges = common.written(small, "small_star")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return common.written(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "roots")
