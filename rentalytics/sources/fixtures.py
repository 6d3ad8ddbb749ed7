"""Binding of the raw listing/review tables to the driver's test tables.

listings = orders (+ customer, nation, part), reviews = lineitem (+ documents).
Nulls and junk are injected by key arithmetic so that every cleaning rule has
something to act on.  The same binding is written in SQL for the oracle.

Every order, line item, part and document is read: a key beyond a lookup
table wraps around by that table's own row count.  All joins are equi-joins
that Spark plans by size (documents are shuffled where they are large).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RAW_LISTING_COLUMNS
from ..operators.partitioning import spread_small_scan

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _s(c) -> F.Column:
    return c.cast("string")


def raw_listings(spark: SparkSession, sf_dir: str, all_columns: bool = True) -> DataFrame:
    """The raw listings table (all text).  ``all_columns`` adds the 56 columns
    the cleaning never reads, as NULL text."""
    o = spread_small_scan(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")

    k = F.col("o_orderkey")
    joined = (o.join(c, F.col("o_custkey") == F.col("c_custkey"))
              .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
              .join(p, F.col("p_partkey") == k % max(p.count(), 1)))

    def unless(cond, value):
        return F.when(cond, F.lit(None).cast("string")).otherwise(value)

    total = F.col("o_totalprice")
    thousands = F.floor(total / 100000).cast("bigint")
    units = F.floor(total / 100).cast("bigint")
    price = (F.when(k % 29 == 0, F.lit(None).cast("string"))
             .when(total >= 100000,
                   F.concat(F.lit("$"), _s(thousands), F.lit(","),
                            F.lpad(_s(units % 1000), 3, "0"), F.lit(".00")))
             .otherwise(F.concat(F.lit("$"), _s(units), F.lit(".00"))))
    p_name = F.col("p_name")
    cols = {
        "id": (F.when(k % 211 == 7, F.concat(F.lit(" "), _s(k), F.lit(" ")))
               .when(k % 223 == 5, _s(k + 100000000000000000))
               .when(k % 227 == 3, F.concat(_s(k), F.lit(".0"))).otherwise(_s(k))),
        "neighbourhood_cleansed": (F.when(k % 61 == 0, F.lit(None).cast("string"))
                                   .when(k % 499 == 88, F.concat(F.lit("Quarter "), _s(k))).otherwise(F.col("n_name"))),
        "latitude": unless(k % 97 == 0,
                           F.concat(F.lit("48."), _s(8566 + (F.col("o_custkey") % 200 - 100) * 5))),
        "longitude": F.concat(F.lit("2."), _s(3522 + (k % 300 - 150) * 3)),
        "property_type": (F.when(k % 53 == 1, F.concat(p_name, F.lit(" boat")))
                          .when(k % 59 == 2, F.concat(F.lit("Loft "), p_name)).otherwise(p_name)),
        "room_type": F.col("o_orderpriority"),
        "accommodates": unless(k % 89 == 0, F.when(k % 47 == 3, "2.5").when(k % 97 == 5, "1e1")
                               .when(k % 83 == 4, " 3 ").otherwise(_s(k % 9))),
        "bedrooms": unless(k % 17 == 0, _s(k % 5)),
        "beds": (F.when(k % 13 == 0, F.lit("N/A")).when(k % 101 == 1, F.lit("1d")).when(k % 103 == 2, F.lit("nan"))
                 .otherwise(_s(1 + k % 6))),
        "bathrooms": unless(k % 19 == 0, F.concat(_s(k % 4), F.lit(".5"))),
        "amenities": (F.when(k % 23 == 0, F.lit(None).cast("string"))
                      .when(k % 31 == 0, F.lit("[]"))
                      .otherwise(F.concat(F.lit('["'), F.replace(p_name, F.lit(" "), F.lit('", "')),
                                          F.lit('"]')))),
        "price": price,
        "minimum_nights": F.when(k % 43 == 2, F.lit("1.5")).when(k % 41 == 3, F.lit("0")).otherwise(_s(1 + k % 40)),
        "maximum_nights": F.when(k % 37 == 1, F.lit("2")).when(k % 109 == 4, F.lit("n/a")).otherwise(_s(20 + k % 400)),
        "host_is_superhost": (F.when(k % 3 == 0, F.lit("t")).when(k % 3 == 1, F.lit("f"))
                              .otherwise(F.lit(None).cast("string"))),
        "review_scores_rating": unless(k % 7 == 0, _s(3 + k % 3)),
        "reviews_per_month": unless(k % 11 == 0, F.concat(_s(k % 5), F.lit(".25"))),
    }
    names = RAW_LISTING_COLUMNS if all_columns else tuple(cols)
    return joined.select(*[
        (cols[name] if name in cols else F.lit(None).cast("string")).alias(name) for name in names])


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw reviews table (all text); comments are document texts."""
    li = spread_small_scan(
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    j = li.join(d, F.col("doc_id") == F.col("l_partkey") % max(d.count(), 1))
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    null = F.lit(None).cast("string")
    return j.select(
        _s(F.col("l_orderkey")).alias("listing_id"),
        F.concat(_s(F.col("l_orderkey") * 100000 + part), F.when(part % 113 == 3, ".5").otherwise("")).alias("id"),
        F.when(part % 101 == 0, null).when(part % 103 == 1, "2020-02-30").when(part % 107 == 2, "soon").otherwise(F.substring(_s(F.col("l_shipdate")), 1, 10)).alias("date"),
        _s(supp).alias("reviewer_id"),
        F.when(supp % 11 == 0, null).otherwise(F.concat(F.lit("Supplier "), _s(supp))).alias("reviewer_name"),
        F.when(part % 37 == 0, null).otherwise(F.col("text")).alias("comments"),
    )
