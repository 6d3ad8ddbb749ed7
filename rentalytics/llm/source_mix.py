"""Mixing sources to target weights by hash-threshold histograms.

Words are summed by source and hash bucket.  Where a source's budget ends
inside a bucket, only that bucket is summed again by the next bits of the
hash, until the cut is between two hash values.  A document is in if its
hash is at most its source's threshold: no sort, and a larger budget only
adds documents (nested thresholds).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

# Fixed values of the mix: weights by source order (repeating), share of all words, most repeats.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
# The hash has HASH_BITS bits and is refined BUCKET_BITS at a time.
HASH_BITS = 60
BUCKET_BITS = 12


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(common.WORD_PATTERN)).cast("long")


def mix_hash() -> Column:
    """60 bits from doc_id and text: the same in every run."""
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"),
                            F.md5(common.text_of().cast("binary"))).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source: source, source_size, target (in words).

    ``sizes`` has source and size.  Sources in code point order (null last)
    weigh WEIGHTS, repeating; a target stops at REPEATS times the source and
    the excess goes to the others by weight until none is above.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    listed = common.written(common.ranked(sums, order, "place", "sources"), "weights")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    listed = listed.select("source", "source_size", weight.alias("weight"),
                           (F.col("source_size") * REPEATS).alias("most"))
    total = listed.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1  # words per unit of weight; sources at their most
    while True:
        above = F.col("most") < F.col("weight") * F.lit(level)
        got = listed.agg(F.count_if(above).alias("n"), F.sum(F.when(above, F.col("most"))).alias("most"),
                         F.sum(F.when(~above, F.col("weight"))).alias("weight")).first()
        if got["n"] == capped or not got["weight"]:
            break
        capped = got["n"]
        level = (total * SHARE - (got["most"] or 0)) / got["weight"]
    return listed.select(
        "source", "source_size",
        F.least(F.col("most").cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def mix_thresholds(hashed: DataFrame) -> DataFrame:
    """One row per source: source, source_size, target, copies, threshold.

    ``hashed`` has source, size and hash (written: it is read once a level).
    Every document of the source is taken ``copies`` times, and once more if
    its hash is at most ``threshold``; the cut is the one nearest to the
    target (documents with one hash are cut together).
    """
    size = F.col("source_size")
    copies = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    plan = common.written(
        source_targets(hashed).withColumn("copies", copies)
        .withColumn("rest", F.col("target") - F.col("copies") * size), "mix_plan")
    state = plan.select("source", "rest", F.lit(0).cast("long").alias("prefix"),
                        F.lit(0).cast("long").alias("before"))
    done = []
    for shift in range(HASH_BITS - BUCKET_BITS, -1, -BUCKET_BITS):
        narrowed = (hashed.withColumnRenamed("source", "of").join(state, F.col("of").eqNullSafe(F.col("source")))
                    .where(F.shiftright("hash", shift + BUCKET_BITS) == F.col("prefix")))
        buckets = narrowed.groupBy("source", "rest", "before", F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        running = Window.partitionBy("source").orderBy("bucket")  # 2**BUCKET_BITS rows at most
        cut = (buckets.withColumn("upto", F.col("before") + F.sum("words").over(running))
               .withColumn("start", F.col("upto") - F.col("words"))
               .where((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("upto"))))
        cut = common.written(cut, "mix_cut")
        ended = F.lit(shift == 0) | (F.col("low") == F.col("high"))
        inside = F.col("start") + F.col("words") / 2 <= F.col("rest")
        done.append(cut.where(ended).select(
            F.col("source").alias("cut_source"),
            F.when(inside, F.col("high")).otherwise(F.col("low") - 1).alias("threshold")))
        state = cut.where(~ended).select("source", "rest", F.col("bucket").alias("prefix"),
                                         F.col("start").alias("before"))
        if state.isEmpty():
            break
    cuts = reduce(DataFrame.unionByName, done)
    joined = plan.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left")
    # No bucket goes beyond the budget only where the source has no words.
    return common.written(joined.select("source", "source_size", "target", "copies",
                                        F.coalesce("threshold", F.lit(-1)).alias("threshold")), "mix_thresholds")


def mixed(hashed: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``hashed`` with source_size, target and ``times`` (0 .. REPEATS) of each row."""
    names = ("source_size", "target", "times")
    kept = [c for c in hashed.columns if c not in names]
    side = thresholds.withColumnRenamed("source", "plan_source").withColumnRenamed("copies", "plan_copies") \
        .withColumnRenamed("threshold", "plan_threshold")
    return (hashed.select(*kept).join(side, F.col("source").eqNullSafe(F.col("plan_source")))
            .withColumn("times", (F.col("plan_copies")
                                  + F.when(F.col("hash") <= F.col("plan_threshold"), 1).otherwise(0)).cast("int"))
            .drop("plan_source", "plan_copies", "plan_threshold"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it (0,
    1 or 2 times), all columns kept.

    A null text has no words, and null sources form one source, the last.
    Rows equal in doc_id and text share a hash and are taken alike.  An
    empty table gives an empty mix.  Columns named size or hash are kept.
    """
    size, code = common.fresh(docs, "mix_size", "mix_hash")
    narrow = common.written(docs.select("source", word_count(F.col("text")).alias("size"),
                                        mix_hash().alias("hash")), "mix_sizes")
    thresholds = mix_thresholds(narrow)
    side = thresholds.select(F.col("source").alias(size), F.struct("copies", "threshold").alias(code))
    times = (F.col(code)["copies"] + F.when(mix_hash() <= F.col(code)["threshold"], 1).otherwise(0)).cast("int")
    copy, = common.fresh(docs, "mix_copy")
    return (docs.join(side, F.col("source").eqNullSafe(F.col(size)))
            .select(*docs.columns, F.explode(F.array_repeat(F.lit(1), times)).alias(copy)).drop(copy))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    hashed = common.written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                                        mix_hash().alias("hash")), "mix_sizes")
    return mixed(hashed, mix_thresholds(hashed)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15)
              AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(place - 1) % 3 + 1] AS weight, 2 * source_size AS most FROM s),
r AS (SELECT *, row_number() OVER o AS k, sum(most) OVER o AS most_upto, sum(weight) OVER o AS weight_upto,
             sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
      FROM w WINDOW o AS (ORDER BY CAST(most AS DOUBLE) / weight, place ROWS UNBOUNDED PRECEDING)),
l AS (SELECT min_by((CAST(total AS DOUBLE) * 1.5 - CAST(most_upto - most AS DOUBLE))
                    / CAST(weights - weight_upto + weight AS DOUBLE), k) AS level
      FROM r
      WHERE (CAST(total AS DOUBLE) * 1.5 - CAST(most_upto - most AS DOUBLE))
            / CAST(weights - weight_upto + weight AS DOUBLE) <= CAST(most AS DOUBLE) / weight),
t AS (SELECT source, source_size, least(CAST(most AS DOUBLE), weight * level) AS target FROM w, l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
g AS (SELECT source, h, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto
      FROM d GROUP BY source, h)
SELECT d.doc_id, d.size, p.source_size, p.target,
       CAST(d.size * (p.copies + CASE WHEN g.upto - g.words + g.words / 2.0 <= p.target - p.copies * p.source_size
                                      THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
JOIN g ON d.source IS NOT DISTINCT FROM g.source AND d.h = g.h
"""
