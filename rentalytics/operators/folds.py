"""Folds, splits and quantile bins, all deterministic per key.

Membership is a function of the keys and ``key_hash(id, seed)`` only, so it
survives repartitioning, retries and executor loss unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import key_hash
from ..functions.hashing import HASH_BITS
from ..session import cut_lineage
from .broadcast import broadcast_if_small
from .stats import attach, quantiles_row

DECILES = [i / 10 for i in range(1, 10)]


# --- T1 ---------------------------------------------------------------------
def assign_folds(df: DataFrame, k: int = 5, seed: int = 42, key: str = "id",
                 fold_col: str = "fold") -> DataFrame:
    """fold = H(key) % k: sizes within a few percent, no shuffle."""
    return df.withColumn(fold_col, (key_hash(key, seed) % k).cast("int"))


def balanced_folds(df: DataFrame, k: int = 5, seed: int = 42, key: str = "id", fold_col: str = "fold") -> DataFrame:
    """Folds whose sizes differ by one at most: the rows in the order of (H(key),
    key), cut into k runs, the first n % k of them one row longer.

    Only the k - 1 rows where runs end are looked for (``last_of_quotas``); every
    other row is compared with them, so no row is sorted or moved.  A null key
    takes part like any other; rows that share a key share a fold, and the sizes
    are exact where keys are distinct.
    """
    ends = [f"(n div {k}) * {j} + least({j}, n % {k})" for j in range(1, k)]
    quotas = (df.agg(F.count(F.lit(1)).alias("n"))
              .select(F.lit(0).alias("s"), F.posexplode(F.array(*[F.expr(e) for e in ends])).alias("cut", "quota")))
    cuts = last_of_quotas(df.withColumn("__one", F.lit(0)), "__one", quotas, seed, key)
    ordered = F.sort_array(F.collect_list(F.struct("cut", "last")))
    one_row = cut_lineage(cuts.agg(ordered.alias("__cuts")))  # k - 1 pairs
    passed = F.filter("__cuts", lambda c: c["last"] < _order_pair(key, seed))
    return (df.crossJoin(F.broadcast(one_row))
            .select(*df.columns, F.size(passed).cast("int").alias(fold_col)))


# --- T2 ---------------------------------------------------------------------
def holdout_flag(df: DataFrame, fraction: float, seed: int = 42, key: str = "id",
                 flag_col: str = "is_holdout") -> DataFrame:
    """Unstratified split: a key is held out when its hash, read as a share of
    the whole hash range, is below ``fraction``."""
    return df.withColumn(flag_col, key_hash(key, seed) < F.lit(float(fraction) * 2.0 ** HASH_BITS))


# --- A13 --------------------------------------------------------------------
def quantile(df: DataFrame, col: str, q: float, method: str = "select") -> DataFrame:
    """1-row frame with the linearly interpolated ``q`` quantile of ``col``."""
    return quantiles_row(df, col, [q], method).select(F.col("q")[0].alias("q"))


# --- A14 --------------------------------------------------------------------
def quantile_bins(df: DataFrame, col: str, q: int = 10, out: str = "stratum",
                  method: str = "select") -> DataFrame:
    """Equal-frequency bins like ``qcut(.., q, duplicates='drop')``.

    Edges are the interpolated quantiles; duplicated edges and edges equal to
    the minimum are dropped; intervals are right-closed with the minimum in
    bin 0, so a value's bin is the number of remaining edges below it.  The
    edges (and the minimum, the 0-quantile) come from one exact quantile
    computation; the bin is a native array expression.
    """
    probs = [0.0] + [i / q for i in range(1, q)]
    stats = quantiles_row(df, col, probs, method, name="__qs")
    out_df = attach(df, stats)
    v = F.col(col)
    low = F.col("__qs")[0]
    edges = F.filter(F.array_distinct(F.slice(F.col("__qs"), 2, q - 1)), lambda e: e > low)
    bin_ = F.size(F.filter(edges, lambda e: e < v))
    return out_df.select(*df.columns, F.when(v.isNotNull(), bin_).alias(out))


# --- T3 ---------------------------------------------------------------------
def _order_pair(key: str, seed: int) -> Column:
    """What rows are ordered by, nulls first: H of the key's text and the key itself."""
    h = F.coalesce(key_hash(key, seed), F.lit(-1)).alias("h")
    return F.struct(h, F.col(key).alias("k"))


def last_of_quotas(df: DataFrame, group: str, quotas: DataFrame, seed: int = 42, key: str = "id",
                   bucket_bits: int = 16) -> DataFrame:
    """(s, cut, last): the last pair (H(key), key) of the first ``quota`` rows of group ``s``,
    for each row (s, cut, quota) of ``quotas``; a quota of no row has none.

    Counts per (group, hash bucket) say in which bucket a quota ends; only the
    pairs of such buckets - one in 2**bucket_bits of the group - are ranked.
    """
    shift = HASH_BITS - bucket_bits
    hashed = df.select(F.col(group).alias("s"), _order_pair(key, seed).alias("last"))
    hashed = hashed.withColumn("bucket", F.shiftright("last.h", shift))
    counts = (hashed.groupBy("s", "bucket").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("upto", F.sum("n").over(Window.partitionBy("s").orderBy("bucket"))))
    wanted = quotas.select(F.col("s").alias("q_s"), "cut", "quota")
    ends = (counts.join(broadcast_if_small(wanted, 1 << 20), F.col("s").eqNullSafe(F.col("q_s")))
            .where((F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("n") < F.col("quota")))
            .select(F.col("s").alias("end_s"), F.col("bucket").alias("end_bucket"), "cut",
                    (F.col("quota") - F.col("upto") + F.col("n")).alias("rest")))
    ends = cut_lineage(ends)
    buckets = broadcast_if_small(ends.select("end_s", "end_bucket").distinct(), 1 << 20)
    place = F.row_number().over(Window.partitionBy("s", "bucket").orderBy("last.h", F.col("last.k").asc_nulls_first()))
    ranked = hashed.join(buckets, F.col("s").eqNullSafe(F.col("end_s")) & (F.col("bucket") == F.col("end_bucket"))).select(
        "s", "bucket", "last", place.alias("rank"))
    found = ranked.join(broadcast_if_small(ends, 1 << 20), F.col("s").eqNullSafe(F.col("end_s"))
                        & (F.col("bucket") == F.col("end_bucket")) & (F.col("rank") == F.col("rest")))
    return found.select("s", "cut", "last")


def stratified_quotas(counts: DataFrame, fraction: float) -> DataFrame:
    """(s, n, quota) of counts (s, n): the rows of each stratum to hold out.

    ``ceil(fraction * total)`` rows are held out in all.  The others are shared
    out by largest remainders: every stratum has the whole part of its exact
    share, and what is left goes one by one to the largest remainders (ties: the
    smaller stratum, null first).  All shares are whole numbers, so no rounding
    of floats can move a row.  One row per stratum is ranked.
    """
    whole = Window.partitionBy()
    total, kept = F.col("total"), F.col("kept")
    shares = (counts.withColumn("total", F.sum("n").over(whole))
              .withColumn("kept", total - F.least(total, F.ceil(F.lit(float(fraction)) * total)))
              .withColumn("product", F.col("n").cast("decimal(19,0)") * kept.cast("decimal(18,0)"))
              .withColumn("base", F.expr("cast(product div total as bigint)"))
              .withColumn("remainder", F.col("product") - F.col("base").cast("decimal(19,0)") * total.cast("decimal(18,0)")))
    spare = kept - F.sum("base").over(whole)
    place = F.row_number().over(Window.orderBy(F.col("remainder").desc(), F.col("s").asc_nulls_first()))
    return shares.select("s", "n", (F.col("n") - F.col("base") - F.when(place <= spare, 1).otherwise(0)).alias("quota"))


def stratified_holdout(df: DataFrame, stratum: str, fraction: float, seed: int = 42,
                       key: str = "id", flag_col: str = "is_test", bucket_bits: int = 16) -> DataFrame:
    """The rows of each stratum with the smallest (H(key), key) are held out, as many
    as its quota (``stratified_quotas``: ``ceil(fraction * n)`` rows in all).

    Every row is compared with the last pair that its stratum holds out: no full row is sorted or moved.
    """
    counts = df.groupBy(F.col(stratum).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    quotas = cut_lineage(stratified_quotas(counts, fraction)).select("s", F.lit(0).alias("cut"), "quota")
    last = last_of_quotas(df, stratum, quotas, seed, key, bucket_bits).select(F.col("s").alias("__s"), F.col("last").alias("__last"))
    last = broadcast_if_small(cut_lineage(last), 1 << 20)
    out = df.join(last, F.col(stratum).eqNullSafe(F.col("__s")), "left")
    return out.select(*df.columns, F.coalesce(_order_pair(key, seed) <= F.col("__last"), F.lit(False)).alias(flag_col))
