"""Target encoding and categorical bucketing.

Out-of-fold target encoding is done in one pass for any number of folds:
per (category, fold) sums and counts, per-category totals from those, and
``(total - own fold) / (n - own fold n)`` joined back on (category, fold).
No per-fold loop, no per-fold job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .broadcast import broadcast_if_small
from .stats import attach

LOOKUP_ROWS = 1_000_000


def _lookup_join(df: DataFrame, lookup: DataFrame, keys: list[str]) -> DataFrame:
    """LEFT join on ``keys`` (null-safe); the lookup is broadcast when small."""
    renamed = lookup
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__k_{k}")
    renamed = broadcast_if_small(renamed, LOOKUP_ROWS)
    cond = None
    for k in keys:
        c = df[k].eqNullSafe(renamed[f"__k_{k}"])
        cond = c if cond is None else cond & c
    return df.join(renamed, cond, "left").drop(*[f"__k_{k}" for k in keys])


# --- A4, A5 -----------------------------------------------------------------
def category_means(df: DataFrame, cat: str, target: str) -> DataFrame:
    """(cat, mean target) over non-null categories."""
    return (df.where(F.col(cat).isNotNull()).groupBy(cat)
            .agg(F.avg(target).alias("te"), F.count(target).alias("n")))


def global_mean(df: DataFrame, target: str) -> DataFrame:
    return df.agg(F.avg(target).alias("global_mean"))


# --- T4 ---------------------------------------------------------------------
def oof_target_encoding(df: DataFrame, cat: str, target: str, fold_col: str = "fold",
                        out: str = "te") -> DataFrame:
    """Mean target of the row's category over the OTHER folds.

    Category NULL, or seen only in the row's own fold -> global mean over all
    rows.  A missing category column gives 0.0, like the reference.
    """
    if cat not in df.columns:
        return df.withColumn(out, F.lit(0.0))
    per_fold = df.groupBy(cat, fold_col).agg(F.sum(target).alias("__s"), F.count(target).alias("__n"))
    whole = Window.partitionBy(cat)
    enc = per_fold.select(
        cat, fold_col,
        ((F.sum("__s").over(whole) - F.col("__s"))
         / F.nullif(F.sum("__n").over(whole) - F.col("__n"), F.lit(0))).alias("__te"))
    enc = enc.where(F.col(cat).isNotNull())
    joined = attach(_lookup_join(df, enc, [cat, fold_col]), global_mean(df, target))
    return joined.select(*df.columns, F.coalesce(F.col("__te"), F.col("global_mean")).alias(out))


# --- T5, J3 -----------------------------------------------------------------
def fit_target_encoding(df: DataFrame, cat: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Full-data mapping (cat, te) and the 1-row global mean."""
    return category_means(df, cat, target).select(cat, "te"), global_mean(df, target)


def apply_target_encoding(df: DataFrame, cat: str, mapping: DataFrame, mean: DataFrame,
                          out: str = "te") -> DataFrame:
    """Lookup with default: unseen or NULL category -> global mean."""
    m = mapping.select(F.col(mapping.columns[0]).alias(cat), F.col("te").alias("__te"))
    joined = attach(_lookup_join(df, m, [cat]), mean.select(F.col("global_mean").alias("__gm")))
    return joined.select(*[c for c in df.columns if c != out],
                         F.coalesce(F.col("__te"), F.col("__gm")).alias(out))


# --- T8 ----------------------------------------------------------------
def frequent_categories(df: DataFrame, cat: str, min_frequency: float) -> DataFrame:
    """(cat, n, frequent): frequent when n >= min_frequency * rows."""
    counts = df.groupBy(cat).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__total"))
    return (attach(counts.where(F.col(cat).isNotNull()), total)
            .select(cat, "n", (F.col("n") >= F.lit(float(min_frequency)) * F.col("__total")).alias("frequent")))
