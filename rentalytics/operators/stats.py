"""Global statistics attached to every row without per-column jobs.

Each helper runs ONE aggregate over the frame (partial aggregation on every
partition, a single tiny merge) and attaches the 1-row result with a
broadcast cross join, so a fill needs no collect to the driver.

Quantile methods: ``select`` (exact distributed selection, bounded memory
per task, a few passes; the default for generic quantile operators),
``percentile`` (exact in one aggregate, memory bounded by the number of
distinct values: used for small domains such as beds, baths and ratings)
and ``approx`` (``percentile_approx``).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .broadcast import one_row

APPROX_ACCURACY = 100_000


def median_col(c: str, approx: bool = False) -> Column:
    if approx:
        return F.percentile_approx(F.col(c), 0.5, APPROX_ACCURACY).cast("double")
    return F.median(F.col(c)).cast("double")


def quantile_col(c: str, q, approx: bool = False) -> Column:
    if approx:
        return F.percentile_approx(F.col(c), q, APPROX_ACCURACY)
    return F.percentile(F.col(c), q)


def quantiles_row(df: DataFrame, col: str, probs: list[float], method: str = "select",
                  name: str = "q") -> DataFrame:
    """1-row frame whose ``name`` column is the array of ``probs`` quantiles.

    ``select`` (default): exact, bounded memory per task (see ``quantiles``);
    ``percentile``: exact in one aggregate, memory bounded by distinct values;
    ``approx``: ``percentile_approx``.
    """
    if method == "select":
        from .quantiles import exact_quantiles

        values = exact_quantiles(df, col, list(probs))
        return df.sparkSession.range(1).select(
            F.array(*[F.lit(v).cast("double") for v in values]).alias(name))
    return df.agg(quantile_col(col, list(probs), approx=(method == "approx")).alias(name))


def stats_row(df: DataFrame, exprs: Mapping[str, Column]) -> DataFrame:
    """One aggregate -> a 1-row frame with one column per named expression."""
    return df.agg(*[e.alias(name) for name, e in exprs.items()])


def attach(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Cross join a 1-row stats frame onto every row (broadcast, no shuffle)."""
    return df.crossJoin(one_row(stats))


def fill_from_stats(df: DataFrame, exprs: Mapping[str, Column], prefix: str = "__fill_") -> DataFrame:
    """``coalesce(c, stat(c))`` for each ``c`` in ``exprs``, with one aggregate.

    ``exprs`` maps column name -> aggregate expression computed over ``df``.
    """
    stats = stats_row(df, {prefix + c: e for c, e in exprs.items()})
    out = attach(df, stats)
    out = out.select(*[
        (F.coalesce(F.col(c), F.col(prefix + c)).alias(c) if c in exprs else F.col(c))
        for c in df.columns
    ])
    return out


def median_stats(df: DataFrame, cols: Iterable[str], method: str = "percentile",
                 prefix: str = "__fill_") -> DataFrame:
    """1-row frame of column medians over ``df``.

    ``percentile``: one aggregate, memory bounded by distinct values (small
    domains); ``select``: exact distributed selection with bounded memory
    (continuous columns, see ``quantiles``); ``approx``: ``percentile_approx``.
    """
    cols = list(cols)
    if method == "select":
        from .quantiles import exact_median_row

        return exact_median_row(df, cols, prefix)
    return stats_row(df, {prefix + c: median_col(c, approx=(method == "approx")) for c in cols})


def fill_with(df: DataFrame, stats: DataFrame, cols: Iterable[str], prefix: str = "__fill_") -> DataFrame:
    """``coalesce(c, stats[prefix + c])`` with a 1-row stats frame fitted elsewhere
    (e.g. on the training split and applied to the test split)."""
    cols = set(cols)
    out = attach(df, stats)
    return out.select(*[
        F.coalesce(F.col(c), F.col(prefix + c).cast(df.schema[c].dataType)).alias(c) if c in cols else F.col(c)
        for c in df.columns])


def median_fill(df: DataFrame, cols: Iterable[str], approx: bool = False, method: str | None = None) -> DataFrame:
    """Fill nulls with each column's median over ``df``."""
    cols = list(cols)
    return fill_with(df, median_stats(df, cols, method or ("approx" if approx else "percentile")), cols)
