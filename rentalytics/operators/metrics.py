"""Regression metrics as single aggregates (no collect of predictions)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import attach, quantiles_row


# --- M7 ---------------------------------------------------------------------
def error_metrics(df: DataFrame, label: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """MAE and RMSE (optionally per group, e.g. per fold) in one aggregate."""
    err = F.col(pred) - F.col(label)
    aggs = [F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
            F.count(F.lit(1)).alias("n")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


# --- M8 ---------------------------------------------------------------------
def tail_metrics(df: DataFrame, label: str, pred: str, q: float = 0.9, method: str = "select") -> DataFrame:
    """MAE overall, at label >= the label's q-quantile and below it."""
    cut = quantiles_row(df, label, [q], method).select(F.col("q")[0].alias("p_tail"))
    err = F.abs(F.col(pred) - F.col(label))
    hi = F.col(label) >= F.col("p_tail")
    return attach(df, cut).agg(
        F.first("p_tail").alias("p_tail"),
        F.avg(err).alias("mae_overall"),
        F.avg(F.when(hi, err)).alias("mae_tail"),
        F.avg(F.when(~hi, err)).alias("mae_body"),
    )


# --- M9 ---------------------------------------------------------------------
def median_baseline(train: DataFrame, test: DataFrame, label: str, method: str = "select") -> DataFrame:
    """MAE of predicting the training median for every test row."""
    med = quantiles_row(train, label, [0.5], method).select(F.col("q")[0].alias("train_median"))
    return attach(test, med).agg(
        F.first("train_median").alias("train_median"),
        F.avg(F.abs(F.col(label) - F.col("train_median"))).alias("baseline_mae"))


# --- A15 --------------------------------------------------------------------
def fold_summary(per_fold: DataFrame) -> DataFrame:
    """Mean and population std of per-fold MAE and RMSE."""
    return per_fold.agg(
        F.avg("mae").alias("mae_mean"), F.stddev_pop("mae").alias("mae_std"),
        F.avg("rmse").alias("rmse_mean"), F.stddev_pop("rmse").alias("rmse_std"),
        F.count(F.lit(1)).alias("folds"))
