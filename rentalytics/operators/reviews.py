"""Review cleaning and the per-listing review summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RAW_REVIEW_COLUMNS
from ..functions import date_text, integral_text
from ..session import cut_lineage
from .broadcast import one_row


# --- P2 ---------------------------------------------------------------------
def select_review_columns(raw: DataFrame) -> DataFrame:
    return raw.select(*RAW_REVIEW_COLUMNS)


# --- P25, P26 ---------------------------------------------------------------
def parse_reviews(df: DataFrame) -> DataFrame:
    """Ids stay exact BIGINT (no float detour); dates -> TIMESTAMP_NTZ, bad -> NULL."""
    return df.select(
        integral_text("listing_id").alias("listing_id"),
        integral_text("id").alias("id"),
        date_text("date").alias("date"),
        integral_text("reviewer_id").alias("reviewer_id"),
        F.col("reviewer_name"),
        F.col("comments"),
    )


# --- P27, P28 ---------------------------------------------------------------
def drop_incomplete_reviews(df: DataFrame) -> DataFrame:
    return df.where(F.col("listing_id").isNotNull() & F.col("id").isNotNull()
                    & F.col("date").isNotNull())


def fill_review_defaults(df: DataFrame) -> DataFrame:
    return df.fillna({"reviewer_name": "Unknown", "comments": ""})


def clean_reviews(raw: DataFrame) -> DataFrame:
    """raw reviews -> clean reviews (6 columns)."""
    return fill_review_defaults(drop_incomplete_reviews(parse_reviews(select_review_columns(raw))))


# --- A2, A3 -----------------------------------------------------------------
def summarise_reviews(reviews: DataFrame) -> DataFrame:
    """Per listing: count, first/last date, mean comment length (code points).

    All four are algebraic, so each task pre-aggregates its rows before the
    shuffle: a listing with a third of all reviews is still one small row per
    task on the wire.
    """
    return reviews.groupBy("listing_id").agg(
        F.count("id").alias("n_reviews"),
        F.min("date").alias("first_review"),
        F.max("date").alias("last_review"),
        F.avg(F.length("comments")).alias("avg_comment_length"),
    )


def add_review_recency(summary: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """days_since_last_review = (latest review date overall - last_review) in whole days.

    The latest date overall is one global max over the clean reviews' date
    column (a 1-column scan, one value per task to merge); without
    ``reviews`` it is taken from the summary's last_review (same value).
    """
    source = reviews.select(F.col("date").alias("__d")) if reviews is not None \
        else summary.select(F.col("last_review").alias("__d"))
    latest = source.agg(F.max("__d").alias("__latest"))
    out = summary.crossJoin(one_row(latest))
    days = F.timestamp_diff("DAY", F.col("last_review"), F.col("__latest"))
    return out.select(*summary.columns, days.cast("bigint").alias("days_since_last_review"))


def reviews_summary(reviews: DataFrame) -> DataFrame:
    """clean reviews -> reviews_summary (6 columns)."""
    # The latest of all dates is the latest last_review: one scan of the reviews.
    return add_review_recency(cut_lineage(summarise_reviews(reviews)))
