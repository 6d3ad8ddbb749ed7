"""Listings x review summary join and the model features built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

from ..config import MATRIX_DROPPED_COLUMNS, REVIEW_FEATURE_COLUMNS, SPECIAL_PROPERTY_WORDS, CleanParams
from ..functions import haversine_km, nan_to_null, numeric_text, truthy_int
from .stats import attach, median_stats, stats_row

SUMMARY_FEATURES = ("n_reviews", "first_review", "last_review",
                    "avg_comment_length", "days_since_last_review")


# --- J1, J2 -----------------------------------------------------------------
def join_reviews(listings: DataFrame, summary: DataFrame, keep_listing_id: bool = True) -> DataFrame:
    """LEFT JOIN on id = listing_id.

    The summary is unique per listing (no fan-out) and comes out of its
    group-by already hash-partitioned on listing_id, so only the listings side
    is shuffled.  Orphan reviews drop out.  ``keep_listing_id=False`` gives
    the 5-column form.
    """
    right = summary.select("listing_id", *SUMMARY_FEATURES)
    joined = listings.join(right, listings["id"] == right["listing_id"], "left")
    right_cols = (["listing_id"] if keep_listing_id else []) + list(SUMMARY_FEATURES)
    return joined.select(*[listings[c] for c in listings.columns], *[right[c] for c in right_cols])


# --- P16, P17 ---------------------------------------------------------------
def amenity_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("amenity_")]


def _flag_int(df: DataFrame, c: str) -> Column:
    """``truthy_int``; a boolean needs no look at its text."""
    if isinstance(df.schema[c].dataType, BooleanType):
        return F.coalesce(F.col(c).cast("int"), F.lit(0))
    return truthy_int(c)


def add_amenity_ints(df: DataFrame) -> DataFrame:
    """Flags -> 0/1 by text truthiness; a null amenities_count -> sum of flags."""
    flags = amenity_columns(df)
    out = df.select(*[_flag_int(df, c).alias(c) if c in flags else F.col(c) for c in df.columns])
    flag_sum = sum((F.col(c) for c in flags), F.lit(0))
    if "amenities_count" in out.columns:
        return out.withColumn("amenities_count",
                              F.coalesce(F.col("amenities_count"), flag_sum.cast("bigint")))
    return out.withColumn("amenities_count", flag_sum.cast("bigint"))


# --- P20, F2, F3, F4 --------------------------------------------------------
def add_review_features(df: DataFrame, median_method: str = "select") -> DataFrame:
    """Coerce review columns, then fill: rating -> median, per-month and comment
    length -> 0, recency -> its max.  The max is one aggregate; the median is
    exact with bounded memory (``median_method`` as in ``stats``)."""
    present = [c for c in REVIEW_FEATURE_COLUMNS if c in df.columns]
    coerced = df.select(*[
        numeric_text(c).alias(c) if c in present and isinstance(df.schema[c].dataType, StringType)
        else F.col(c) for c in df.columns])
    fills = []
    if "review_scores_rating" in present:
        coerced = attach(coerced, median_stats(coerced, ["review_scores_rating"], median_method))
        fills.append("review_scores_rating")
    if "days_since_last_review" in present:
        coerced = attach(coerced, stats_row(coerced, {"__fill_days_since_last_review":
                                                      F.max("days_since_last_review")}))
        fills.append("days_since_last_review")
    out = []
    for c in df.columns:
        col = F.col(c)
        if c in fills:
            col = F.coalesce(col, F.col("__fill_" + c).cast(coerced.schema[c].dataType))
        elif c in ("reviews_per_month", "avg_comment_length"):
            col = F.coalesce(col, F.lit(0).cast(coerced.schema[c].dataType))
        out.append(col.alias(c))
    return coerced.select(*out)


# --- P18, P19 ---------------------------------------------------------------
def add_distance_to_center(df: DataFrame, lat: float, lon: float) -> DataFrame:
    """dist_to_center_km (NULL when a coordinate is NULL or absent)."""
    if "latitude" in df.columns and "longitude" in df.columns:
        dist = haversine_km(F.col("longitude"), F.col("latitude"), lon, lat)
    else:
        dist = F.lit(None).cast(DoubleType())
    return df.withColumn("dist_to_center_km", dist)


# --- P21, P22 ---------------------------------------------------------------
def add_price_per_person(df: DataFrame) -> DataFrame:
    guests = F.when(F.col("accommodates") == 0, F.lit(1)).otherwise(F.col("accommodates"))
    return df.withColumn("price_per_person", F.col("price") / guests)


def add_superhost_int(df: DataFrame) -> DataFrame:
    return df.withColumn("host_is_superhost", _flag_int(df, "host_is_superhost"))


def build_features(df: DataFrame, params: CleanParams = CleanParams(), median_method: str = "select") -> DataFrame:
    """Amenities -> review fills -> distance -> price per person -> superhost."""
    out = add_amenity_ints(df)
    out = add_review_features(out, median_method=median_method)
    out = add_distance_to_center(out, params.center_lat, params.center_lon)
    if "price" in out.columns and "accommodates" in out.columns:
        out = add_price_per_person(out)
    if "host_is_superhost" in out.columns:
        out = add_superhost_int(out)
    return out


# --- P23 --------------------------------------------------------------------
def standardise_nulls(df: DataFrame) -> DataFrame:
    """NaN -> NULL on every floating column."""
    return df.select(*[
        nan_to_null(c).alias(c) if t in ("double", "float") else F.col(c)
        for c, t in df.dtypes])


# --- P31 --------------------------------------------------------------------
def add_special_property_flags(df: DataFrame, column: str = "property_type") -> DataFrame:
    """pt_is_<word> = 1 when the property type text contains the word."""
    text = F.lower(F.coalesce(F.col(column), F.lit("")))
    return df.select("*", *[F.when(text.contains(w), 1).otherwise(0).alias(f"pt_is_{w}")
                            for w in SPECIAL_PROPERTY_WORDS])


# --- P29 --------------------------------------------------------------------
def model_matrix(df: DataFrame, dropped=MATRIX_DROPPED_COLUMNS) -> DataFrame:
    return df.drop(*dropped)
