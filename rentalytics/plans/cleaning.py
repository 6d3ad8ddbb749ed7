"""The cleaning and feature plans (``make clean`` + ``make cache`` flows).

raw listings --clean--> listings_features ─┐
raw reviews  --clean--> reviews --summary--> reviews_summary ─┴─ LEFT JOIN --> build_features
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..config import CleanParams
from ..session import cut_lineage
from ..operators.features import build_features, join_reviews, standardise_nulls
from ..operators.listings import clean_listings
from ..operators.reviews import clean_reviews, reviews_summary


@dataclass
class CleanTables:
    listings: DataFrame
    reviews: DataFrame
    summary: DataFrame


def clean_tables(raw_listings: DataFrame, raw_reviews: DataFrame,
                 params: CleanParams = CleanParams(), **listing_options) -> CleanTables:
    reviews = clean_reviews(raw_reviews)
    return CleanTables(
        listings=clean_listings(raw_listings, params, **listing_options),
        reviews=reviews,
        summary=reviews_summary(reviews),
    )


def feature_table(listings: DataFrame, summary: DataFrame,
                  params: CleanParams = CleanParams(), keep_listing_id: bool = True,
                  checkpoint_joined: bool = True) -> DataFrame:
    """J1 + build_features + NaN standardisation: the modelling dataset.

    The review fills need a global median and max over the joined rows, i.e. a
    second pass over them; ``checkpoint_joined`` writes the join result once
    to the shared folder so that pass does not redo cleaning, aggregation and
    join.
    """
    joined = join_reviews(listings, summary, keep_listing_id=keep_listing_id)
    if checkpoint_joined:
        joined = cut_lineage(joined)
    return standardise_nulls(build_features(joined, params))


def features_from_raw(raw_listings: DataFrame, raw_reviews: DataFrame,
                      params: CleanParams = CleanParams(), **listing_options) -> DataFrame:
    t = clean_tables(raw_listings, raw_reviews, params, **listing_options)
    return feature_table(t.listings, t.summary, params)


# Reviews in one written file, where it is read back: about a gigabyte of text.
REVIEWS_PER_FILE = 500_000
# The clean step's tables and the keys that they are bucketed on.
TABLE_KEYS = {"listings_features": "id", "reviews": "listing_id", "reviews_summary": "listing_id"}


def table_paths(base: str) -> dict[str, str]:
    """Where the clean step's tables are under ``base`` (a shared folder or a catalog database name)."""
    sep = "/" if "/" in base or base.startswith("file:") else "."
    return {name: f"{base}{sep}{name}" for name in TABLE_KEYS}


def _write_clean_table(name: str, df: DataFrame, paths: dict[str, str], buckets: int | None,
                       rows_per_file: int | None = None) -> None:
    from ..sources import io

    if buckets:
        io.write_table(df, paths[name], bucket_by=(buckets, TABLE_KEYS[name]))
    else:
        io.write_table(df, paths[name], rows_per_file=rows_per_file)


def write_clean_tables(tables: CleanTables, base: str, buckets: int | None = None) -> dict[str, str]:
    """The clean step's sinks: three overwritten tables under ``base`` (a
    shared folder or a catalog database name).

    With ``buckets`` (catalog only) the listings are bucketed on ``id`` and
    reviews and summary on ``listing_id`` with the same count, so rebuilding
    the feature table joins them without shuffling either side.
    """
    paths = table_paths(base)
    frames = {"listings_features": tables.listings, "reviews": tables.reviews, "reviews_summary": tables.summary}
    for name, df in frames.items():
        _write_clean_table(name, df, paths, buckets)
    return paths


def write_clean_step(raw_listings: DataFrame, raw_reviews: DataFrame, base: str, params: CleanParams = CleanParams(),
                     buckets: int | None = None, **listing_options) -> dict[str, str]:
    """The whole clean step, raw tables -> the three tables of ``write_clean_tables``.

    The raw reviews are read and parsed once, for the written reviews; the
    summary is made of those, so it scans typed columns (and, with
    ``buckets``, shuffles nothing) instead of the raw texts a second time.
    """
    from ..sources import io

    paths = table_paths(base)
    _write_clean_table("listings_features", clean_listings(raw_listings, params, **listing_options), paths, buckets)
    _write_clean_table("reviews", clean_reviews(raw_reviews), paths, buckets, REVIEWS_PER_FILE)
    reviews = io.read_table(raw_reviews.sparkSession, paths["reviews"])
    _write_clean_table("reviews_summary", reviews_summary(reviews), paths, buckets)
    return paths


def audit_clean_tables(spark, paths: dict[str, str]):
    """``verify_clean``: table, column count, rows, min/max price of the written tables."""
    from ..operators.profile import clean_audit
    from ..sources import io

    return clean_audit({name: io.read_table(spark, p) for name, p in paths.items()})
