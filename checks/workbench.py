"""Per-session memo of the bound tables and their cleaned forms.

The registered queries share intermediates (clean listings, summary,
features).  Built once per (session, data folder) and reused, the way a
user would keep written tables around between queries.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from rentalytics.config import CleanParams
from rentalytics.operators import listings as L
from rentalytics.operators import reviews as R
from rentalytics.operators.folds import quantile_bins, stratified_holdout
from rentalytics.plans.cleaning import feature_table
from rentalytics.session import cut_lineage
from rentalytics.sources import fixtures

PARAMS = CleanParams()
_CACHE: dict[tuple[str, str], "Workbench"] = {}


class Workbench:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.params = PARAMS

    @cached_property
    def raw_listings(self) -> DataFrame:
        return fixtures.raw_listings(self.spark, self.sf_dir)

    @cached_property
    def raw_reviews(self) -> DataFrame:
        return fixtures.raw_reviews(self.spark, self.sf_dir)

    @cached_property
    def prepared(self) -> DataFrame:
        return cut_lineage(L.prepare_listings(self.raw_listings))

    @cached_property
    def amenity_names(self) -> list[str]:
        return L.top_amenity_names(self.prepared, self.params.top_amenities)

    @cached_property
    def filled(self) -> DataFrame:
        return L.superhost_flag(L.fill_room_medians(self.prepared))

    @cached_property
    def with_amenities(self) -> DataFrame:
        return L.add_amenity_features(self.filled, self.amenity_names)

    @cached_property
    def filtered(self) -> DataFrame:
        return L.short_stay_filter(L.outlier_filter(self.with_amenities, self.params),
                                   self.params.max_minimum_nights)

    @cached_property
    def property_map(self) -> DataFrame:
        return cut_lineage(L.property_type_map(self.filtered, self.params.rare_threshold))

    @cached_property
    def listings(self) -> DataFrame:
        return cut_lineage(L.add_property_type_slim(self.filtered, self.property_map))

    @cached_property
    def reviews(self) -> DataFrame:
        return R.clean_reviews(self.raw_reviews)

    @cached_property
    def summary(self) -> DataFrame:
        return cut_lineage(R.reviews_summary(self.reviews))

    @cached_property
    def features(self) -> DataFrame:
        return cut_lineage(feature_table(self.listings, self.summary, self.params))

    @cached_property
    def split(self) -> DataFrame:
        strata = quantile_bins(self.features, "price", 10)
        return cut_lineage(stratified_holdout(strata, "stratum", 0.2, seed=42))


def bench(spark: SparkSession, sf_dir: str) -> Workbench:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CACHE:
        _CACHE[key] = Workbench(spark, sf_dir)
    return _CACHE[key]
