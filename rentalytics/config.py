"""Run parameters and fixed values.

Everything in the "fixed values" block has to equal the reference's choices
for the cleaned tables and models to come out the same; the parameters in
``CleanParams`` are the knobs the reference hard-codes in its scripts.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical results)
# ---------------------------------------------------------------------------

# Raw listings table: 79 text columns, in table order.
RAW_LISTING_COLUMNS = (
    "id", "listing_url", "scrape_id", "last_scraped", "source", "name", "description",
    "neighborhood_overview", "picture_url", "host_id", "host_url", "host_name", "host_since",
    "host_location", "host_about", "host_response_time", "host_response_rate",
    "host_acceptance_rate", "host_is_superhost", "host_thumbnail_url", "host_picture_url",
    "host_neighbourhood", "host_listings_count", "host_total_listings_count",
    "host_verifications", "host_has_profile_pic", "host_identity_verified", "neighbourhood",
    "neighbourhood_cleansed", "neighbourhood_group_cleansed", "latitude", "longitude",
    "property_type", "room_type", "accommodates", "bathrooms", "bathrooms_text", "bedrooms",
    "beds", "amenities", "price", "minimum_nights", "maximum_nights", "minimum_minimum_nights",
    "maximum_minimum_nights", "minimum_maximum_nights", "maximum_maximum_nights",
    "minimum_nights_avg_ntm", "maximum_nights_avg_ntm", "calendar_updated", "has_availability",
    "availability_30", "availability_60", "availability_90", "availability_365",
    "calendar_last_scraped", "number_of_reviews", "number_of_reviews_ltm",
    "number_of_reviews_l30d", "availability_eoy", "number_of_reviews_ly",
    "estimated_occupancy_l365d", "estimated_revenue_l365d", "first_review", "last_review",
    "review_scores_rating", "review_scores_accuracy", "review_scores_cleanliness",
    "review_scores_checkin", "review_scores_communication", "review_scores_location",
    "review_scores_value", "license", "instant_bookable", "calculated_host_listings_count",
    "calculated_host_listings_count_entire_homes",
    "calculated_host_listings_count_private_rooms",
    "calculated_host_listings_count_shared_rooms", "reviews_per_month",
)

# Raw reviews table: 6 text columns, in table order.
RAW_REVIEW_COLUMNS = ("listing_id", "id", "date", "reviewer_id", "reviewer_name", "comments")

# Listing columns kept by the cleaning step, in output order.
LISTING_KEEP_COLUMNS = (
    "id", "neighbourhood_cleansed", "latitude", "longitude",
    "property_type", "room_type", "accommodates", "bedrooms",
    "beds", "bathrooms", "amenities", "price", "minimum_nights",
    "maximum_nights", "host_is_superhost", "review_scores_rating",
    "review_scores_accuracy", "review_scores_cleanliness",
    "review_scores_checkin", "review_scores_communication",
    "review_scores_location", "review_scores_value", "reviews_per_month",
)

# Listing columns parsed from text to numbers.
LISTING_NUMERIC_COLUMNS = (
    "latitude", "longitude", "accommodates", "bedrooms", "beds", "bathrooms",
    "minimum_nights", "maximum_nights",
    "review_scores_rating", "review_scores_accuracy", "review_scores_cleanliness",
    "review_scores_checkin", "review_scores_communication", "review_scores_location",
    "review_scores_value", "reviews_per_month",
)

# Of those, the ones stored as BIGINT in the clean table (the rest are DOUBLE).

# Columns whose nulls are filled with the column median after dropping null prices.
MEDIAN_FILL_COLUMNS = ("beds", "bathrooms", "bedrooms")

# The seven review score columns.
REVIEW_SCORE_COLUMNS = (
    "review_scores_rating", "review_scores_accuracy", "review_scores_cleanliness",
    "review_scores_checkin", "review_scores_communication", "review_scores_location",
    "review_scores_value",
)

# Review-related columns coerced to numbers when features are built.
REVIEW_FEATURE_COLUMNS = REVIEW_SCORE_COLUMNS + (
    "reviews_per_month", "n_reviews", "avg_comment_length", "days_since_last_review",
)

# Reviews summary columns (joined onto listings).
SUMMARY_COLUMNS = (
    "listing_id", "n_reviews", "first_review", "last_review",
    "avg_comment_length", "days_since_last_review",
)

# Text values read as "true" when flags are turned into 0/1.
TRUTHY_TEXT = ("true", "1", "t", "yes", "y")

# Earth radius used by the distance feature, and the default city centre.
EARTH_RADIUS_KM = 6371.0
CENTER_LAT = 48.8566
CENTER_LON = 2.3522

# Property-type words behind the special flags listed in the model metadata.
SPECIAL_PROPERTY_WORDS = ("boat", "hotel", "hostel", "serviced", "loft", "villa")

# Feature sets of the target-encoded model (evaluate) ...
TE_NUMERIC_FEATURES = (
    "accommodates", "bedrooms", "beds", "bathrooms", "avg_comment_length",
    "days_since_last_review", "amenities_count", "dist_to_center_km",
)
TE_CATEGORICAL_FEATURES = ("property_type", "room_type")
TE_CATEGORY_COLUMN = "neighbourhood_cleansed"
TE_OUTPUT_COLUMN = "neighbourhood_te"

# ... and of the searched model (train): every joined column but these is numeric.
MATRIX_CATEGORICAL_FEATURES = ("neighbourhood_cleansed", "property_type_slim", "room_type")
MATRIX_DROPPED_COLUMNS = ("price", "id", "first_review", "last_review", "property_type")

# Random-search space of the searched model.
SEARCH_SPACE = {
    "max_depth": (4, 6, 8, 10),
    "min_child_weight": (1, 3, 5, 7),
    "subsample": (0.6, 0.8, 1.0),
    "colsample_bytree": (0.6, 0.8, 1.0),
    "gamma": (0, 0.5, 1.0),
    "reg_alpha": (0, 0.001, 0.01, 0.1),
    "reg_lambda": (0.1, 1.0, 5.0, 10.0),
    "learning_rate": (0.03, 0.05, 0.08),
    "n_estimators": (400, 800, 1200),
    "objective": ("reg:squarederror", "reg:absoluteerror"),
}

# Settings of the target-encoded model's boosted trees.
TE_MODEL_SETTINGS = {
    "n_estimators": 2000, "learning_rate": 0.03, "max_depth": 6,
    "subsample": 0.8, "colsample_bytree": 0.8,
}


@dataclass(frozen=True)
class CleanParams:
    """Knobs of the cleaning, splitting and encoding steps."""

    price_min: float = 10.0
    price_max: float = 2000.0
    price_per_guest_max: float = 500.0
    max_minimum_nights: int | None = 27
    nights_sanity: bool = False
    top_amenities: int = 10
    rare_threshold: float = 0.01
    center_lat: float = CENTER_LAT
    center_lon: float = CENTER_LON
    seed: int = 42
    folds: int = 5
    test_fraction: float = 0.2
    validation_fraction: float = 0.1
    strata: int = 10
    tail_quantile: float = 0.9
