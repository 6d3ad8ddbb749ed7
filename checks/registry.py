"""Registered queries: a Spark query and (where SQL can say it) its DuckDB oracle.

Every query reads the bound driver tables in full (no id subsets, no row
caps).  Floating values that depend on summation order or on libm are
rounded to 6 places on both sides; texts are returned as length + md5.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rentalytics.config import RAW_LISTING_COLUMNS, REVIEW_SCORE_COLUMNS
from rentalytics.functions import amenity_list, date_text, haversine_km, integral_text
from rentalytics.operators import features as FT
from rentalytics.operators import listings as L
from rentalytics.operators import reviews as R

from . import oracle as O
from .workbench import bench

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


BOUND = ["id", "neighbourhood_cleansed", "latitude", "longitude", "property_type", "room_type",
         "accommodates", "bedrooms", "beds", "bathrooms", "amenities", "price", "minimum_nights",
         "maximum_nights", "host_is_superhost", "reviews_per_month", *REVIEW_SCORE_COLUMNS]

# Columns of the clean listings table that do not depend on the data.
CLEAN_FIXED = ["id", "neighbourhood_cleansed", "latitude", "longitude", "property_type", "room_type",
               "accommodates", "bedrooms", "beds", "bathrooms", "price", "minimum_nights",
               "maximum_nights", "host_is_superhost", *REVIEW_SCORE_COLUMNS, "reviews_per_month",
               "amenities_count", "property_type_slim"]
SUMMARY_OUT = ["listing_id", "n_reviews", "first_review", "last_review", "avg_comment_length",
               "days_since_last_review"]
FEATURE_FIXED = [c for c in CLEAN_FIXED] + SUMMARY_OUT + ["dist_to_center_km", "price_per_person"]
ROUNDED = {"avg_comment_length", "dist_to_center_km", "price_per_person"}


def _fixed(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[r6(c).alias(c) if c in ROUNDED else F.col(c) for c in cols])


def _sql_fixed(cols: list[str], alias: str = "") -> str:
    p = f"{alias}." if alias else ""
    return ", ".join(f"round({p}{c}, 6) AS {c}" if c in ROUNDED else f"{p}{c}" for c in cols)


# --------------------------------------------------------------------------- quantile selection
SELECTION_PROBS = [0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]


@register("a13_quantile_selection",
          "SELECT CAST(unnest([" + ", ".join(str(p) for p in SELECTION_PROBS) + "]) AS DOUBLE) AS prob, "
          "round(unnest(quantile_cont(CAST(l_extendedprice AS DOUBLE), ["
          + ", ".join(str(p) for p in SELECTION_PROBS) + "])), 6) AS price FROM lineitem")
def a13_quantile_selection(spark, sf):
    """The histogram loop on every line item: brackets end at 1,000 rows."""
    from rentalytics.operators.quantiles import exact_quantiles

    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    got = exact_quantiles(lines, "l_extendedprice", SELECTION_PROBS, final_rows=1000)
    return spark.createDataFrame(list(zip(SELECTION_PROBS, got)), "prob double, price double").select("prob", r6("price").alias("price"))


# --------------------------------------------------------------------------- sources
_raw_sql_cols = ", ".join(
    (c if c in BOUND else f"CAST(NULL AS STRING) AS {c}") for c in RAW_LISTING_COLUMNS)


@register("s3_scan_raw_listings", O.with_blocks("raw_listings") + f"SELECT {_raw_sql_cols} FROM raw_listings")
def s3_scan_raw_listings(spark, sf):
    return bench(spark, sf).raw_listings


_review_text_sql = ("listing_id, id, date, reviewer_id, reviewer_name, "
                    "CAST(length(comments) AS BIGINT) AS comments_length, md5(comments) AS comments_md5")


def _review_text(df: DataFrame) -> DataFrame:
    return df.select("listing_id", "id", "date", "reviewer_id", "reviewer_name",
                     F.length("comments").cast("bigint").alias("comments_length"),
                     F.md5("comments").alias("comments_md5"))


@register("p2_select_reviews", O.with_blocks("raw_reviews") + f"SELECT {_review_text_sql} FROM raw_reviews")
def p2_select_reviews(spark, sf):
    return _review_text(R.select_review_columns(bench(spark, sf).raw_reviews))


# --------------------------------------------------------------------------- listings
@register("p1_select_listings",
          O.with_blocks("raw_listings") + "SELECT " + ", ".join(
              c for c in L.LISTING_KEEP_COLUMNS) + " FROM raw_listings")
def p1_select_listings(spark, sf):
    return L.select_listing_columns(bench(spark, sf).raw_listings)


_NUMERIC = ["latitude", "longitude", "accommodates", "bedrooms", "beds", "bathrooms", "minimum_nights",
            "maximum_nights", *REVIEW_SCORE_COLUMNS, "reviews_per_month"]


@register("p3_parse_numeric",
          O.with_blocks("parsed") + "SELECT id, " + ", ".join(_NUMERIC) + " FROM parsed")
def p3_parse_numeric(spark, sf):
    raw = L.select_listing_columns(bench(spark, sf).raw_listings)
    return L.parse_listings(raw).select("id", *_NUMERIC)


@register("p4_parse_id",
          O.with_blocks("raw_listings") + f"SELECT id AS id_text, {O.integral('id')} AS id FROM raw_listings")
def p4_parse_id(spark, sf):
    raw = L.select_listing_columns(bench(spark, sf).raw_listings)
    return raw.select(F.col("id").alias("id_text"), integral_text("id").alias("id"))


@register("p5_parse_price",
          O.with_blocks("raw_listings") +
          f"SELECT {O.integral('id')} AS id, price AS price_text, "
          "TRY_CAST(regexp_replace(price, '[^0-9.]', '', 'g') AS DOUBLE) AS price FROM raw_listings")
def p5_parse_price(spark, sf):
    raw = L.select_listing_columns(bench(spark, sf).raw_listings)
    parsed = L.parse_listings(raw.select("id", F.col("price"), F.col("price").alias("price_text")))
    return parsed.select("id", "price_text", "price")


@register("p6_superhost_flag",
          O.with_blocks("prepared") +
          "SELECT id, host_is_superhost AS superhost_text, coalesce(host_is_superhost = 't', false) AS host_is_superhost "
          "FROM prepared")
def p6_superhost_flag(spark, sf):
    b = bench(spark, sf)
    return L.superhost_flag(b.prepared.select("id", F.col("host_is_superhost").alias("superhost_text"),
                                              "host_is_superhost"))


@register("p7_drop_null_price", O.with_blocks("prepared") + "SELECT id, price FROM prepared")
def p7_drop_null_price(spark, sf):
    return bench(spark, sf).prepared.select("id", "price")


@register("f1_room_median_fill", O.with_blocks("filled") + "SELECT id, beds, bathrooms, bedrooms FROM filled")
def f1_room_median_fill(spark, sf):
    return bench(spark, sf).filled.select("id", "beds", "bathrooms", "bedrooms")


@register("a1_top_amenities", O.with_blocks("top_amenities") + "SELECT amenity, n, amenity_rank FROM top_amenities")
def a1_top_amenities(spark, sf):
    top = L.top_amenities(bench(spark, sf).prepared)
    rank = F.row_number().over(Window.orderBy(F.col("n").desc(), F.col("amenity")))
    return top.select("amenity", "n", rank.cast("bigint").alias("amenity_rank"))


@register("a1_amenities_by_first_place",
          O.with_blocks("prepared", "amenity_items") + """, places AS (
SELECT id, unnest(l) AS amenity, generate_subscripts(l, 1) AS pos FROM (
  SELECT id, CASE WHEN json_valid(t) AND t LIKE '[%' THEN from_json(t, '["VARCHAR"]') ELSE []::VARCHAR[] END AS l
  FROM (SELECT id, regexp_replace(amenities, ',\\s*\\]\\s*$', ']') AS t FROM prepared)))
SELECT amenity, n, row_number() OVER (ORDER BY n DESC, first) AS amenity_rank FROM (
  SELECT amenity, count(*) AS n, min((id, pos)) AS first FROM places GROUP BY amenity)""")
def a1_amenities_by_first_place(spark, sf):
    """All amenities in the order of the reference: by count, ties by first
    occurrence in the CSV export (rows by id, over files in that order), read in splits."""
    raw = bench(spark, sf).raw_listings.orderBy(integral_text("id"))
    path = IO.write_raw_csv(raw, scratch_path(spark, "ordered_listings_csv"))
    prepared = L.prepare_listings(IO.read_raw_listings_csv(spark, path, place=True))
    rank = F.row_number().over(Window.orderBy(F.col("n").desc(), F.col("first")))
    return L.amenity_frequencies(prepared).select("amenity", "n", rank.cast("bigint").alias("amenity_rank"))


@register("p12_amenities_count", O.with_blocks("filled") + "SELECT id, amenities_count FROM filled")
def p12_amenities_count(spark, sf):
    return bench(spark, sf).with_amenities.select("id", "amenities_count")


@register("p13_parse_amenities", O.with_blocks("amenity_items") + "SELECT id, amenity FROM amenity_items")
def p13_parse_amenities(spark, sf):
    return bench(spark, sf).prepared.select("id", F.explode(amenity_list("amenities")).alias("amenity"))


def _flags_long(df: DataFrame) -> DataFrame:
    return df.unpivot("id", FT.amenity_columns(df), "feature", "flag")


@register("p14_amenity_flags", O.with_blocks("flags_long") + "SELECT id, feature, flag FROM flags_long")
def p14_amenity_flags(spark, sf):
    return _flags_long(bench(spark, sf).listings)


@register("p8_outlier_filter", O.with_blocks("outliers") + "SELECT id, price, accommodates FROM outliers")
def p8_outlier_filter(spark, sf):
    b = bench(spark, sf)
    return L.outlier_filter(b.with_amenities, b.params).select("id", "price", "accommodates")


@register("p9_short_stay_filter", O.with_blocks("filtered") + "SELECT id, minimum_nights FROM filtered")
def p9_short_stay_filter(spark, sf):
    return bench(spark, sf).filtered.select("id", "minimum_nights")


@register("p10_nights_sanity",
          O.with_blocks("filtered") +
          "SELECT id, minimum_nights, maximum_nights FROM filtered "
          "WHERE minimum_nights > 0 AND maximum_nights >= minimum_nights")
def p10_nights_sanity(spark, sf):
    return L.nights_sanity_filter(bench(spark, sf).filtered).select("id", "minimum_nights", "maximum_nights")


@register("a12_property_type_map", O.with_blocks("ptmap") + "SELECT property_type, property_type_slim, n FROM ptmap")
def a12_property_type_map(spark, sf):
    return bench(spark, sf).property_map


@register("p11_property_type_slim",
          O.with_blocks("clean") + "SELECT id, property_type, property_type_slim FROM clean")
def p11_property_type_slim(spark, sf):
    return bench(spark, sf).listings.select("id", "property_type", "property_type_slim")


@register("p15_clean_listings",
          O.with_blocks("clean", "flags_long") +
          f"SELECT {_sql_fixed(CLEAN_FIXED, 'c')}, CAST(fl.k AS INTEGER) AS amenity_flag_count "
          "FROM clean c JOIN (SELECT id, count(*) FILTER (WHERE flag) AS k FROM flags_long GROUP BY id) fl "
          "ON fl.id = c.id")
def p15_clean_listings(spark, sf):
    df = bench(spark, sf).listings
    flags = FT.amenity_columns(df)
    k = sum((F.col(c).cast("int") for c in flags), F.lit(0))
    return _fixed(df, CLEAN_FIXED).join(df.select("id", k.alias("amenity_flag_count")), "id")


# --------------------------------------------------------------------------- reviews
@register("p26_parse_review_dates",
          O.with_blocks("raw_reviews") +
          "SELECT id AS id_text, date AS date_text, CAST(TRY_STRPTIME(date, '%Y-%m-%d') AS TIMESTAMP) AS date "
          "FROM raw_reviews")
def p26_parse_review_dates(spark, sf):
    raw = bench(spark, sf).raw_reviews
    return raw.select(F.col("id").alias("id_text"), F.col("date").alias("date_text"),
                      date_text("date").alias("date"))


@register("p27_clean_reviews", O.with_blocks("reviews_clean") + f"SELECT {_review_text_sql} FROM reviews_clean")
def p27_clean_reviews(spark, sf):
    return _review_text(bench(spark, sf).reviews)


@register("a2_reviews_summary",
          O.with_blocks("summary") +
          "SELECT listing_id, n_reviews, first_review, last_review, round(avg_comment_length, 6) AS avg_comment_length "
          "FROM summary")
def a2_reviews_summary(spark, sf):
    s = R.summarise_reviews(bench(spark, sf).reviews)
    return s.select("listing_id", "n_reviews", "first_review", "last_review",
                    r6("avg_comment_length").alias("avg_comment_length"))


@register("a3_days_since_last_review",
          O.with_blocks("summary") + "SELECT listing_id, days_since_last_review FROM summary")
def a3_days_since_last_review(spark, sf):
    return bench(spark, sf).summary.select("listing_id", "days_since_last_review")


# --------------------------------------------------------------------------- join + features
_JOIN_COLS = CLEAN_FIXED + SUMMARY_OUT


@register("j1_join_reviews_summary", O.with_blocks("joined") + f"SELECT {_sql_fixed(_JOIN_COLS)} FROM joined")
def j1_join_reviews_summary(spark, sf):
    b = bench(spark, sf)
    return _fixed(FT.join_reviews(b.listings, b.summary), _JOIN_COLS)


_J2_COLS = CLEAN_FIXED + SUMMARY_OUT[1:]


@register("j2_join_selected_columns", O.with_blocks("joined") + f"SELECT {_sql_fixed(_J2_COLS)} FROM joined")
def j2_join_selected_columns(spark, sf):
    b = bench(spark, sf)
    joined = FT.join_reviews(b.listings, b.summary, keep_listing_id=False)
    return _fixed(joined, [c for c in joined.columns if c in _J2_COLS])


@register("p23_feature_table_nan_free", O.with_blocks("features") + f"SELECT {_sql_fixed(FEATURE_FIXED)} FROM features")
def p23_feature_table_nan_free(spark, sf):
    return _fixed(bench(spark, sf).features, FEATURE_FIXED)


@register("p16_amenity_ints",
          O.with_blocks("flags_long") + "SELECT id, feature, CASE WHEN flag THEN 1 ELSE 0 END AS flag FROM flags_long")
def p16_amenity_ints(spark, sf):
    return _flags_long(bench(spark, sf).features)


@register("p17_amenities_count_fallback",
          O.with_blocks("clean", "flags_long") +
          "SELECT c.id, CASE WHEN c.id % 7 = 0 THEN fl.k ELSE c.amenities_count END AS amenities_count "
          "FROM clean c JOIN (SELECT id, count(*) FILTER (WHERE flag) AS k FROM flags_long GROUP BY id) fl ON fl.id = c.id")
def p17_amenities_count_fallback(spark, sf):
    """Every seventh count is missing, so that the fallback is used."""
    df = bench(spark, sf).listings
    missing = F.when(F.col("id") % 7 != 0, F.col("amenities_count"))
    return FT.add_amenity_ints(df.withColumn("amenities_count", missing)).select("id", "amenities_count")


@register("p23_nan_to_null",
          O.with_blocks("features") + "SELECT id, CASE WHEN id % 5 <> 0 THEN price END AS price FROM features")
def p23_nan_to_null(spark, sf):
    """Every fifth price is NaN before the rule."""
    price = F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("price"))
    return FT.standardise_nulls(bench(spark, sf).features.select("id", price.alias("price")))


@register("f2_rating_median_fill", O.with_blocks("features") + "SELECT id, review_scores_rating FROM features")
def f2_rating_median_fill(spark, sf):
    return bench(spark, sf).features.select("id", "review_scores_rating")


@register("f3_zero_fills",
          O.with_blocks("features") +
          "SELECT id, reviews_per_month, round(avg_comment_length, 6) AS avg_comment_length FROM features")
def f3_zero_fills(spark, sf):
    return bench(spark, sf).features.select("id", "reviews_per_month",
                                            r6("avg_comment_length").alias("avg_comment_length"))


@register("f4_recency_max_fill", O.with_blocks("features") + "SELECT id, days_since_last_review FROM features")
def f4_recency_max_fill(spark, sf):
    return bench(spark, sf).features.select("id", "days_since_last_review")


@register("f7_reviews_count_stays_null", O.with_blocks("features") + "SELECT id, n_reviews FROM features")
def f7_reviews_count_stays_null(spark, sf):
    return bench(spark, sf).features.select("id", "n_reviews")


@register("p19_dist_to_center",
          O.with_blocks("features") + "SELECT id, round(dist_to_center_km, 6) AS dist_to_center_km FROM features")
def p19_dist_to_center(spark, sf):
    return bench(spark, sf).features.select("id", r6("dist_to_center_km").alias("dist_to_center_km"))


@register("p18_haversine_listing_pairs",
          O.with_blocks("clean") +
          "SELECT a.id, b.id AS next_id, round(" + O.haversine("a.longitude", "a.latitude", "b.longitude", "b.latitude") +
          ", 6) AS km FROM clean a JOIN clean b ON b.id = a.id + 1")
def p18_haversine_listing_pairs(spark, sf):
    c = bench(spark, sf).listings.select("id", "latitude", "longitude")
    b = c.select(F.col("id").alias("next_id"), F.col("latitude").alias("lat2"), F.col("longitude").alias("lon2"))
    j = c.join(b, F.col("next_id") == F.col("id") + 1)
    return j.select("id", "next_id", r6(haversine_km("longitude", "latitude", "lon2", "lat2")).alias("km"))


@register("p21_price_per_person",
          O.with_blocks("features") + "SELECT id, round(price_per_person, 6) AS price_per_person FROM features")
def p21_price_per_person(spark, sf):
    return bench(spark, sf).features.select("id", r6("price_per_person").alias("price_per_person"))


@register("p22_superhost_int", O.with_blocks("features") + "SELECT id, host_is_superhost FROM features")
def p22_superhost_int(spark, sf):
    return bench(spark, sf).features.select("id", "host_is_superhost")


@register("p31_special_property_flags",
          O.with_blocks("features") + "SELECT id, property_type, " + ", ".join(
              f"CASE WHEN contains(lower(coalesce(property_type, '')), '{w}') THEN 1 ELSE 0 END AS pt_is_{w}"
              for w in ("boat", "hotel", "hostel", "serviced", "loft", "villa")) + " FROM features")
def p31_special_property_flags(spark, sf):
    f = bench(spark, sf).features.select("id", "property_type")
    return FT.add_special_property_flags(f)


@register("p24_log_transforms",
          O.with_blocks("features") +
          "SELECT id, round(ln(price), 6) AS log_price, round(ln(1 + price), 6) AS log1p_price, "
          "round(exp(ln(price)), 6) AS price_from_log, round(exp(ln(1 + price)) - 1, 6) AS price_from_log1p "
          "FROM features")
def p24_log_transforms(spark, sf):
    """The forward and inverse expressions the pipelines use."""
    from rentalytics.plans.modelling import TRANSFORMS

    f = bench(spark, sf).features.select("id", "price")
    cols = []
    for name in ("log", "log1p"):
        forward, inverse = TRANSFORMS[name]
        there = forward.format("price")
        cols += [r6(F.expr(there)).alias(f"{name}_price"), r6(F.expr(inverse.format(f"({there})"))).alias(f"price_from_{name}")]
    return f.select("id", *cols)


# --------------------------------------------------------------------------- folds, splits, bins
from rentalytics.functions import key_hash  # noqa: E402
from rentalytics.operators import encoding as EN  # noqa: E402
from rentalytics.operators import folds as FO  # noqa: E402
from rentalytics.operators import metrics as ME  # noqa: E402
from rentalytics.operators import profile as PR  # noqa: E402


def _folds(spark, sf) -> DataFrame:
    return FO.assign_folds(bench(spark, sf).features, k=5, seed=42)


def _split(spark, sf) -> DataFrame:
    return bench(spark, sf).split


@register("t1_kfold_assignment", O.with_blocks("folds") + "SELECT id, CAST(fold AS INTEGER) AS fold FROM folds")
def t1_kfold_assignment(spark, sf):
    return _folds(spark, sf).select("id", "fold")


@register("t1_balanced_folds",
          O.with_blocks("features") + f"""SELECT id, CAST(CASE WHEN rk < (n % 5) * (n // 5 + 1) THEN rk // (n // 5 + 1)
ELSE (n % 5) + (rk - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold
FROM (SELECT id, row_number() OVER (ORDER BY {O.key_hash('id')}, id) - 1 AS rk, count(*) OVER () AS n FROM features)""")
def t1_balanced_folds(spark, sf):
    return FO.balanced_folds(bench(spark, sf).features, k=5, seed=42).select("id", "fold")


@register("t2_random_holdout", O.with_blocks("holdout") + "SELECT id, is_holdout FROM holdout")
def t2_random_holdout(spark, sf):
    return FO.holdout_flag(bench(spark, sf).features, 0.1, seed=42).select("id", "is_holdout")


@register("a13_price_p90", O.with_blocks("features") + "SELECT round(quantile_cont(price, 0.9), 6) AS q FROM features")
def a13_price_p90(spark, sf):
    return FO.quantile(bench(spark, sf).features, "price", 0.9).select(r6("q").alias("q"))


@register("a14_price_deciles", O.with_blocks("strata") + "SELECT id, price, stratum FROM strata")
def a14_price_deciles(spark, sf):
    return FO.quantile_bins(bench(spark, sf).features, "price", 10).select("id", "price", "stratum")


@register("t3_stratified_split", O.with_blocks("split") + "SELECT id, stratum, is_test FROM split")
def t3_stratified_split(spark, sf):
    return _split(spark, sf).select("id", "stratum", "is_test")


@register("t4_oof_target_encoding",
          O.with_blocks("oof_te") +
          "SELECT id, CAST(fold AS INTEGER) AS fold, round(neighbourhood_te, 6) AS neighbourhood_te FROM oof_te")
def t4_oof_target_encoding(spark, sf):
    te = EN.oof_target_encoding(_folds(spark, sf), "neighbourhood_cleansed", "price", "fold", out="neighbourhood_te")
    return te.select("id", "fold", r6("neighbourhood_te").alias("neighbourhood_te"))


_FULL_TE_SQL = (O.with_blocks("features") +
                "SELECT f.id, round(coalesce(m.te, g.gm), 6) AS neighbourhood_te FROM features f "
                "LEFT JOIN (SELECT neighbourhood_cleansed, avg(price) AS te FROM features "
                "           WHERE neighbourhood_cleansed IS NOT NULL GROUP BY 1) m "
                "  ON m.neighbourhood_cleansed = f.neighbourhood_cleansed "
                "CROSS JOIN (SELECT avg(price) AS gm FROM features) g")


@register("t5_full_target_encoding", _FULL_TE_SQL)
def t5_full_target_encoding(spark, sf):
    f = bench(spark, sf).features
    mapping, mean = EN.fit_target_encoding(f, "neighbourhood_cleansed", "price")
    te = EN.apply_target_encoding(f, "neighbourhood_cleansed", mapping, mean, out="neighbourhood_te")
    return te.select("id", r6("neighbourhood_te").alias("neighbourhood_te"))


@register("a4_category_mean",
          O.with_blocks("features") +
          "SELECT neighbourhood_cleansed, round(avg(price), 6) AS te, count(price) AS n FROM features "
          "WHERE neighbourhood_cleansed IS NOT NULL GROUP BY 1")
def a4_category_mean(spark, sf):
    m = EN.category_means(bench(spark, sf).features, "neighbourhood_cleansed", "price")
    return m.select("neighbourhood_cleansed", r6("te").alias("te"), "n")


@register("a5_global_mean", O.with_blocks("features") + "SELECT round(avg(price), 6) AS global_mean FROM features")
def a5_global_mean(spark, sf):
    return EN.global_mean(bench(spark, sf).features, "price").select(r6("global_mean").alias("global_mean"))


@register("t7_one_hot_alphabetical",
          O.with_blocks("holdout") +
          "SELECT h.id, h.property_type, CAST(s.slot AS INTEGER) AS hot_index FROM holdout h LEFT JOIN ("
          "  SELECT property_type, row_number() OVER (ORDER BY property_type) - 1 AS slot FROM ("
          "    SELECT DISTINCT property_type FROM holdout WHERE NOT is_holdout AND property_type IS NOT NULL)) s "
          "ON s.property_type = h.property_type")
def t7_one_hot_alphabetical(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    from rentalytics.plans.modelling import one_hot_stages

    df = FO.holdout_flag(bench(spark, sf).features, 0.1, seed=42)
    model = Pipeline(stages=one_hot_stages(["property_type"])).fit(df.where(~F.col("is_holdout")))
    pos = F.array_position(vector_to_array("property_type__ohe"), 1.0).cast("int") - 1
    return model.transform(df).select("id", "property_type", F.when(pos >= 0, pos).alias("hot_index"))


@register("t8_infrequent_bucket",
          O.with_blocks("train", "split") +
          "SELECT s.id, s.property_type, CASE WHEN fr.frequent AND s.property_type IS NOT NULL THEN s.property_type "
          "  WHEN hr.has_rare = 1 THEN 'infrequent' END AS property_type_bucket "
          "FROM split s LEFT JOIN (SELECT property_type, count(*) >= CAST(0.01 AS DOUBLE) * (SELECT count(*) FROM train) "
          "  AS frequent FROM train WHERE property_type IS NOT NULL GROUP BY 1) fr ON fr.property_type = s.property_type "
          "CROSS JOIN (SELECT max(CASE WHEN NOT frequent THEN 1 ELSE 0 END) AS has_rare FROM ("
          "  SELECT property_type, count(*) >= CAST(0.01 AS DOUBLE) * (SELECT count(*) FROM train) AS frequent "
          "  FROM train WHERE property_type IS NOT NULL GROUP BY 1)) hr")
def t8_infrequent_bucket(spark, sf):
    split = _split(spark, sf)
    from rentalytics.operators.ml_stages import InfrequentBucketer

    split = split.withColumn("property_type_bucket", F.col("property_type"))
    fitted = InfrequentBucketer(inputCols=["property_type_bucket"], minFrequency=0.01).fit(split.where(~F.col("is_test")))
    return fitted.transform(split).select("id", "property_type", "property_type_bucket")


_F5_COLS = ["latitude", "n_reviews", "dist_to_center_km"]


@register("f5_median_imputer_train_to_test",
          O.with_blocks("train", "test") +
          "SELECT t.id, " + ", ".join(f"round(coalesce(CAST(t.{c} AS DOUBLE), m.{c}), 6) AS {c}" for c in _F5_COLS) +
          " FROM test t CROSS JOIN (SELECT " + ", ".join(f"median({c}) AS {c}" for c in _F5_COLS) + " FROM train) m")
def f5_median_imputer_train_to_test(spark, sf):
    """Exact medians fitted on the training split (bounded-memory selection:
    the columns are continuous), applied to the test split."""
    from rentalytics.operators.ml_stages import MedianFiller

    split = _split(spark, sf).select("id", "is_test", *[F.col(c).cast("double").alias(c) for c in _F5_COLS])
    filler = MedianFiller(inputCols=_F5_COLS, outputCols=[f"{c}__imp" for c in _F5_COLS])
    filled = filler.fit(split.where(~F.col("is_test"))).transform(split.where(F.col("is_test")))
    return filled.select("id", *[r6(f"{c}__imp").alias(c) for c in _F5_COLS])


@register("f6_mode_imputer",
          O.with_blocks("train") +
          "SELECT 'property_type' AS column_name, (SELECT property_type FROM train WHERE property_type IS NOT NULL "
          "  GROUP BY 1 ORDER BY count(*) DESC, property_type LIMIT 1) AS mode_value "
          "UNION ALL SELECT 'room_type', (SELECT room_type FROM train WHERE room_type IS NOT NULL "
          "  GROUP BY 1 ORDER BY count(*) DESC, room_type LIMIT 1)")
def f6_mode_imputer(spark, sf):
    from rentalytics.operators.ml_stages import ModeFiller

    train = _split(spark, sf).where(~F.col("is_test"))
    fitted = ModeFiller(inputCols=["property_type", "room_type"]).fit(train)._labels()
    return spark.createDataFrame(list(fitted.items()), "column_name string, mode_value string")


# --------------------------------------------------------------------------- metrics
def _oof(spark, sf) -> DataFrame:
    return EN.oof_target_encoding(_folds(spark, sf), "neighbourhood_cleansed", "price", "fold",
                                  out="neighbourhood_te")


@register("m7_mae_rmse",
          O.with_blocks("oof_te") +
          "SELECT round(avg(abs(neighbourhood_te - price)), 6) AS mae, "
          "round(sqrt(avg((neighbourhood_te - price) * (neighbourhood_te - price))), 6) AS rmse, count(*) AS n "
          "FROM oof_te")
def m7_mae_rmse(spark, sf):
    m = ME.error_metrics(_oof(spark, sf), "price", "neighbourhood_te")
    return m.select(r6("mae").alias("mae"), r6("rmse").alias("rmse"), "n")


@register("a15_fold_summary",
          O.with_blocks("oof_te") +
          "SELECT round(avg(mae), 6) AS mae_mean, round(stddev_pop(mae), 6) AS mae_std, round(avg(rmse), 6) AS rmse_mean, "
          "round(stddev_pop(rmse), 6) AS rmse_std, count(*) AS folds FROM ("
          "  SELECT fold, avg(abs(neighbourhood_te - price)) AS mae, "
          "  sqrt(avg((neighbourhood_te - price) * (neighbourhood_te - price))) AS rmse FROM oof_te GROUP BY fold)")
def a15_fold_summary(spark, sf):
    per_fold = ME.error_metrics(_oof(spark, sf), "price", "neighbourhood_te", by=["fold"])
    s = ME.fold_summary(per_fold)
    return s.select(*[r6(c).alias(c) for c in ("mae_mean", "mae_std", "rmse_mean", "rmse_std")], "folds")


@register("m8_tail_metrics",
          O.with_blocks("oof_te", "test") +
          "SELECT round(max(p), 6) AS p_tail, round(avg(e), 6) AS mae_overall, "
          "round(avg(CASE WHEN price >= p THEN e END), 6) AS mae_tail, "
          "round(avg(CASE WHEN price < p THEN e END), 6) AS mae_body FROM ("
          "  SELECT t.price, abs(o.neighbourhood_te - t.price) AS e, q.p FROM test t JOIN oof_te o ON o.id = t.id "
          "  CROSS JOIN (SELECT quantile_cont(price, 0.9) AS p FROM test) q)")
def m8_tail_metrics(spark, sf):
    test = _split(spark, sf).where(F.col("is_test")).select("id")
    scored = _oof(spark, sf).join(test, "id")
    m = ME.tail_metrics(scored, "price", "neighbourhood_te", 0.9)
    return m.select(*[r6(c).alias(c) for c in ("p_tail", "mae_overall", "mae_tail", "mae_body")])


@register("m9_median_baseline",
          O.with_blocks("train", "test") +
          "SELECT round(m.med, 6) AS train_median, round(avg(abs(t.price - m.med)), 6) AS baseline_mae "
          "FROM test t CROSS JOIN (SELECT median(price) AS med FROM train) m GROUP BY m.med")
def m9_median_baseline(spark, sf):
    split = _split(spark, sf)
    m = ME.median_baseline(split.where(~F.col("is_test")), split.where(F.col("is_test")), "price")
    return m.select(r6("train_median").alias("train_median"), r6("baseline_mae").alias("baseline_mae"))


# --------------------------------------------------------------------------- audits, profiles
@register("a6_raw_row_counts",
          O.with_blocks("raw_listings", "raw_reviews") +
          "SELECT 'listings' AS table_name, count(*) AS n FROM raw_listings "
          "UNION ALL SELECT 'reviews', count(*) FROM raw_reviews")
def a6_raw_row_counts(spark, sf):
    b = bench(spark, sf)
    return PR.row_counts({"listings": b.raw_listings, "reviews": b.raw_reviews})


@register("a7_clean_audit",
          O.with_blocks("clean", "reviews_clean", "summary") +
          "SELECT 'listings_features' AS table_name, CAST(34 AS BIGINT) AS n_cols, count(*) AS n_rows, "
          "min(price) AS min_price, max(price) AS max_price FROM clean "
          "UNION ALL SELECT 'reviews', 6, count(*), NULL, NULL FROM reviews_clean "
          "UNION ALL SELECT 'reviews_summary', 6, count(*), NULL, NULL FROM summary")
def a7_clean_audit(spark, sf):
    b = bench(spark, sf)
    return PR.clean_audit({"listings_features": b.listings, "reviews": b.reviews, "reviews_summary": b.summary})


@register("a9_category_options",
          O.with_blocks("features") +
          "SELECT DISTINCT CAST(neighbourhood_cleansed AS STRING) AS option FROM features "
          "WHERE neighbourhood_cleansed IS NOT NULL")
def a9_category_options(spark, sf):
    return PR.category_options(bench(spark, sf).features, "neighbourhood_cleansed")


_BOUND_COLS = ["accommodates", "bedrooms", "beds", "bathrooms", "avg_comment_length", "days_since_last_review"]


@register("a10_numeric_bounds",
          O.with_blocks("features") + " UNION ALL ".join(
              f"SELECT '{c}' AS column_name, round(min(CAST({c} AS DOUBLE)), 6) AS min_value, "
              f"round(max(CAST({c} AS DOUBLE)), 6) AS max_value, round(median(CAST({c} AS DOUBLE)), 6) AS median_value "
              f"FROM features" for c in _BOUND_COLS))
def a10_numeric_bounds(spark, sf):
    b = PR.numeric_bounds(bench(spark, sf).features, _BOUND_COLS)
    return b.select("column_name", *[r6(c).alias(c) for c in ("min_value", "max_value", "median_value")])


@register("a11_kept_categories",
          O.with_blocks("ptmap") +
          "SELECT category, row_number() OVER (ORDER BY last, category) AS position FROM ("
          "  SELECT DISTINCT property_type_slim AS category, 0 AS last FROM ptmap WHERE property_type_slim <> 'Other' "
          "  UNION ALL SELECT 'Other', 1)")
def a11_kept_categories(spark, sf):
    k = PR.kept_categories(bench(spark, sf).property_map)
    return k.select("category", F.col("position").cast("bigint").alias("position"))


# --------------------------------------------------------------------------- sources and sinks
import json  # noqa: E402
import os  # noqa: E402
import uuid  # noqa: E402

from rentalytics.config import LISTING_KEEP_COLUMNS  # noqa: E402
from rentalytics.plans import modelling as MO  # noqa: E402
from rentalytics.session import cut_lineage, scratch_path  # noqa: E402
from rentalytics.sources import io as IO  # noqa: E402


@register("s1_csv_ingest_listings", O.with_blocks("raw_listings") + f"SELECT {_raw_sql_cols} FROM raw_listings")
def s1_csv_ingest_listings(spark, sf):
    """Export the raw listings as CSV (quoted, multi-line dialect; one file per
    writing task, as a single one has to pass whole through one task) and
    ingest them back by splits."""
    path = IO.write_raw_csv(bench(spark, sf).raw_listings, scratch_path(spark, "raw_listings_csv"))
    return IO.read_raw_listings_csv(spark, path)


@register("s4_overwrite_table_sink",
          O.with_blocks("clean", "flags_long") +
          f"SELECT {_sql_fixed(CLEAN_FIXED, 'c')} FROM clean c")
def s4_overwrite_table_sink(spark, sf):
    """Write the clean listings twice with overwrite (drop and recreate) and read back."""
    path = scratch_path(spark, "listings_features")
    df = bench(spark, sf).listings
    IO.write_table(df, path)
    IO.write_table(df, path)
    return _fixed(IO.read_table(spark, path), CLEAN_FIXED)


@register("s4_replace_survives_failure",
          O.with_blocks("clean") + f"SELECT {_sql_fixed(CLEAN_FIXED, 'c')}, true AS failed FROM clean c")
def s4_replace_survives_failure(spark, sf):
    """A replacement that fails on its last rows leaves the old table whole; one
    that reads the table itself replaces it."""
    path = scratch_path(spark, "replaced_listings")
    IO.write_table(bench(spark, sf).listings, path)
    old = IO.read_table(spark, path)
    broken = old.withColumn("price", F.when(F.col("id") == old.agg(F.max("id")).first()[0], F.raise_error(F.lit("midway"))).otherwise(F.col("price")))
    failed = False
    try:
        IO.write_table(broken, path)
    except Exception as e:
        failed = "midway" in str(e)
    IO.write_table(IO.read_table(spark, path), path)
    return _fixed(IO.read_table(spark, path), CLEAN_FIXED).withColumn("failed", F.lit(failed))


@register("s5_feature_cache", O.with_blocks("features") + f"SELECT {_sql_fixed(FEATURE_FIXED)} FROM features")
def s5_feature_cache(spark, sf):
    """Read-through cache: first call builds and writes, the second reads the cache."""
    path = scratch_path(spark, "feature_cache")
    b = bench(spark, sf)
    IO.cached_table(spark, path, lambda: b.features)
    cached = IO.cached_table(spark, path, lambda: (_ for _ in ()).throw(RuntimeError("cache missed")))
    return _fixed(cached, FEATURE_FIXED)


@register("s6_property_map_json_lookup",
          O.with_blocks("clean") + "SELECT id, property_type, property_type_slim FROM clean")
def s6_property_map_json_lookup(spark, sf):
    """Persist the A12 map as a JSON document, load it back and apply it (P11 via J3)."""
    b = bench(spark, sf)
    path = IO.write_property_map(b.property_map, scratch_path(spark, "property_type_map"))
    loaded = IO.read_property_map(spark, path)
    return L.add_property_type_slim(b.filtered, loaded).select("id", "property_type", "property_type_slim")


@register("s11_target_encoding_table", _FULL_TE_SQL)
def s11_target_encoding_table(spark, sf):
    """Persist (category, te) + global mean, reload, apply at scoring time (T6)."""
    f = bench(spark, sf).features
    mapping, mean = EN.fit_target_encoding(f, "neighbourhood_cleansed", "price")
    path = IO.write_target_encoding(mapping, mean, scratch_path(spark, "neighbourhood_te"))
    m2, g2 = IO.read_target_encoding(spark, path)
    te = EN.apply_target_encoding(f.select("id", "neighbourhood_cleansed"), "neighbourhood_cleansed", m2, g2,
                                  out="neighbourhood_te")
    return te.select("id", r6("neighbourhood_te").alias("neighbourhood_te"))


@register("p20_review_column_coercion",
          O.with_blocks("features") + "SELECT id, review_scores_rating, reviews_per_month, days_since_last_review "
          "FROM features")
def p20_review_column_coercion(spark, sf):
    """Review columns arriving as text are coerced before the fills."""
    b = bench(spark, sf)
    joined = FT.join_reviews(b.listings, b.summary)
    as_text = joined.select(*[F.col(c).cast("string").alias(c)
                              if c in ("review_scores_rating", "reviews_per_month", "days_since_last_review")
                              else F.col(c) for c in joined.columns])
    out = FT.add_review_features(as_text)
    return out.select("id", "review_scores_rating", "reviews_per_month",
                      F.col("days_since_last_review").cast("bigint").alias("days_since_last_review"))


_MATRIX_FIXED = [c for c in FEATURE_FIXED if c not in ("price", "id", "first_review", "last_review", "property_type")]


@register("p29_model_matrix", O.with_blocks("features") + f"SELECT {_sql_fixed(_MATRIX_FIXED)} FROM features")
def p29_model_matrix(spark, sf):
    m = FT.model_matrix(bench(spark, sf).features)
    return _fixed(m, [c for c in _MATRIX_FIXED if c in m.columns])


_ALIGN = [("neighbourhood_cleansed", "string"), ("accommodates", "double"), ("bedrooms", "double"),
          ("beds", "double"), ("bathrooms", "double"), ("avg_comment_length", "double"),
          ("days_since_last_review", "bigint"), ("neighbourhood_te", "double")]


@register("p30_align_features",
          O.with_blocks("features") +
          "SELECT neighbourhood_cleansed, accommodates, bedrooms, beds, bathrooms, "
          "round(avg_comment_length, 6) AS avg_comment_length, days_since_last_review, "
          "CAST(NULL AS DOUBLE) AS neighbourhood_te FROM features")
def p30_align_features(spark, sf):
    """A scoring frame with text numbers, extra columns and a missing one -> the model's columns."""
    f = bench(spark, sf).features
    raw = f.select("neighbourhood_cleansed", "property_type_slim", "room_type",
                   F.col("accommodates").cast("string").alias("accommodates"),
                   "bedrooms", "beds", "bathrooms", "avg_comment_length",
                   F.col("days_since_last_review").cast("string").alias("days_since_last_review"))
    out = MO.align_features(raw, _ALIGN)
    return out.withColumn("avg_comment_length", r6("avg_comment_length"))


@register("a8_catalog_listing",
          O.with_blocks("clean", "reviews_clean", "summary") +
          "SELECT 'listings_features' AS table_name, CAST(NULL AS VARCHAR) AS database, 'TEMPORARY' AS table_type, "
          "34 AS n_cols, count(*) AS n FROM clean "
          "UNION ALL SELECT 'reviews', NULL, 'TEMPORARY', 6, count(*) FROM reviews_clean "
          "UNION ALL SELECT 'reviews_summary', NULL, 'TEMPORARY', 6, count(*) FROM summary")
def a8_catalog_listing(spark, sf):
    """Register the clean tables as views and list them with their column counts."""
    b = bench(spark, sf)
    for name, df in {"listings_features": b.listings, "reviews": b.reviews, "reviews_summary": b.summary}.items():
        df.createOrReplaceTempView(name)
    counts = PR.row_counts({"listings_features": b.listings, "reviews": b.reviews, "reviews_summary": b.summary})
    listing = PR.catalog_listing(spark).where(F.col("table_name").isin(
        "listings_features", "reviews", "reviews_summary"))
    return listing.join(counts, "table_name")


# --------------------------------------------------------------------------- models (rows-only checks)
# One tree of depth one on a 0/1 feature predicts, per value, the mean on the
# scale it was fitted on: a model whose predictions SQL can state exactly.
STUMP = MO.BoostSettings(max_iter=1, max_depth=1, step_size=1.0)
STUMP_FEATURE = "host_is_superhost"
# A small boosted model where only its bookkeeping is compared.
SMALL_TREES = MO.BoostSettings(max_iter=10, max_depth=4, step_size=0.1)
# A search space of two settings, for the flow around the search.
SMALL_SEARCH = [{"n_estimators": 5, "max_depth": 2, "learning_rate": 0.3},
                {"n_estimators": 10, "max_depth": 3, "learning_rate": 0.1}]


def _stump_mean(rows: str, value: str) -> str:
    return f"(SELECT {STUMP_FEATURE} AS v, exp(avg(ln(1 + {value}))) - 1 AS p FROM {rows} GROUP BY 1)"


@register("m1_gbt_log_target_predictions",
          O.with_blocks("train", "test") +
          f"SELECT t.id, t.price, round(m.p, 4) AS prediction FROM test t JOIN {_stump_mean('train', 'price')} m "
          f"ON m.v = t.{STUMP_FEATURE}")
def m1_gbt_log_target_predictions(spark, sf):
    """M1-M3: preprocessing + GBT on log1p(price) + inverse transform, fitted on
    the training split, scored on the test split; the stump's predictions."""
    df = MO.with_label(_split(spark, sf), "price", "log1p")
    model = MO.build_pipeline([STUMP_FEATURE], [], STUMP, "log1p").fit(df.where(~F.col("is_test")))
    return model.transform(df.where(F.col("is_test"))).select(
        "id", "price", F.round(MO.PREDICTION, 4).alias("prediction"))


# Two regularised stumps on the flag: the second on what the first leaves over, both with L1 and L2 penalties.
REGULARISED_STUMPS = MO.BoostSettings(max_iter=2, max_depth=1, step_size=0.5, algorithm="regularised", reg_alpha=3.0,
                                      reg_lambda=20.0, min_child_weight=3.0)
_leaf_value = "-sign(sum(m - y)) * greatest(abs(sum(m - y)) - 3.0, 0) / (count(*) + 20.0) * 0.5"


@register("m1_regularised_stumps",
          O.with_blocks("train", "test") +
          f", s0 AS (SELECT {STUMP_FEATURE} AS v, ln(1 + price) AS y, (SELECT avg(ln(1 + price)) FROM train) AS m FROM train), "
          f"l1 AS (SELECT v, {_leaf_value} AS w FROM s0 GROUP BY v), "
          "s1 AS (SELECT s0.v, y, m + w AS m FROM s0 JOIN l1 ON l1.v = s0.v), "
          f"l2 AS (SELECT v, {_leaf_value} AS w FROM s1 GROUP BY v) "
          "SELECT t.id, t.price, round(exp((SELECT any_value(m) FROM s0) + l1.w + l2.w) - 1, 4) AS prediction "
          f"FROM test t JOIN l1 ON l1.v = t.{STUMP_FEATURE} JOIN l2 ON l2.v = t.{STUMP_FEATURE}")
def m1_regularised_stumps(spark, sf):
    """Second-order boosting on log1p(price) with penalised leaves."""
    df = MO.with_label(_split(spark, sf), "price", "log1p")
    model = MO.build_pipeline([STUMP_FEATURE], [], REGULARISED_STUMPS, "log1p").fit(df.where(~F.col("is_test")))
    return model.transform(df.where(F.col("is_test"))).select("id", "price", F.round(MO.PREDICTION, 4).alias("prediction"))


@register("m1_absolute_error_stump",
          O.with_blocks("train", "test") +
          ", b AS (SELECT median(ln(price)) AS m FROM train), "
          f"l AS (SELECT {STUMP_FEATURE} AS v, 0.5 * median(ln(price) - m) AS w FROM train, b GROUP BY 1) "
          f"SELECT t.id, t.price, round(exp(m + w), 4) AS prediction FROM test t JOIN l ON l.v = t.{STUMP_FEATURE} CROSS JOIN b")
def m1_absolute_error_stump(spark, sf):
    """The absolute-error objective: start at the median, leaves refitted as medians of their residuals."""
    df = MO.with_label(_split(spark, sf), "price", "log")
    settings = MO.settings_from_reference({"objective": "reg:absoluteerror", "n_estimators": 1, "max_depth": 1, "learning_rate": 0.5},
                                          MO.BoostSettings(algorithm="regularised"))
    model = MO.build_pipeline([STUMP_FEATURE], [], settings, "log").fit(df.where(~F.col("is_test")))
    return model.transform(df.where(F.col("is_test"))).select("id", "price", F.round(MO.PREDICTION, 4).alias("prediction"))


@register("m1_stump_on_imputed_column",
          O.with_blocks("train", "test") +
          ", md AS (SELECT median(latitude) AS med FROM train), "
          "tr AS (SELECT coalesce(latitude, med) AS x, ln(1 + price) AS y FROM train, md), "
          "b AS (SELECT avg(y) AS m, count(*) AS n, sum(y) AS sy FROM tr), "
          "v AS (SELECT x, count(*) AS n, sum(y - m) AS g FROM tr, b GROUP BY x), "
          "c AS (SELECT x AS cut, sum(n) OVER w AS hl, sum(g) OVER w AS gl FROM v WINDOW w AS (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
          "best AS (SELECT cut, hl, gl FROM c, b WHERE hl IS NOT NULL ORDER BY round(gl * gl / (hl + 1) + gl * gl / (n - hl + 1), 9) DESC, cut LIMIT 1) "
          "SELECT t.id, round(exp(m + CASE WHEN coalesce(t.latitude, med) < cut THEN gl / (hl + 1) ELSE -gl / (n - hl + 1) END) - 1, 4) AS prediction "
          "FROM test t, md, b, best")
def m1_stump_on_imputed_column(spark, sf):
    """A regularised stump on a numeric column with missing values: median imputed, cut where the gain is highest."""
    df = MO.with_label(_split(spark, sf), "price", "log1p")
    settings = MO.BoostSettings(max_iter=1, max_depth=1, step_size=1.0, algorithm="regularised", max_bins=1024)
    model = MO.build_pipeline(["latitude"], [], settings, "log1p").fit(df.where(~F.col("is_test")))
    return model.transform(df.where(F.col("is_test"))).select("id", F.round(MO.PREDICTION, 4).alias("prediction"))


@register("m3_stump_on_one_hot_column",
          O.with_blocks("train", "test") +
          ", b AS (SELECT avg(ln(1 + price)) AS m, count(*) AS n FROM train), "
          "v AS (SELECT room_type AS x, count(*) AS h, sum(ln(1 + price) - m) AS g FROM train, b WHERE room_type IS NOT NULL GROUP BY 1), "
          "best AS (SELECT x, h, g FROM v, b WHERE h < n ORDER BY round(g * g / (h + 1) + g * g / (n - h + 1), 9) DESC, x LIMIT 1) "
          "SELECT t.id, round(exp(m + CASE WHEN coalesce(t.room_type = x, false) THEN g / (h + 1) ELSE -g / (n - h + 1) END) - 1, 4) AS prediction "
          "FROM test t, b, best")
def m3_stump_on_one_hot_column(spark, sf):
    """A regularised stump on a one-hot encoded category: the best value against all others."""
    df = MO.with_label(_split(spark, sf), "price", "log1p")
    settings = MO.BoostSettings(max_iter=1, max_depth=1, step_size=1.0, algorithm="regularised")
    model = MO.build_pipeline([], ["room_type"], settings, "log1p").fit(df.where(~F.col("is_test")))
    return model.transform(df.where(F.col("is_test"))).select("id", F.round(MO.PREDICTION, 4).alias("prediction"))


# A leaf that takes a third of the remaining way on every step comes nearer all the time, on rows whose means
# the held-out ones share; the curve is written out for both flags.
_PATIENCE_TREES = 8


@register("m12_patience_curve",
          O.with_blocks("train", "test") +
          ", b AS (SELECT avg(ln(1 + price)) AS m FROM train), "
          f"l AS (SELECT {STUMP_FEATURE} AS v, avg(ln(1 + price)) AS mean FROM train GROUP BY 1), "
          f"e AS (SELECT CAST(k.n AS BIGINT) AS tree, sqrt(avg(power(ln(1 + t.price) - (l.mean - (l.mean - b.m) * power(2.0 / 3, k.n)), 2))) AS err "
          f"FROM test t JOIN l ON l.v = t.{STUMP_FEATURE} CROSS JOIN b CROSS JOIN (SELECT unnest(range(1, {_PATIENCE_TREES + 1})) AS n) k GROUP BY 1), "
          "r AS (SELECT tree, err, (SELECT arg_min(tree, err) FROM e) AS best_tree FROM e) "
          "SELECT tree, round(err, 6) AS error, best_tree FROM r")
def m12_patience_curve(spark, sf):
    """Validation error after every tree (stumps of step 1/3, no penalty) and the tree at which the model ends."""
    df = MO.with_label(_split(spark, sf), "price", "log1p")
    settings = MO.BoostSettings(max_iter=_PATIENCE_TREES, max_depth=1, step_size=1 / 3, algorithm="regularised", reg_lambda=0.0,
                                validation_col="is_test", patience=_PATIENCE_TREES)
    fitted = MO.build_pipeline([STUMP_FEATURE], [], settings, "log1p").fit(df).stages[-2]
    rows = [(i + 1, error, fitted.getNumTrees) for i, error in enumerate(fitted.validationErrors)]
    return spark.createDataFrame(rows, "tree long, error double, best_tree long").withColumn("error", F.round("error", 6))


@register("m1_regularised_on_all_features",
          O.with_blocks("test") + "SELECT count(*) AS test_rows, true AS below_baseline FROM test")
def m1_regularised_on_all_features(spark, sf):
    """The tuned model's own settings (fewer, larger steps) on every feature: its test error is below the median's."""
    split = _split(spark, sf)
    df = MO.with_label(split, "price", "log")
    numeric, categorical = MO.matrix_model_columns(df)
    settings = MO.settings_from_reference(
        {"n_estimators": 4, "max_depth": 4, "learning_rate": 0.4, "min_child_weight": 3, "subsample": 0.8, "colsample_bytree": 0.6,
         "reg_alpha": 0.01, "reg_lambda": 0.1, "gamma": 0}, MO.BoostSettings(algorithm="regularised"))
    train, test = df.where(~F.col("is_test")), df.where(F.col("is_test"))
    model = MO.build_pipeline(numeric, categorical, settings, "log", rare_share=0.01).fit(train)
    own = ME.error_metrics(model.transform(test), "price", MO.PREDICTION).select("n", "mae")
    return own.crossJoin(ME.median_baseline(train, test, "price")).select(
        F.col("n").alias("test_rows"), (F.col("mae") < F.col("baseline_mae")).alias("below_baseline"))


@register("m4_te_cross_validation",
          O.with_blocks("features") +
          "SELECT CAST(f AS INTEGER) AS fold, (n // 5) + CASE WHEN f < n % 5 THEN 1 ELSE 0 END AS n, nested, true AS below_baseline "
          "FROM (SELECT count(*) AS n FROM features), (SELECT unnest(range(5)) AS f), (SELECT unnest([true, false]) AS nested)")
def m4_te_cross_validation(spark, sf):
    """Cross-validation with target encoding over all features, the reference's
    mode and the nested one: fold sizes exact, every fold's error below the one
    of the median of the other folds."""
    f = bench(spark, sf).features.where(F.col("price").isNotNull())
    folds = cut_lineage(FO.balanced_folds(f, 5, 42).select("fold", "price"))
    baseline = [ME.median_baseline(folds.where(F.col("fold") != i), folds.where(F.col("fold") == i), "price")
                .select(F.lit(i).alias("fold"), "baseline_mae") for i in range(5)]
    baseline = functools.reduce(DataFrame.unionByName, baseline)
    settings = MO.BoostSettings(max_iter=5, max_depth=4, step_size=0.4)
    out = [MO.te_cross_validation(f, settings, nested=nested, parallelism=3)[0].withColumn("nested", F.lit(nested)) for nested in (True, False)]
    return out[0].unionByName(out[1]).join(baseline, "fold").select(
        "fold", "n", "nested", (F.col("mae") < F.col("baseline_mae")).alias("below_baseline"))


@register("m4_cross_validation",
          O.with_blocks("folds") +
          f"SELECT CAST(h.fold AS INTEGER) AS fold, round(avg(abs(m.p - h.price)), 4) AS mae, "
          "round(sqrt(avg((m.p - h.price) * (m.p - h.price))), 4) AS rmse, count(*) AS n FROM folds h JOIN "
          f"(SELECT f.fold, t.{STUMP_FEATURE} AS v, exp(avg(ln(1 + t.price))) - 1 AS p "
          "FROM (SELECT DISTINCT fold FROM folds) f JOIN folds t ON t.fold <> f.fold GROUP BY 1, 2) m "
          f"ON m.fold = h.fold AND m.v = h.{STUMP_FEATURE} GROUP BY 1")
def m4_cross_validation(spark, sf):
    """Every fold held out once; its errors under the stump of the others."""
    df = MO.with_label(_folds(spark, sf), "price", "log1p")
    per_fold, _ = MO.cross_validate(df, MO.build_pipeline([STUMP_FEATURE], [], STUMP, "log1p"), parallelism=3)
    return per_fold.select("fold", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), "n")


@register("m5_final_te_model",
          O.with_blocks("features") +
          f"SELECT (SELECT count(*) FROM features WHERE {O.key_hash('id')} < 0.1 * 4294967296) AS validation_rows, "
          "(SELECT count(DISTINCT neighbourhood_cleansed) FROM features) AS te_categories, "
          "(SELECT round(avg(price), 6) FROM features) AS te_mean, true AS uses_target_encoding, "
          "'log1p' AS target_transform")
def m5_final_te_model(spark, sf):
    """Final target-encoded model, saved with metadata and encoding table (S8,
    S9, S11); what the stored record and table say."""
    path = scratch_path(spark, "te_model")
    MO.train_te_model(bench(spark, sf).features, SMALL_TREES, model_dir=path)
    meta = spark.read.json(os.path.join(path, "metadata"))
    mapping, mean = IO.read_target_encoding(spark, os.path.join(path, "target_encoding"))
    categories = mapping.where(F.col(mapping.columns[0]).isNotNull()).agg(F.count(F.lit(1)).alias("te_categories"))
    return meta.crossJoin(categories).crossJoin(mean.select(F.round(mean.columns[0], 6).alias("te_mean"))).select(
        F.get_json_object("metrics", "$.validation_rows").cast("bigint").alias("validation_rows"),
        "te_categories", "te_mean", "uses_target_encoding", "target_transform")


@register("m6_random_search",
          O.with_blocks("joined") +
          ", j AS (SELECT id, price FROM joined), "
          "e AS (SELECT min(price) AS mn, quantile_cont(price, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS qs FROM j), "
          "st AS (SELECT j.*, len(list_filter(list_distinct(e.qs), lambda x: x > e.mn AND x < j.price)) AS stratum FROM j, e), "
          + O.QUOTAS.replace("FROM strata ", "FROM st ") +
          f", rk AS (SELECT st.*, row_number() OVER (PARTITION BY st.stratum ORDER BY {O.key_hash('st.id')}, st.id) AS rk, "
          "quota FROM st JOIN quotas q ON q.stratum = st.stratum), "
          "sp AS (SELECT *, rk <= quota AS is_test FROM rk), "
          "md AS (SELECT median(price) AS m FROM sp WHERE NOT is_test) "
          "SELECT (SELECT count(*) FROM sp WHERE NOT is_test) AS train_rows, (SELECT count(*) FROM sp WHERE is_test) AS test_rows, "
          "(SELECT round(m, 6) FROM md) AS train_median, "
          "(SELECT round(avg(abs(price - m)), 6) FROM sp, md WHERE is_test) AS baseline_mae, "
          "(SELECT round(quantile_cont(price, 0.9), 6) FROM sp WHERE is_test) AS p_tail, true AS best_of_space")
def m6_random_search(spark, sf):
    """Searched-model flow on the clean listings x summary join: stratified
    split, search with key-hash folds, refit, test report, saved model; the
    report's exact parts read back."""
    b = bench(spark, sf)
    j2 = FT.join_reviews(b.listings, b.summary, keep_listing_id=False)
    path = scratch_path(spark, "searched_model")
    MO.train_searched_model(j2, SMALL_SEARCH, k=5, base=SMALL_TREES, parallelism=4, model_dir=path)
    report = spark.read.json(os.path.join(path, "metadata"))
    texts = [json.dumps(d, sort_keys=True) for d in SMALL_SEARCH]
    return report.select("train_rows", "test_rows", r6("train_median").alias("train_median"),
                         r6("baseline_mae").alias("baseline_mae"), r6("p_tail").alias("p_tail"),
                         F.col("best_params").isin(texts).alias("best_of_space"))


@register("s4_clean_step_tables_audit",
          O.with_blocks("clean", "reviews_clean", "summary") +
          "SELECT 'listings_features' AS table_name, CAST(34 AS BIGINT) AS n_cols, count(*) AS n_rows, "
          "min(price) AS min_price, max(price) AS max_price FROM clean "
          "UNION ALL SELECT 'reviews', 6, count(*), NULL, NULL FROM reviews_clean "
          "UNION ALL SELECT 'reviews_summary', 6, count(*), NULL, NULL FROM summary")
def s4_clean_step_tables_audit(spark, sf):
    """The clean step end to end: raw -> three written tables -> verify_clean audit."""
    from rentalytics.plans.cleaning import audit_clean_tables, write_clean_step

    b = bench(spark, sf)
    return audit_clean_tables(spark, write_clean_step(b.raw_listings, b.raw_reviews, scratch_path(spark, "clean")))


@register("m10_feature_importance", "SELECT 'planted' AS feature, 1 AS place")
def m10_feature_importance(spark, sf):
    """Importances of a model that has the price itself among its features."""
    df = MO.with_label(_split(spark, sf).withColumn("planted", F.col("price")), "price", "log")
    model = MO.build_pipeline(["planted", "beds", "bedrooms", "latitude"], ["room_type"], SMALL_TREES, "log",
                              rare_share=0.01).fit(df.where(~F.col("is_test")))
    top = MO.feature_importances(model, model.transform(df.where(F.col("is_test"))), 1)
    return top.select("feature", F.lit(1).alias("place"))


def _stump_step(rows: str, best: str) -> str:
    """The best cut over both columns of ``rows`` (id, a, b, y, m), gradients m - y, lambda 1: feature, cut, sums below it, gain."""
    return (f"{best} AS (SELECT * FROM (SELECT f, x AS cut, round(gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1), 9) AS gain, "
            "gl, hl, gt, ht FROM (SELECT f, x, sum(g) OVER lower AS gl, sum(h) OVER lower AS hl, sum(g) OVER (PARTITION BY f) AS gt, sum(h) OVER (PARTITION BY f) AS ht "
            "FROM (SELECT f, x, sum(g) AS g, count(*) AS h FROM "
            f"(SELECT 0 AS f, a AS x, m - y AS g FROM {rows} UNION ALL SELECT 1, b, m - y FROM {rows}) GROUP BY f, x) "
            "WINDOW lower AS (PARTITION BY f ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) "
            "WHERE hl IS NOT NULL ORDER BY gain DESC, f, cut LIMIT 1)")


@register("m10_two_stump_importances",
          O.with_blocks("train") +
          ", s0 AS (SELECT id, CAST(accommodates AS DOUBLE) AS a, CAST(beds AS DOUBLE) AS b, ln(1 + price) AS y, (SELECT avg(ln(1 + price)) FROM train) AS m "
          "FROM train WHERE accommodates IS NOT NULL AND beds IS NOT NULL), " + _stump_step("s0", "b1") +
          ", s1 AS (SELECT id, a, b, y, m + 0.5 * CASE WHEN (CASE WHEN f = 0 THEN a ELSE b END) < cut THEN -gl / (hl + 1) ELSE -(gt - gl) / (ht - hl + 1) END AS m "
          "FROM s0, b1), " + _stump_step("s1", "b2") +
          ", g AS (SELECT n.f, n.feature, coalesce((SELECT avg(gain) FROM (SELECT f, gain FROM b1 UNION ALL SELECT f, gain FROM b2) u WHERE u.f = n.f), 0) AS gain "
          "FROM (VALUES (0, 'accommodates'), (1, 'beds')) n(f, feature)) "
          "SELECT feature, round(gain / (SELECT sum(gain) FROM g), 6) AS importance FROM g")
def m10_two_stump_importances(spark, sf):
    """Importances (mean gain per feature, as shares) of two regularised stumps over two columns."""
    df = MO.with_label(_split(spark, sf), "price", "log1p").where(~F.col("is_test"))
    settings = MO.BoostSettings(max_iter=2, max_depth=1, step_size=0.5, algorithm="regularised")
    model = MO.build_pipeline(["accommodates", "beds"], [], settings, "log1p").fit(df)
    return MO.feature_importances(model, model.transform(df), 2).withColumn("importance", F.round("importance", 6))


@register("a8_written_tables",
          O.with_blocks("clean", "reviews_clean", "summary") +
          "SELECT 'listings_features' AS table_name, true AS in_database, 'MANAGED' AS table_type, "
          "34 AS n_cols, count(*) AS n FROM clean "
          "UNION ALL SELECT 'reviews', true, 'MANAGED', 6, count(*) FROM reviews_clean "
          "UNION ALL SELECT 'reviews_summary', true, 'MANAGED', 6, count(*) FROM summary")
def a8_written_tables(spark, sf):
    """The clean step written to the catalog twice (replaced whole), then listed from its database with row counts."""
    from rentalytics.plans.cleaning import CleanTables, write_clean_tables

    b = bench(spark, sf)
    database = f"clean_{uuid.uuid4().hex[:12]}"  # a warehouse may still hold the folders of an earlier session
    for _ in range(2):
        paths = write_clean_tables(CleanTables(b.listings, b.reviews, b.summary), database)
    listing = PR.catalog_listing(spark, database).withColumn("in_database", F.col("database") == database).drop("database")
    return listing.join(PR.row_counts({name: IO.read_table(spark, path) for name, path in paths.items()}), "table_name")


@register("m11_batch_scoring",
          O.with_blocks("features") + "SELECT id, true AS as_in_memory, neighbourhood_cleansed IS NULL AS without_area FROM features")
def m11_batch_scoring(spark, sf):
    """Train + save the target-encoded model, then score every listing from the
    stored model: the same predictions as the fitted pipeline in memory gives
    to the encoded rows."""
    f = bench(spark, sf).features
    path = scratch_path(spark, "te_model_scoring")
    trained = MO.train_te_model(f, SMALL_TREES, model_dir=path)
    mapping, mean = IO.read_target_encoding(spark, os.path.join(path, "target_encoding"))
    encoded = EN.apply_target_encoding(f, "neighbourhood_cleansed", mapping, mean, out="neighbourhood_te")
    memory = trained.model.transform(encoded).select("id", "neighbourhood_cleansed", F.col(MO.PREDICTION).alias("expected"))
    return MO.score(f, path).select("id", MO.PREDICTION).join(memory, "id").select(
        "id", (F.abs(F.col(MO.PREDICTION) - F.col("expected")) < 1e-6).alias("as_in_memory"),
        F.col("neighbourhood_cleansed").isNull().alias("without_area"))


@register("m12_early_stopping",
          O.with_blocks("features") +
          f"SELECT count(*) AS validation_rows, true AS stopped_early FROM features WHERE {O.key_hash('id')} < 0.1 * 4294967296")
def m12_early_stopping(spark, sf):
    """A target that no feature explains (a hash of the id), with the fold-wise
    encoding among the features: boosting ends long before its last tree."""
    f = FO.holdout_flag(FO.assign_folds(bench(spark, sf).features), 0.1, flag_col="is_validation")
    noise = key_hash("id", 7) / F.lit(2.0 ** 32) + 1
    f = f.withColumn("noise", noise)
    df = MO.with_label(EN.oof_target_encoding(f, "neighbourhood_cleansed", "noise", "fold", out="neighbourhood_te"),
                       "noise", "log1p")
    df = cut_lineage(df)  # encoded once: every fit of the preprocessing reads it
    numeric, categorical = MO.te_model_columns(df)
    settings = MO.BoostSettings(max_iter=50, max_depth=4, step_size=0.1, validation_col="is_validation")
    model = MO.build_pipeline(numeric, categorical, settings, "log1p", mode_fill=True).fit(df)
    return df.agg(F.count_if("is_validation").alias("validation_rows"),
                  F.lit(model.stages[-2].getNumTrees < 50).alias("stopped_early"))


@register("s2_csv_ingest_reviews", O.with_blocks("raw_reviews") + f"SELECT {_review_text_sql} FROM raw_reviews")
def s2_csv_ingest_reviews(spark, sf):
    """Export the raw reviews (whole comment texts, quotes and line breaks
    included) as CSV, one file per writing task, and ingest them back by splits
    with the fixed text schema."""
    path = IO.write_raw_csv(bench(spark, sf).raw_reviews, scratch_path(spark, "raw_reviews_csv"))
    return _review_text(IO.read_raw_reviews_csv(spark, path))


@register("s10_metrics_csv_report",
          O.with_blocks("oof_te") +
          "SELECT 'MAE' AS metric, round(avg(abs(neighbourhood_te - price)), 6) AS value FROM oof_te "
          "UNION ALL SELECT 'RMSE', round(sqrt(avg((neighbourhood_te - price) * (neighbourhood_te - price))), 6) "
          "FROM oof_te")
def s10_metrics_csv_report(spark, sf):
    """metric,value CSV of the out-of-fold encoding predictor, written and read back."""
    m = ME.error_metrics(_oof(spark, sf), "price", "neighbourhood_te")
    report = m.selectExpr("stack(2, 'MAE', round(mae, 6), 'RMSE', round(rmse, 6)) AS (metric, value)")
    path = IO.write_csv_report(report, scratch_path(spark, "model_metrics_csv"))
    return spark.read.schema("metric string, value double").option("header", "true").csv(path)


@register("p25_parse_review_ids",
          O.with_blocks("raw_reviews") +
          f"SELECT {O.integral('listing_id')} AS listing_id, {O.integral('id')} AS id, "
          f"{O.integral('reviewer_id')} AS reviewer_id FROM raw_reviews")
def p25_parse_review_ids(spark, sf):
    return R.parse_reviews(bench(spark, sf).raw_reviews).select("listing_id", "id", "reviewer_id")


@register("p28_review_text_defaults",
          O.with_blocks("reviews_clean") +
          "SELECT id, reviewer_name, CAST(length(comments) AS BIGINT) AS comments_length FROM reviews_clean")
def p28_review_text_defaults(spark, sf):
    return bench(spark, sf).reviews.select("id", "reviewer_name",
                                           F.length("comments").cast("bigint").alias("comments_length"))


@register("t9_column_routing",
          O.with_blocks("features", "joined", "top_amenities") + "SELECT 'target_encoded' AS model, 'accommodates' AS column_name, 'numeric' AS role FROM features HAVING count(accommodates) > 0 UNION ALL SELECT 'target_encoded' AS model, 'bedrooms' AS column_name, 'numeric' AS role FROM features HAVING count(bedrooms) > 0 UNION ALL SELECT 'target_encoded' AS model, 'beds' AS column_name, 'numeric' AS role FROM features HAVING count(beds) > 0 UNION ALL SELECT 'target_encoded' AS model, 'bathrooms' AS column_name, 'numeric' AS role FROM features HAVING count(bathrooms) > 0 UNION ALL SELECT 'target_encoded' AS model, 'avg_comment_length' AS column_name, 'numeric' AS role FROM features HAVING count(avg_comment_length) > 0 UNION ALL SELECT 'target_encoded' AS model, 'days_since_last_review' AS column_name, 'numeric' AS role FROM features HAVING count(days_since_last_review) > 0 UNION ALL SELECT 'target_encoded' AS model, 'amenities_count' AS column_name, 'numeric' AS role FROM features HAVING count(amenities_count) > 0 UNION ALL SELECT 'target_encoded' AS model, 'dist_to_center_km' AS column_name, 'numeric' AS role FROM features HAVING count(dist_to_center_km) > 0 UNION ALL SELECT 'target_encoded', 'neighbourhood_te', 'numeric' UNION ALL SELECT 'target_encoded', 'property_type', 'categorical' UNION ALL SELECT 'target_encoded', 'room_type', 'categorical' UNION ALL SELECT 'searched', 'latitude', 'numeric' FROM joined HAVING count(latitude) > 0 UNION ALL SELECT 'searched', 'longitude', 'numeric' FROM joined HAVING count(longitude) > 0 UNION ALL SELECT 'searched', 'accommodates', 'numeric' FROM joined HAVING count(accommodates) > 0 UNION ALL SELECT 'searched', 'bedrooms', 'numeric' FROM joined HAVING count(bedrooms) > 0 UNION ALL SELECT 'searched', 'beds', 'numeric' FROM joined HAVING count(beds) > 0 UNION ALL SELECT 'searched', 'bathrooms', 'numeric' FROM joined HAVING count(bathrooms) > 0 UNION ALL SELECT 'searched', 'minimum_nights', 'numeric' FROM joined HAVING count(minimum_nights) > 0 UNION ALL SELECT 'searched', 'maximum_nights', 'numeric' FROM joined HAVING count(maximum_nights) > 0 UNION ALL SELECT 'searched', 'host_is_superhost', 'numeric' FROM joined HAVING count(host_is_superhost) > 0 UNION ALL SELECT 'searched', 'review_scores_rating', 'numeric' FROM joined HAVING count(review_scores_rating) > 0 UNION ALL SELECT 'searched', 'review_scores_accuracy', 'numeric' FROM joined HAVING count(review_scores_accuracy) > 0 UNION ALL SELECT 'searched', 'review_scores_cleanliness', 'numeric' FROM joined HAVING count(review_scores_cleanliness) > 0 UNION ALL SELECT 'searched', 'review_scores_checkin', 'numeric' FROM joined HAVING count(review_scores_checkin) > 0 UNION ALL SELECT 'searched', 'review_scores_communication', 'numeric' FROM joined HAVING count(review_scores_communication) > 0 UNION ALL SELECT 'searched', 'review_scores_location', 'numeric' FROM joined HAVING count(review_scores_location) > 0 UNION ALL SELECT 'searched', 'review_scores_value', 'numeric' FROM joined HAVING count(review_scores_value) > 0 UNION ALL SELECT 'searched', 'reviews_per_month', 'numeric' FROM joined HAVING count(reviews_per_month) > 0 UNION ALL SELECT 'searched', 'amenities_count', 'numeric' FROM joined HAVING count(amenities_count) > 0 UNION ALL SELECT 'searched', 'n_reviews', 'numeric' FROM joined HAVING count(n_reviews) > 0 UNION ALL SELECT 'searched', 'avg_comment_length', 'numeric' FROM joined HAVING count(avg_comment_length) > 0 UNION ALL SELECT 'searched', 'days_since_last_review', 'numeric' FROM joined HAVING count(days_since_last_review) > 0 UNION ALL SELECT 'searched', 'amenity_' || lower(replace(amenity, ' ', '_')), 'numeric' FROM top_amenities UNION ALL SELECT 'searched', 'neighbourhood_cleansed', 'categorical' UNION ALL SELECT 'searched', 'property_type_slim', 'categorical' UNION ALL SELECT 'searched', 'room_type', 'categorical'")
def t9_column_routing(spark, sf):
    """Numeric / categorical routing of both model families (absent and
    all-NULL numeric columns are skipped), one row per routed column."""
    b = bench(spark, sf)
    te_df = EN.oof_target_encoding(FO.assign_folds(b.features), "neighbourhood_cleansed", "price",
                                   out="neighbourhood_te")
    te_num, te_cat = MO.te_model_columns(te_df)
    mx_num, mx_cat = MO.matrix_model_columns(FT.join_reviews(b.listings, b.summary, keep_listing_id=False))
    rows = ([("target_encoded", c, "numeric") for c in te_num] + [("target_encoded", c, "categorical") for c in te_cat]
            + [("searched", c, "numeric") for c in mx_num] + [("searched", c, "categorical") for c in mx_cat])
    return spark.createDataFrame(rows, "model string, column_name string, role string")


@register("m11_stream_scoring", O.with_blocks("features") + "SELECT id, true AS as_batch FROM features")
def m11_stream_scoring(spark, sf):
    """Listings arriving as files, scored by Structured Streaming with the stored
    model (availableNow trigger drains the folder); the sink holds the batch scores."""
    from rentalytics.streaming.scoring import start_scoring_stream

    f = bench(spark, sf).features
    model_dir = scratch_path(spark, "stream_model")
    MO.train_te_model(f, SMALL_TREES, model_dir=model_dir)
    src = scratch_path(spark, "stream_source")
    arriving = f.drop("neighbourhood_te")
    arriving.repartition(4).write.parquet(src)
    sink, ckpt = scratch_path(spark, "stream_sink"), scratch_path(spark, "stream_checkpoint")
    q = start_scoring_stream(spark, src, arriving.schema, model_dir, sink, ckpt, max_files_per_trigger=2,
                             available_now=True)
    q.awaitTermination()
    streamed = spark.read.parquet(sink).select("id", MO.PREDICTION)
    batch = MO.score(arriving, model_dir).select("id", F.col(MO.PREDICTION).alias("expected"))
    return streamed.join(batch, "id").select("id", (F.abs(F.col(MO.PREDICTION) - F.col("expected")) < 1e-6).alias("as_batch"))
