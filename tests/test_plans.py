"""Physical-plan shape: native expressions only, pushdown, one shuffle per join side."""

import re

from pyspark.sql import functions as F

from checks.workbench import bench
from conftest import SMOKE_DIR
from rentalytics.operators import encoding as EN
from rentalytics.operators import folds as FO
from rentalytics.operators import listings as L
from rentalytics.operators import reviews as R
from rentalytics.operators.features import build_features, join_reviews
from rentalytics.session import scratch_path
from rentalytics.sources import io

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


def plan(df, capsys) -> str:
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


def test_no_python_in_cleaning_join_and_encoding(spark, capsys):
    b = bench(spark, SMOKE_DIR)
    plans = [
        plan(L.add_property_type_slim(b.filtered, b.property_map), capsys),
        plan(join_reviews(b.listings, R.reviews_summary(b.reviews)), capsys),
        plan(EN.oof_target_encoding(FO.assign_folds(b.features), "neighbourhood_cleansed", "price"), capsys),
        plan(FO.stratified_holdout(FO.quantile_bins(b.features, "price", 10), "stratum", 0.2), capsys),
    ]
    for p in plans:
        assert not any(node in p for node in PYTHON_NODES)
        assert "WholeStageCodegen" in p or "*(" in p or "AdaptiveSparkPlan" in p


HOTSPOT_LIMIT = 8000  # bytes of a method; the JVM never compiles a longer one


def largest_method(df, capsys) -> int:
    capsys.readouterr()
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df.explain("codegen")
    finally:
        df.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out))


def test_generated_methods_of_the_clean_step_are_compiled(spark, capsys):
    b = bench(spark, SMOKE_DIR)
    steps = {"prepared listings": L.prepare_listings(b.raw_listings), "summary": R.summarise_reviews(b.reviews),
             "features": build_features(join_reviews(b.listings, b.summary))}
    assert {name: n for name, n in ((k, largest_method(df, capsys)) for k, df in steps.items()) if n > HOTSPOT_LIMIT} == {}


def test_filter_and_projection_reach_the_scan(spark, capsys):
    path = scratch_path(spark, "pushdown")
    io.write_table(bench(spark, SMOKE_DIR).listings, path)
    q = io.read_table(spark, path).where(F.col("price") > 100).select("id", "price")
    p = plan(q, capsys)
    assert "PushedFilters: [IsNotNull(price), GreaterThan(price,100.0)]" in p
    assert "ReadSchema: struct<id:bigint,price:double>" in p


def test_summary_side_shuffled_once(spark, capsys):
    b = bench(spark, SMOKE_DIR)
    p = plan(R.summarise_reviews(b.reviews), capsys)
    assert p.count("hashpartitioning(listing_id") == 1
    assert p.count("lineitem.parquet") == 1
    # The recency step reads the written summary, not the reviews again.
    p = plan(join_reviews(b.listings, R.reviews_summary(b.reviews)), capsys)
    assert "lineitem.parquet" not in p and "documents.parquet" not in p


def test_bucketed_clean_tables_join_without_shuffle(spark, capsys):
    from rentalytics.plans.cleaning import CleanTables, write_clean_tables

    b = bench(spark, SMOKE_DIR)
    paths = write_clean_tables(CleanTables(b.listings, b.reviews, b.summary), "rentalytics_bucketed", buckets=8)
    listings, summary = (io.read_table(spark, paths[n]) for n in ("listings_features", "reviews_summary"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # force the large-table join shape
    try:
        joined = join_reviews(listings, summary)
        p = plan(joined, capsys)
        assert "SortMergeJoin" in p and "Exchange" not in p
        assert joined.count() == b.listings.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
