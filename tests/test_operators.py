
import hashlib
import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from conftest import SMOKE_DIR
from pyspark.sql import functions as F

from rentalytics.config import CleanParams
from rentalytics.operators import encoding as EN
from rentalytics.operators import folds as FO
from rentalytics.operators import listings as L
from rentalytics.operators.stats import median_fill


def test_outlier_filter_edges(spark):
    df = spark.createDataFrame([(1, 10.0, 1), (2, 2000.0, 4), (3, 100.0, None), (4, 400.0, 0),
                                (5, 600.0, 0), (6, 9.99, 2), (7, 2000.01, 5)],
                               "id long, price double, accommodates long")
    kept = sorted(r.id for r in L.outlier_filter(df, CleanParams()).collect())
    assert kept == [1, 2, 4]


def test_median_fill(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,), (None,)], "beds double")
    assert [r.beds for r in median_fill(df, ["beds"]).collect()] == [1.0, 2.0, 4.0, 10.0, 3.0]


def test_quantile_p90(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "y double")
    assert abs(FO.quantile(df, "y", 0.9).first().q - 8.2) < 1e-12


def test_qcut_bins_drop_duplicate_edges(spark):
    vals = [1, 1, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "id int, y double")
    got = [r.stratum for r in FO.quantile_bins(df, "y", 10).orderBy("id").collect()]
    assert got == [0, 0, 0, 0, 1, 2, 3, 4, 5, 6, 7, 7]
    expected = pd.qcut(pd.Series(vals, dtype=float), 10, labels=False, duplicates="drop").tolist()
    assert got == expected


def brute_quotas(sizes, fraction):
    """Largest remainders of the kept rows, in fractions; ties to the smaller stratum, null first."""
    total = sum(sizes.values())
    kept = total - min(total, math.ceil(fraction * total))
    exact = {g: Fraction(n * kept, total) for g, n in sizes.items()}
    base = {g: math.floor(x) for g, x in exact.items()}
    order = sorted(sizes, key=lambda g: (-(exact[g] - base[g]), g is not None, g or 0))
    for g in order[:kept - sum(base.values())]:
        base[g] += 1
    return {g: n - base[g] for g, n in sizes.items()}


@pytest.mark.parametrize("fraction", [0.0, 0.1, 0.2, 1 / 3, 0.5, 0.77, 1.0])
def test_stratified_totals_are_exact(spark, fraction):
    rows = [(i, None if i % 11 == 0 else i % 3 if i % 7 else i % 5) for i in range(311)]
    df = spark.createDataFrame(rows, "id long, g int")
    out = FO.stratified_holdout(df.repartition(5), "g", fraction, seed=42).collect()
    quotas = brute_quotas(Counter(g for _, g in rows), fraction)
    assert sum(r.is_test for r in out) == math.ceil(fraction * len(rows)) == sum(quotas.values())
    # against a plain per-group sort by (hash, id)
    hashed = sorted((int(hashlib.md5(f"{i}:42".encode()).hexdigest()[:8], 16), i, g) for i, g in rows)
    want = {i for group in quotas for _, i, _ in [r for r in hashed if r[2] == group][:quotas[group]]}
    assert {r.id for r in out if r.is_test} == want


@pytest.mark.parametrize("n, k", [(0, 5), (1, 5), (4, 5), (5, 5), (1003, 5), (1004, 3), (50, 2)])
def test_balanced_folds(spark, n, k):
    ids = [i * 7919 % 100_003 for i in range(n)]
    df = spark.createDataFrame([(i, "x") for i in ids], "id long, other string")
    got = FO.balanced_folds(df.repartition(6), k, 42).collect()
    order = sorted(ids, key=lambda i: (int(hashlib.md5(f"{i}:42".encode()).hexdigest()[:8], 16), i))
    runs = np.array_split(np.arange(n), k)
    fold = {order[place]: f for f, run in enumerate(runs) for place in run}
    assert {r.id: r.fold for r in got} == fold and all(r.other == "x" for r in got)


def test_folds_cover_every_id_once(spark):
    df = spark.range(2000).withColumnRenamed("id", "id")
    f = FO.assign_folds(df, 5, 42).toPandas()
    assert f.id.is_unique and set(f.fold) == {0, 1, 2, 3, 4}
    assert f.fold.value_counts().min() > 300


def test_folds_invariant_to_partitioning(spark):
    df = spark.range(1000)
    a = FO.assign_folds(df.repartition(1), 5, 42).toPandas().sort_values("id").fold.tolist()
    b = FO.assign_folds(df.repartition(8), 5, 42).toPandas().sort_values("id").fold.tolist()
    assert a == b


def test_oof_encoding_equals_naive_loop(spark):
    rows = [(i, ["a", "b", "c", None, "solo"][i % 5] if i != 3 else "only3", float(10 + (i * 37) % 50))
            for i in range(300)]
    df = FO.assign_folds(spark.createDataFrame(rows, "id long, cat string, y double"), 5, 42)
    got = EN.oof_target_encoding(df, "cat", "y", "fold").toPandas().set_index("id").te
    pdf = df.toPandas()
    gm = pdf.y.mean()
    for f in range(5):
        train, val = pdf[pdf.fold != f], pdf[pdf.fold == f]
        means = train.groupby("cat").y.mean()
        for _, r in val.iterrows():
            c = r["cat"]
            expect = means.get(c, gm) if c is not None else gm
            assert abs(got[r["id"]] - expect) < 1e-9


def test_oof_encoding_category_in_one_fold_gets_global_mean(spark):
    df = spark.createDataFrame([(1, "x", 1.0, 0), (2, "x", 3.0, 0), (3, "y", 5.0, 1), (4, "y", 7.0, 2)],
                               "id long, cat string, y double, fold int")
    got = {r.id: r.te for r in EN.oof_target_encoding(df, "cat", "y").collect()}
    assert got[1] == got[2] == 4.0          # 'x' only in fold 0 -> global mean
    assert got[3] == 7.0 and got[4] == 5.0


def test_one_hot_unseen_and_null_all_zero(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    from pyspark.ml.functions import vector_to_array

    train = spark.createDataFrame([("b",), ("a",)], "c string")
    pipe = Pipeline(stages=[StringIndexer(inputCol="c", outputCol="i", handleInvalid="keep",
                                          stringOrderType="alphabetAsc"),
                            OneHotEncoder(inputCol="i", outputCol="v", dropLast=True)]).fit(train)
    test = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "c string")
    got = [r.a for r in pipe.transform(test).select(vector_to_array("v").alias("a")).collect()]
    assert got == [[1.0, 0.0], [0.0, 1.0], [0.0, 0.0], [0.0, 0.0]]


def test_infrequent_bucket(spark):
    from rentalytics.operators.ml_stages import InfrequentBucketer

    rows = [("common",)] * 120 + [("rare",)] + [(None,)] * 2
    df = spark.createDataFrame(rows, "c string")
    test = spark.createDataFrame([("common",), ("rare",), ("unseen",), (None,)], "c string")
    fitted = InfrequentBucketer(inputCols=["c"], minFrequency=0.01).fit(df)
    assert [r.c for r in fitted.transform(test).collect()] == \
        ["common", "infrequent", "infrequent", "infrequent"]


def test_property_map_threshold(spark):
    rows = [("A",)] * 99 + [("B",)] + [(None,)] * 0
    df = spark.createDataFrame(rows, "property_type string")
    m = {r.property_type: r.property_type_slim for r in L.property_type_map(df, 0.02).collect()}
    assert m == {"A": "A", "B": "Other"}
    listings = spark.createDataFrame([("A",), ("B",), ("C",), (None,)], "property_type string")
    out = [r.property_type_slim for r in L.add_property_type_slim(listings, L.property_type_map(df, 0.02)).collect()]
    assert sorted(out) == ["A", "Other", "Other", "Other"]


def test_top_amenities_ties_by_name(spark):
    df = spark.createDataFrame([('["b", "a"]',), ('["a", "c"]',), ('["c", "b"]',), ('["d"]',)], "amenities string")
    assert L.top_amenity_names(df, 2) == ["a", "b"]


def test_broadcast_guard_rows_and_bytes(spark):
    from rentalytics.operators.broadcast import broadcast_if_small

    small = spark.createDataFrame([(i, "x" * 10) for i in range(10)], "k int, v string")
    big_text = spark.createDataFrame([(i, "x" * 1000) for i in range(10)], "k int, v string")
    def is_broadcast(df):
        return "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()
    assert is_broadcast(broadcast_if_small(small, max_rows=100, max_bytes=10_000))
    assert not is_broadcast(broadcast_if_small(small, max_rows=5))
    assert not is_broadcast(broadcast_if_small(big_text, max_rows=100, max_bytes=5_000))


def test_exact_quantiles_equal_spark_percentile(spark):
    import random

    from rentalytics.operators.quantiles import exact_quantiles

    rnd = random.Random(7)
    vals = [rnd.gauss(100, 30) for _ in range(3000)] + [55.5] * 400 + [None] * 20
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    probs = [0.1, 0.25, 0.5, 0.9, 0.999]
    expect = df.agg(F.percentile("x", probs).alias("p")).first().p
    got = exact_quantiles(df, "x", probs, final_rows=50, buckets=16)   # forces several passes
    assert got == list(expect)
    assert exact_quantiles(df.where("x is null"), "x", [0.5]) == [None]


def test_exact_quantiles_many_columns_share_passes(spark):
    from rentalytics.operators.quantiles import exact_quantiles_many

    rows = [(float(i % 97) * 1.5, float((i * 7919) % 1000) / 7.0 if i % 5 else None, 3.0) for i in range(2000)]
    df = spark.createDataFrame(rows, "a double, b double, k double")
    got = exact_quantiles_many(df, {"a": [0.5, 0.9], "b": [0.3], "k": [0.5]}, final_rows=20, buckets=8)
    for c, ps in {"a": [0.5, 0.9], "b": [0.3], "k": [0.5]}.items():
        assert got[c] == list(df.agg(F.percentile(c, ps).alias("p")).first().p)


def test_cleaning_invariant_to_input_partitioning(spark):
    from checks.workbench import bench
    from conftest import SMOKE_DIR
    from rentalytics.plans.cleaning import clean_tables

    b = bench(spark, SMOKE_DIR)
    outs = []
    for n in (1, 7):
        t = clean_tables(b.raw_listings.repartition(n), b.raw_reviews.repartition(n))
        outs.append(sorted(tuple(r) for r in t.listings.collect()))
        outs.append(sorted(tuple(r) for r in t.summary.collect()))
    assert outs[0] == outs[2] and outs[1] == outs[3]


def test_library_plan_equals_staged_workbench(spark):
    from checks.workbench import bench
    from conftest import SMOKE_DIR
    from rentalytics.plans.cleaning import clean_tables, feature_table

    b = bench(spark, SMOKE_DIR)
    t = clean_tables(b.raw_listings, b.raw_reviews)
    assert t.listings.columns == b.listings.columns and len(t.listings.columns) == 34
    assert sorted(tuple(r) for r in t.listings.collect()) == sorted(tuple(r) for r in b.listings.collect())
    f = feature_table(t.listings, t.summary)
    assert sorted(tuple(r) for r in f.collect()) == sorted(tuple(r) for r in b.features.collect())


def test_clean_step_reads_the_raw_reviews_once(spark, monkeypatch):
    import __spark_entry__ as E
    from checks import workbench

    build, seen = workbench.fixtures.raw_reviews, spark.sparkContext.accumulator(0)
    raw = build(spark, SMOKE_DIR)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(workbench, "_CACHE", {})
    monkeypatch.setattr(workbench.fixtures, "raw_reviews", lambda *_: raw.mapInArrow(counted, raw.schema))
    audit = E.queries()["s4_clean_step_tables_audit"](spark, SMOKE_DIR)
    assert {r["table_name"] for r in audit.collect()} == {"listings_features", "reviews", "reviews_summary"}
    assert seen.value == raw.count()


@pytest.mark.parametrize("buckets", [None, 4])
def test_clean_step_writes_the_rows_of_the_clean_tables(spark, buckets):
    from checks.workbench import bench
    from rentalytics.plans.cleaning import clean_tables, write_clean_step
    from rentalytics.session import scratch_path
    from rentalytics.sources import io

    b = bench(spark, SMOKE_DIR)
    base = "rentalytics_clean_step" if buckets else scratch_path(spark, "clean_step")
    paths = write_clean_step(b.raw_listings, b.raw_reviews, base, buckets=buckets)
    t = clean_tables(b.raw_listings, b.raw_reviews)
    for name, df in {"listings_features": t.listings, "reviews": t.reviews, "reviews_summary": t.summary}.items():
        written = io.read_table(spark, paths[name])
        assert written.dtypes == df.dtypes
        assert sorted(map(str, written.collect())) == sorted(map(str, df.collect()))


def test_review_summary_with_hot_listing(spark):
    """One listing holds a third of all reviews: partial aggregation keeps the
    result exact (checked against pandas)."""
    from rentalytics.operators import reviews as R

    rows = []
    for i in range(3000):
        lid = 1 if i % 3 == 0 else 2 + i % 50
        rows.append((str(lid), str(i), f"2024-01-{1 + i % 28:02d}", str(i % 9), None, "x" * (i % 13)))
    raw = spark.createDataFrame(rows, "listing_id string, id string, date string, reviewer_id string, "
                                      "reviewer_name string, comments string").repartition(6)
    got = R.reviews_summary(R.clean_reviews(raw)).toPandas().set_index("listing_id")
    pdf = raw.toPandas()
    pdf["n"] = pdf.comments.str.len()
    hot = pdf[pdf.listing_id == "1"]
    assert got.loc[1, "n_reviews"] == len(hot) == 1000
    assert abs(got.loc[1, "avg_comment_length"] - hot.n.mean()) < 1e-12
    assert got.loc[1, "days_since_last_review"] == 0


def test_strict_ids_fail_or_drop(spark):
    import pytest

    from rentalytics.config import RAW_LISTING_COLUMNS

    base = {c: None for c in RAW_LISTING_COLUMNS}
    rows = [dict(base, id="1", price="$100.00", accommodates="2", minimum_nights="2", amenities='["a"]'),
            dict(base, id="x1", price="$100.00", accommodates="2", minimum_nights="2", amenities='["a"]')]
    raw = spark.createDataFrame([tuple(r[c] for c in RAW_LISTING_COLUMNS) for r in rows],
                                ", ".join(f"{c} string" for c in RAW_LISTING_COLUMNS))
    with pytest.raises(Exception):
        L.clean_listings(raw, checkpoint_prepared=False).collect()
    out = L.clean_listings(raw, checkpoint_prepared=False, strict_ids=False).collect()
    assert [r.id for r in out] == [1]


def test_property_map_fitted_on_some_rows(spark):
    from rentalytics.sources.fixtures import raw_listings

    raw = raw_listings(spark, SMOKE_DIR)
    everywhere = L.clean_listings(raw)
    partly = L.clean_listings(raw, map_rows=F.col("id") % 2 == 0)
    assert partly.count() == everywhere.count()
    half = L.property_type_map(everywhere.where("id % 2 = 0"), 0.01)
    kept = {r.property_type for r in half.collect() if r.property_type_slim != "Other"}
    assert {r.property_type_slim for r in partly.select("property_type_slim").distinct().collect()} <= kept | {"Other"}


def test_numbers_parsed_together_are_those_parsed_alone(spark):
    from rentalytics.functions import numeric_text

    texts = ["1e3", " 12 ", "1d", "nan", "", None, "1,000", "inf", " inf ", "1e999", "-.5", "N/A"]
    df = spark.createDataFrame([(str(i), a, b) for i, (a, b) in enumerate(zip(texts, reversed(texts)))],
                               "id string, beds string, latitude string")
    alone = df.select(F.col("id").cast("bigint"), numeric_text("beds"), numeric_text("latitude"))
    parsed = L.parse_listings(df)
    assert parsed.columns == ["id", "beds", "latitude"]
    assert parsed.orderBy("id").collect() == alone.orderBy("id").collect()
    assert L.parse_listings(df.select("id")).columns == ["id"]


def test_flags_as_booleans_and_as_text(spark):
    from rentalytics.operators.features import add_amenity_ints, add_superhost_int

    df = spark.createDataFrame([(1, True, "True", None), (2, False, "no", True), (3, None, " YES ", False)],
                               "id long, amenity_a boolean, amenity_b string, host_is_superhost boolean")
    rows = add_superhost_int(add_amenity_ints(df)).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 1, 1, 0, 2), (2, 0, 0, 1, 0), (3, 0, 1, 0, 1)]
