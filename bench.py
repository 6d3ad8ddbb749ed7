"""Headline timings: prints ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is forced with a ``noop`` write (full computation, nothing
collected).  ``reviews_summary_hot_listing_third`` re-keys a third of the
reviews onto one listing to show the skew behaviour.  The end-to-end cleaning plans run from the raw bound tables;
the downstream operators run on the feature table written once to the
shared folder, as a user would keep it.
"""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))

    from pyspark.sql import functions as F

    from rentalytics.config import CleanParams
    from rentalytics.operators import encoding as EN
    from rentalytics.operators import folds as FO
    from rentalytics.operators import listings as L
    from rentalytics.operators import metrics as ME
    from rentalytics.operators import profile as PR
    from rentalytics.operators import reviews as R
    from rentalytics.plans import modelling as MO
    from rentalytics.plans.cleaning import clean_tables, feature_table
    from rentalytics.session import build_session, cut_lineage
    from rentalytics.sources import fixtures

    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2),
                          extra={"spark.driver.memory": "16g"})
    params = CleanParams()
    times: dict[str, float | None] = {}
    errors: dict[str, str] = {}

    def run(name, build):
        t0 = time.perf_counter()
        try:
            df = build()
            df.write.format("noop").mode("overwrite").save()
        except Exception as e:  # record and keep going: the JSON line is always printed
            times[name] = None
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
            return None
        times[name] = round(time.perf_counter() - t0, 3)
        return df

    raw_l = fixtures.raw_listings(spark, sf_dir)
    raw_r = fixtures.raw_reviews(spark, sf_dir)

    run("clean_listings", lambda: L.clean_listings(raw_l, params))
    run("reviews_summary", lambda: R.reviews_summary(R.clean_reviews(raw_r)))
    # skew: the same reviews with a third of them re-keyed onto one listing
    hot_r = raw_r.withColumn("listing_id", F.when(F.abs(F.hash("id")) % 3 == 0, F.lit("1"))
                             .otherwise(F.col("listing_id")))
    run("reviews_summary_hot_listing_third", lambda: R.reviews_summary(R.clean_reviews(hot_r)))

    def features():
        t = clean_tables(raw_l, raw_r, params)
        return feature_table(t.listings, t.summary, params)

    feats = run("feature_table_end_to_end", features)
    feats = cut_lineage(feats if feats is not None else features())
    folds = FO.assign_folds(feats, params.folds, params.seed)

    run("top_amenities", lambda: L.top_amenities(L.prepare_listings(raw_l), params.top_amenities))
    run("oof_target_encoding", lambda: EN.oof_target_encoding(folds, "neighbourhood_cleansed", "price"))
    run("decile_bins", lambda: FO.quantile_bins(feats, "price", 10))
    run("stratified_split", lambda: FO.stratified_holdout(FO.quantile_bins(feats, "price", 10), "stratum", 0.2))
    run("cv_error_metrics", lambda: ME.fold_summary(ME.error_metrics(
        EN.oof_target_encoding(folds, "neighbourhood_cleansed", "price"), "price", "te", by=["fold"])))
    run("tail_metrics", lambda: ME.tail_metrics(
        EN.oof_target_encoding(folds, "neighbourhood_cleansed", "price"), "price", "te", 0.9))
    run("numeric_bounds", lambda: PR.numeric_bounds(feats, ["accommodates", "bedrooms", "beds", "bathrooms",
                                                            "avg_comment_length", "days_since_last_review"]))
    small = MO.BoostSettings(max_iter=10, max_depth=4, step_size=0.1)
    run("gbt_cross_validation_10_trees",
        lambda: MO.te_cross_validation(feats.where(F.col("price").isNotNull()), small, k=5, parallelism=5)[1])

    total = round(sum(v for v in times.values() if v is not None), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    record = {"metric": "total_query_seconds", "value": total, "unit": "sec",
              "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf_dir, "cpus": cpus}
    if errors:
        record["errors"] = errors
    print(json.dumps(record))
    spark.stop()


if __name__ == "__main__":
    main()
