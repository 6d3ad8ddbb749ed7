"""The command-line flows end to end on exported CSVs."""

import os

from checks.workbench import bench
from conftest import SMOKE_DIR
from rentalytics.__main__ import main
from rentalytics.session import scratch_path
from rentalytics.sources import io


def test_cli_clean_features_evaluate_train_score(spark, tmp_path):
    b = bench(spark, SMOKE_DIR)
    listings_csv = io.write_raw_csv(b.raw_listings, scratch_path(spark, "cli_listings"))
    reviews_csv = io.write_raw_csv(b.raw_reviews, scratch_path(spark, "cli_reviews"))
    base = scratch_path(spark, "cli_clean")
    assert main(["clean", "--listings", listings_csv, "--reviews", reviews_csv, "--out", base]) == 0
    assert io.read_table(spark, base + "/listings_features").count() == b.listings.count()
    assert main(["audit", "--clean", base]) == 0
    feats = scratch_path(spark, "cli_features")
    assert main(["features", "--clean", base, "--out", feats]) == 0
    assert io.read_table(spark, feats).count() == b.features.count()
    te_dir = scratch_path(spark, "cli_te_model")
    assert main(["evaluate", "--features", feats, "--model-dir", te_dir, "--folds", "3", "--trees", "3"]) == 0
    out = scratch_path(spark, "cli_scores")
    assert main(["score", "--model-dir", te_dir, "--input", feats, "--out", out]) == 0
    assert io.read_table(spark, out).count() == b.features.count()
    mx_dir = scratch_path(spark, "cli_searched")
    space = tmp_path / "space.json"
    space.write_text('[{"n_estimators": 3, "max_depth": 2}]')
    assert main(["train", "--clean", base, "--model-dir", mx_dir, "--space", str(space)]) == 0
    assert os.path.exists(os.path.join(mx_dir, "metadata"))
