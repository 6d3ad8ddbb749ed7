"""Command line for the end-to-end flows.

    python -m rentalytics clean    --listings L.csv --reviews R.csv --out BASE [--buckets N]
    python -m rentalytics audit    --clean BASE
    python -m rentalytics features --clean BASE --out PATH [--refresh]
    python -m rentalytics evaluate --features PATH --model-dir DIR [--folds 5] [--trees 2000] [--nested]
    python -m rentalytics train    --clean BASE --model-dir DIR [--draws 30 | --space FILE]
    python -m rentalytics score    --model-dir DIR --input PATH --out PATH

BASE is a shared folder or a catalog database; run under spark-submit on a
cluster with spark.checkpoint.dir naming a shared folder.
"""

from __future__ import annotations

import argparse
import json
from dataclasses import replace

from pyspark.sql import functions as F

from .config import CleanParams, TE_MODEL_SETTINGS
from .plans import cleaning as C
from .plans import modelling as M
from .session import build_session
from .sources import io

def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="rentalytics")
    sub = ap.add_subparsers(dest="cmd", required=True)
    p = sub.add_parser("clean")
    p.add_argument("--listings", required=True)
    p.add_argument("--reviews", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--buckets", type=int)
    p.add_argument("--max-minimum-nights", type=int, default=27)
    p = sub.add_parser("audit")
    p.add_argument("--clean", required=True)
    p = sub.add_parser("features")
    p.add_argument("--clean", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--refresh", action="store_true")
    p = sub.add_parser("evaluate")
    p.add_argument("--features", required=True)
    p.add_argument("--model-dir", required=True)
    p.add_argument("--folds", type=int, default=5)
    p.add_argument("--trees", type=int, default=TE_MODEL_SETTINGS["n_estimators"])
    p.add_argument("--nested", action="store_true")
    p.add_argument("--early-stopping", action="store_true")
    p = sub.add_parser("train")
    p.add_argument("--clean", required=True)
    p.add_argument("--model-dir", required=True)
    p.add_argument("--draws", type=int, default=30)
    p.add_argument("--space", help="JSON file with the list of settings to search, instead of --draws from the grid")
    p = sub.add_parser("score")
    p.add_argument("--model-dir", required=True)
    p.add_argument("--input", required=True)
    p.add_argument("--out", required=True)
    args = ap.parse_args(argv)

    spark = build_session()
    if args.cmd == "clean":
        params = CleanParams(max_minimum_nights=args.max_minimum_nights)
        paths = C.write_clean_step(io.read_raw_listings_csv(spark, args.listings),
                                   io.read_raw_reviews_csv(spark, args.reviews), args.out, params, buckets=args.buckets)
        C.audit_clean_tables(spark, paths).show(truncate=False)
    elif args.cmd == "audit":
        C.audit_clean_tables(spark, C.table_paths(args.clean)).show(truncate=False)
    elif args.cmd == "features":
        paths = C.table_paths(args.clean)
        io.cached_table(spark, args.out, lambda: C.feature_table(
            io.read_table(spark, paths["listings_features"]), io.read_table(spark, paths["reviews_summary"])),
            refresh=args.refresh).select(F.count(F.lit(1)).alias("rows")).show()
    elif args.cmd == "evaluate":
        feats = io.read_table(spark, args.features)
        settings = replace(M.settings_from_reference(TE_MODEL_SETTINGS), max_iter=args.trees)
        per_fold, summary = M.te_cross_validation(feats, settings, k=args.folds, nested=args.nested)
        per_fold.orderBy("fold").show()
        summary.show()
        if args.early_stopping:
            settings = replace(settings, validation_col="__val")
        trained = M.train_te_model(feats, settings, model_dir=args.model_dir)
        print(json.dumps(trained.metrics))
    elif args.cmd == "train":
        paths = C.table_paths(args.clean)
        joined = C.join_reviews(io.read_table(spark, paths["listings_features"]),
                                io.read_table(spark, paths["reviews_summary"]), keep_listing_id=False)
        if args.space:
            with open(args.space) as file:
                draws = json.load(file)
        else:
            draws = M.sample_search_space(args.draws)
        _, report = M.train_searched_model(joined, draws, model_dir=args.model_dir)
        report.show(vertical=True, truncate=False)
    elif args.cmd == "score":
        scored = M.score(io.read_table(spark, args.input), args.model_dir)
        io.write_table(scored.select("id", M.PREDICTION), args.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
