"""Write PLANS.md: the physical plans of the main operators (``explain()``).

    python -m checks.plans /root/testdata/sf0.01
"""

from __future__ import annotations

import contextlib
import io
import os
import sys


def main(argv) -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from checks.workbench import bench
    from rentalytics.operators import encoding as EN
    from rentalytics.operators import folds as FO
    from rentalytics.operators import reviews as R
    from rentalytics.operators.features import join_reviews
    from rentalytics.plans.cleaning import CleanTables, write_clean_tables
    from rentalytics.session import build_session
    from rentalytics.sources import io as IO

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    import tempfile

    scratch = tempfile.mkdtemp(prefix="rentalytics-plans-")
    spark = build_session("local[8]", shuffle_partitions=16,
                          extra={"spark.sql.warehouse.dir": os.path.join(scratch, "warehouse")})
    b = bench(spark, sf_dir)
    paths = write_clean_tables(CleanTables(b.listings, b.reviews, b.summary), "rentalytics_plans", buckets=16)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    bucketed = join_reviews(IO.read_table(spark, paths["listings_features"]),
                            IO.read_table(spark, paths["reviews_summary"]))
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        bucketed.explain()
    bucketed_plan = buf.getvalue()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plans = {
        "Review summary from clean reviews (partial aggregation, one-column latest date)":
            R.reviews_summary(b.reviews),
        "Listings LEFT JOIN summary (summary side keeps its group-by partitioning)":
            join_reviews(b.listings, R.reviews_summary(b.reviews)),
        "Listings LEFT JOIN summary from bucketed tables (no exchange; broadcast disabled to show the large-table shape)":
            bucketed,
        "Out-of-fold target encoding (one pass for k folds)":
            EN.oof_target_encoding(FO.assign_folds(b.features), "neighbourhood_cleansed", "price"),
        "Stratified split (rank inside stratum x hash bucket)":
            FO.stratified_holdout(FO.quantile_bins(b.features, "price", 10), "stratum", 0.2),
    }
    out = ["# Physical plans\n", f"Generated by `python -m checks.plans {sf_dir}` (local[8], AQE on; the plans",
           "below are the initial adaptive plans, before runtime re-planning).\n"]
    for title, df in plans.items():
        if df is bucketed:
            text = bucketed_plan
        else:
            buf = io.StringIO()
            with contextlib.redirect_stdout(buf):
                df.explain()
            text = buf.getvalue()
        out += [f"## {title}\n", "```", text.rstrip(), "```\n"]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as fh:
        fh.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
