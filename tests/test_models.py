"""Model plans: wiring and properties (small budgets)."""

from pyspark.sql import functions as F

from checks.workbench import bench
from conftest import SMOKE_DIR
from rentalytics.plans import modelling as MO
from rentalytics.session import scratch_path

SMALL = MO.BoostSettings(max_iter=5, max_depth=3, step_size=0.3)


def test_settings_mapping():
    s = MO.settings_from_reference({"n_estimators": 800, "learning_rate": 0.05, "max_depth": 6,
                                    "subsample": 0.8, "colsample_bytree": 0.6, "min_child_weight": 3,
                                    "gamma": 0.5, "reg_alpha": 0.01, "reg_lambda": 1.0,
                                    "objective": "reg:absoluteerror"})
    assert (s.max_iter, s.step_size, s.max_depth, s.subsampling_rate) == (800, 0.05, 6, 0.8)
    assert s.feature_subset == "0.6" and s.min_instances_per_node == 3 and s.loss == "absolute"
    assert s.ignored == ("reg_alpha", "reg_lambda")


def test_search_draws_reproducible():
    assert MO.sample_search_space(3, 42) == MO.sample_search_space(3, 42)


def test_score_keeps_row_count_and_positive_prices(spark):
    f = bench(spark, SMOKE_DIR).features
    path = scratch_path(spark, "model")
    trained = MO.train_te_model(f, SMALL, model_dir=path)
    assert trained.metrics["validation_rows"] > 0
    scored = MO.score(f.drop("neighbourhood_te"), path)
    assert scored.count() == f.count()
    assert scored.where(F.col("prediction") <= 0).count() == 0


def test_cross_validation_five_folds(spark):
    per_fold, summary = MO.te_cross_validation(bench(spark, SMOKE_DIR).features, SMALL, k=5)
    assert per_fold.count() == 5
    assert summary.first().folds == 5


def test_scoring_stream_drains_all_files(spark):
    import os

    from rentalytics.streaming.scoring import start_scoring_stream

    f = bench(spark, SMOKE_DIR).features.drop("neighbourhood_te")
    model_dir = scratch_path(spark, "stream_model")
    MO.train_te_model(bench(spark, SMOKE_DIR).features, SMALL, model_dir=model_dir)
    src = scratch_path(spark, "stream_src")
    f.repartition(3).write.parquet(src)
    sink, ckpt = scratch_path(spark, "stream_sink"), scratch_path(spark, "stream_ckpt")
    q = start_scoring_stream(spark, src, f.schema, model_dir, sink, ckpt, max_files_per_trigger=1,
                             available_now=True)
    q.awaitTermination(300)
    out = spark.read.parquet(sink)
    assert out.count() == f.count()
    assert out.select("id").distinct().count() == f.count()


def test_nested_cross_validation_runs(spark):
    per_fold, summary = MO.te_cross_validation(bench(spark, SMOKE_DIR).features, SMALL, k=3, nested=True)
    assert per_fold.count() == 3
    assert summary.first().mae_mean > 0


def test_gbt_beats_median_baseline_on_signal(spark):
    from rentalytics.operators import folds as FO
    from rentalytics.operators import metrics as ME

    f = bench(spark, SMOKE_DIR).features
    # a price with signal in the features (the bound fixture price has none)
    sig = f.withColumn("price", 40.0 + 35.0 * F.col("accommodates") + 20.0 * F.col("bedrooms")
                       + (F.col("id") % 7).cast("double"))
    df = FO.holdout_flag(sig, 0.2, flag_col="is_test")
    df = MO.with_label(df.withColumn("neighbourhood_te", F.lit(0.0)), "price", "log1p")
    numeric, categorical = MO.te_model_columns(df)
    model = MO.build_pipeline(numeric, categorical, MO.BoostSettings(max_iter=30, max_depth=4, step_size=0.2),
                              "log1p", mode_fill=True).fit(df.where(~F.col("is_test")))
    test = df.where(F.col("is_test"))
    mae = ME.error_metrics(model.transform(test), "price", "prediction").first().mae
    base = ME.median_baseline(df.where(~F.col("is_test")), test, "price").first().baseline_mae
    assert mae < 0.5 * base


def test_scoring_stream_restart_is_exactly_once(spark):
    from rentalytics.streaming.scoring import start_scoring_stream

    f = bench(spark, SMOKE_DIR).features
    arriving = f.drop("neighbourhood_te")
    model_dir = scratch_path(spark, "restart_model")
    MO.train_te_model(f, SMALL, model_dir=model_dir)
    src = scratch_path(spark, "restart_src")
    sink, ckpt = scratch_path(spark, "restart_sink"), scratch_path(spark, "restart_ckpt")
    first = arriving.where(F.col("id") % 2 == 0)
    second = arriving.where(F.col("id") % 2 == 1)
    first.write.mode("append").parquet(src)

    def drain():
        q = start_scoring_stream(spark, src, arriving.schema, model_dir, sink, ckpt, available_now=True)
        q.awaitTermination(300)
        return spark.read.parquet(sink).select("id")

    assert drain().count() == first.count()
    assert drain().count() == first.count()          # restart: nothing re-scored
    second.write.mode("append").parquet(src)
    out = drain()
    assert out.count() == arriving.count() and out.distinct().count() == arriving.count()


def test_train_scope_encoding_and_early_stopping(spark):
    from rentalytics.operators import folds as FO

    f = bench(spark, SMOKE_DIR).features
    trained = MO.train_te_model(f, SMALL, te_scope="train")
    assert trained.metrics["validation_rows"] > 0 and trained.uses_te

    df = FO.holdout_flag(f, 0.2, flag_col="is_validation")
    df = MO.with_label(df.withColumn("neighbourhood_te", F.lit(0.0)), "price", "log1p")
    numeric, categorical = MO.te_model_columns(df)
    settings = MO.BoostSettings(max_iter=200, max_depth=3, step_size=0.5, validation_col="is_validation",
                                validation_tol=0.01)
    model = MO.build_pipeline(numeric, categorical, settings, "log1p", mode_fill=True).fit(df)
    assert model.stages[-2].getNumTrees < 200      # stopped on the validation rows


def test_early_stopping_encodes_its_rows_once(spark, monkeypatch):
    """The passes of the fit read written rows, not the fold-wise join anew."""
    import pytest

    from checks import registry

    class Stop(Exception):
        pass

    def look(df):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
        raise Stop

    monkeypatch.setattr(registry.MO, "te_model_columns", look)
    with pytest.raises(Stop):
        registry.m12_early_stopping(spark, SMOKE_DIR)
