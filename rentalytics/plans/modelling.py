"""Price models on Spark ML: pipelines, cross-validation, random search,
final training, importances, batch scoring.

The boosted trees are, by ``BoostSettings.algorithm``, Spark's ``GBTRegressor``
(``gbt``) or the second-order booster of ``operators.boosting`` (``regularised``).
``settings_from_reference`` reads the reference's setting names.  The second one
has all of them: L1/L2 leaf penalties, split loss, hessian child weight, columns
drawn per tree, absolute error with leaf medians, patience.  ``gbt`` knows no
leaf penalties, draws columns per node and takes the others in its own meaning.
"""

from __future__ import annotations

import datetime
import json
import math
import os
import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ..config import (
    MATRIX_CATEGORICAL_FEATURES,
    MATRIX_DROPPED_COLUMNS,
    SEARCH_SPACE,
    TE_CATEGORICAL_FEATURES,
    TE_CATEGORY_COLUMN,
    TE_NUMERIC_FEATURES,
    TE_OUTPUT_COLUMN,
)
from ..functions import numeric_text
from ..operators import encoding as EN
from ..operators import metrics as ME
from ..operators.boosting import RegularisedBooster, TreeSettings
from ..operators.ml_stages import InfrequentBucketer, MedianFiller, ModeFiller
from ..session import cut_lineage
from ..sources import io

LABEL = "__label"
RAW_PRED = "__pred_t"
PREDICTION = "prediction"
# Split/fold bookkeeping columns; never model inputs (the stratum is a price bin).
HELPER_COLUMNS = {"fold", "stratum", "is_test", "is_holdout", "__val"}

# Target transforms: forward (fit scale) and inverse (price scale), as SQL.
TRANSFORMS = {
    "log": ("ln({})", "exp({})"),
    "log1p": ("ln(1 + {})", "exp({}) - 1"),
    "none": ("{}", "{}"),
}


@dataclass(frozen=True)
class BoostSettings:
    max_iter: int = 100
    step_size: float = 0.05
    max_depth: int = 6
    subsampling_rate: float = 1.0
    feature_subset: str = "all"
    min_instances_per_node: int = 1
    min_info_gain: float = 0.0
    loss: str = "squared"
    max_bins: int = 32
    seed: int = 42
    validation_col: str | None = None
    validation_tol: float = 0.01
    algorithm: str = "gbt"
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    gamma: float = 0.0
    min_child_weight: float = 1.0
    patience: int | None = None  # ``regularised`` with a validation column
    ignored: tuple = ()

    def effective(self) -> "BoostSettings":
        """These settings without what the algorithm does not look at: equal ones give equal models."""
        if self.algorithm == "regularised":
            return replace(self, min_info_gain=0.0, min_instances_per_node=1, validation_tol=0.0, ignored=())
        return replace(self, reg_alpha=0.0, reg_lambda=1.0, gamma=0.0, min_child_weight=1.0, patience=None, ignored=())


def settings_from_reference(params: dict, base: BoostSettings = BoostSettings()) -> BoostSettings:
    """The reference's parameter names -> settings (M1 mapping), for the algorithm of ``base``."""
    s = base
    mapping = {
        "n_estimators": {"max_iter": int}, "learning_rate": {"step_size": float},
        "max_depth": {"max_depth": int}, "subsample": {"subsampling_rate": float},
        "colsample_bytree": {"feature_subset": lambda v: "all" if float(v) >= 1.0 else str(float(v))},
        "min_child_weight": {"min_instances_per_node": lambda v: max(1, int(v)), "min_child_weight": float},
        "gamma": {"min_info_gain": float, "gamma": float},
        "reg_alpha": {"reg_alpha": float}, "reg_lambda": {"reg_lambda": float},
        "objective": {"loss": lambda v: "absolute" if "absolute" in str(v) else "squared"},
    }
    unused = {"reg_alpha", "reg_lambda"} if base.algorithm == "gbt" else set()
    for k, v in params.items():
        s = replace(s, **{field: convert(v) for field, convert in mapping.get(k, {}).items()})
    return replace(s, ignored=tuple(sorted(k for k in params if k not in mapping or k in unused)))


def booster(settings: BoostSettings) -> Estimator:
    """The boosted-tree stage of a pipeline."""
    if settings.algorithm == "gbt":
        return gbt(settings)
    trees = TreeSettings(
        trees=settings.max_iter, step=settings.step_size, depth=settings.max_depth, alpha=settings.reg_alpha,
        lam=settings.reg_lambda, gamma=settings.gamma, min_child_weight=settings.min_child_weight,
        rows=settings.subsampling_rate, features=1.0 if settings.feature_subset == "all" else float(settings.feature_subset),
        objective=settings.loss, max_bins=settings.max_bins, patience=settings.patience, seed=settings.seed)
    return RegularisedBooster(featuresCol="features", labelCol=LABEL, predictionCol=RAW_PRED,
                              validationIndicatorCol=settings.validation_col, settings=json.dumps(asdict(trees)))


def gbt(settings: BoostSettings) -> GBTRegressor:
    extra = ({"validationIndicatorCol": settings.validation_col, "validationTol": settings.validation_tol}
             if settings.validation_col else {})
    return GBTRegressor(featuresCol="features", labelCol=LABEL, predictionCol=RAW_PRED,
                        maxIter=settings.max_iter, stepSize=settings.step_size, maxDepth=settings.max_depth,
                        subsamplingRate=settings.subsampling_rate,
                        featureSubsetStrategy=settings.feature_subset,
                        minInstancesPerNode=settings.min_instances_per_node,
                        minInfoGain=settings.min_info_gain, lossType=settings.loss,
                        maxBins=settings.max_bins, seed=settings.seed, **extra)


# --- T9 / M3: column routing + preprocessing --------------------------------
def usable_numeric(df: DataFrame, numeric: list[str]) -> list[str]:
    """Present numeric columns that are not entirely NULL (a median imputer
    drops those); one aggregate."""
    present = [c for c in numeric if c in df.columns]
    if not present:
        return []
    row = df.agg(*[F.count(F.col(c)).alias(c) for c in present]).first()
    return [c for c in present if row[c] > 0]


def one_hot_stages(categorical: list[str]) -> list:
    """Alphabetical labels of the fit rows -> 0/1 vectors ``<column>__ohe``; unseen and NULL give zeros."""
    idx = [f"{c}__idx" for c in categorical]
    return [StringIndexer(inputCols=categorical, outputCols=idx, handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=idx, outputCols=[f"{c}__ohe" for c in categorical], dropLast=True)]


def build_pipeline(numeric: list[str], categorical: list[str], settings: BoostSettings,
                   transform: str = "log1p", mode_fill: bool = False,
                   rare_share: float | None = None) -> Pipeline:
    """cast -> median impute -> [mode fill] -> [rare bucket] -> one-hot ->
    assemble -> GBT on the transformed target -> back to the price scale."""
    casts = ", ".join(f"CAST(`{c}` AS DOUBLE) AS `{c}__num`" for c in numeric) or "1 AS __none"
    stages = [SQLTransformer(statement=f"SELECT *, {casts} FROM __THIS__")]
    num_in = [f"{c}__num" for c in numeric]
    num_out = [f"{c}__imp" for c in numeric]
    if numeric:
        stages.append(MedianFiller(inputCols=num_in, outputCols=num_out))
    if categorical and mode_fill:
        stages.append(ModeFiller(inputCols=categorical))
    if categorical and rare_share:
        stages.append(InfrequentBucketer(inputCols=categorical, minFrequency=rare_share))
    vec_cols = list(num_out)
    if categorical:
        stages += one_hot_stages(categorical)
        vec_cols += [f"{c}__ohe" for c in categorical]
    stages.append(VectorAssembler(inputCols=vec_cols, outputCol="features", handleInvalid="keep"))
    stages.append(booster(settings))
    inverse = TRANSFORMS[transform][1].format(RAW_PRED)
    stages.append(SQLTransformer(statement=f"SELECT *, {inverse} AS {PREDICTION} FROM __THIS__"))
    return Pipeline(stages=stages)


def with_label(df: DataFrame, target: str = "price", transform: str = "log1p") -> DataFrame:
    """Add the fit-scale label (M2: the model learns log target, predicts price)."""
    return df.withColumn(LABEL, F.expr(TRANSFORMS[transform][0].format(f"`{target}`")))


# --- the two reference model families ---------------------------------------
def te_model_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    numeric = usable_numeric(df, list(TE_NUMERIC_FEATURES) + [TE_OUTPUT_COLUMN])
    categorical = [c for c in TE_CATEGORICAL_FEATURES if c in df.columns]
    return numeric, categorical


def matrix_model_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """Searched model: the three categoricals, every other column numeric
    except target, ids, dates and the raw property type."""
    categorical = [c for c in MATRIX_CATEGORICAL_FEATURES if c in df.columns]
    skip = set(categorical) | set(MATRIX_DROPPED_COLUMNS) | {"listing_id", LABEL} | HELPER_COLUMNS
    candidates = [f.name for f in df.schema.fields
                  if f.name not in skip and not f.name.startswith("__")
                  and (isinstance(f.dataType, NumericType) or f.dataType.typeName() == "boolean")]
    return usable_numeric(df, candidates), categorical


# --- M4 ---------------------------------------------------------------------
def cross_validate(df: DataFrame, pipeline: Pipeline, fold_col: str = "fold", k: int = 5,
                   target: str = "price", parallelism: int = 2) -> tuple[DataFrame, DataFrame]:
    """Fit on k-1 folds, score the held-out fold, for every fold (fits run
    concurrently); per-fold MAE/RMSE and their mean/std come from ONE
    aggregate over the union of held-out predictions."""
    def fit_one(f: int) -> DataFrame:
        model = pipeline.fit(df.where(F.col(fold_col) != f))
        return model.transform(df.where(F.col(fold_col) == f)).select(fold_col, target, PREDICTION)

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        scored = list(pool.map(fit_one, range(k)))
    union = scored[0]
    for s in scored[1:]:
        union = union.unionByName(s)
    per_fold = ME.error_metrics(union, target, PREDICTION, by=[fold_col])
    return per_fold, ME.fold_summary(per_fold)


def te_cross_validation(features: DataFrame, settings: BoostSettings, k: int = 5, seed: int = 42,
                        nested: bool = False, parallelism: int = 2) -> tuple[DataFrame, DataFrame]:
    """CV with out-of-fold neighbourhood encoding.

    ``nested=False`` is the reference: the encoding is computed once over all
    rows with the same folds, so a held-out row's category mean already
    excludes its own fold but the training rows' encodings saw it.
    ``nested=True`` keeps every held-out fold out of the encoder: training
    rows get an out-of-fold encoding over the remaining folds, and the
    held-out fold gets the mapping fitted on the training rows.
    """
    from ..operators.folds import balanced_folds

    base = cut_lineage(with_label(balanced_folds(features.where(F.col("price").isNotNull()), k, seed),
                                  "price", "log1p"))
    if not nested:
        df = EN.oof_target_encoding(base, TE_CATEGORY_COLUMN, "price", "fold", out=TE_OUTPUT_COLUMN)
        # every fold's preprocessing fits and tree passes read this once-written frame
        df = cut_lineage(df)
        numeric, categorical = te_model_columns(df)
        pipe = build_pipeline(numeric, categorical, settings, "log1p", mode_fill=True)
        return cross_validate(df, pipe, "fold", k, parallelism=parallelism)

    numeric, categorical = te_model_columns(base.withColumn(TE_OUTPUT_COLUMN, F.lit(0.0)))
    pipe = build_pipeline(numeric, categorical, settings, "log1p", mode_fill=True)

    def fit_one(f: int) -> DataFrame:
        train = base.where(F.col("fold") != f)
        held = base.where(F.col("fold") == f)
        train_te = EN.oof_target_encoding(train, TE_CATEGORY_COLUMN, "price", "fold", out=TE_OUTPUT_COLUMN)
        mapping, mean = EN.fit_target_encoding(train, TE_CATEGORY_COLUMN, "price")
        held_te = EN.apply_target_encoding(held, TE_CATEGORY_COLUMN, mapping, mean, out=TE_OUTPUT_COLUMN)
        model = pipe.fit(cut_lineage(train_te))
        return model.transform(held_te).select("fold", "price", PREDICTION)

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        scored = list(pool.map(fit_one, range(k)))
    union = scored[0]
    for part in scored[1:]:
        union = union.unionByName(part)
    per_fold = ME.error_metrics(union, "price", PREDICTION, by=["fold"])
    return per_fold, ME.fold_summary(per_fold)


# --- M6 ---------------------------------------------------------------------
def sample_search_space(n: int, seed: int = 42, space: dict = SEARCH_SPACE) -> list[dict]:
    """``n`` reproducible random draws from the grid without repeats, at most
    the whole grid (driver-side choice of hyper-parameters only; no data involved)."""
    keys = sorted(space)
    draws = []
    for place in random.Random(seed).sample(range(math.prod(len(space[k]) for k in keys)),
                                            min(n, math.prod(len(space[k]) for k in keys))):
        draw = {}
        for k in keys:
            place, choice = divmod(place, len(space[k]))
            draw[k] = space[k][choice]
        draws.append(draw)
    return draws


def random_search(train: DataFrame, draws: list[dict], fold_col: str = "fold", k: int = 5,
                  base: BoostSettings = BoostSettings(), transform: str = "log", rare_share: float = 0.01,
                  parallelism: int = 4) -> tuple[PipelineModel, dict, list[float]]:
    """Search over sampled settings with the key-hash folds, scored by MAE on
    the price scale; the best setting is refit on all of ``train``.

    Imputer, rare bucket, indexer and one-hot depend on the fold alone: they
    are fitted once per fold, the assembled vectors are written, and only the
    trees are fitted for every draw.  Returns model, best draw and mean MAEs.
    """
    df = cut_lineage(with_label(train, "price", transform))
    numeric, categorical = matrix_model_columns(df)
    *prepare, _, back = build_pipeline(numeric, categorical, base, transform, rare_share=rare_share).getStages()
    settings = [settings_from_reference(d, base) for d in draws]
    different = list(dict.fromkeys(x.effective() for x in settings))  # draws that differ in ignored settings only are one

    def vectors(fold: int) -> tuple[DataFrame, DataFrame]:
        rest, held = df.where(F.col(fold_col) != fold), df.where(F.col(fold_col) == fold)
        fitted = Pipeline(stages=prepare).fit(rest)
        return tuple(cut_lineage(fitted.transform(part).select("features", LABEL, "price")) for part in (rest, held))

    def mae(task: tuple[int, int]) -> float:
        rest, held = folds[task[0]]
        scored = back.transform(booster(different[task[1]]).fit(rest).transform(held))
        return ME.error_metrics(scored, "price", PREDICTION).first()["mae"]

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        folds = list(pool.map(vectors, range(k)))
        errors = list(pool.map(mae, [(f, d) for f in range(k) for d in range(len(different))]))
    by_settings = {x: sum(errors[d::len(different)]) / k for d, x in enumerate(different)}
    means = [by_settings[x.effective()] for x in settings]
    best = min(range(len(draws)), key=lambda d: means[d])
    model = build_pipeline(numeric, categorical, settings[best], transform, rare_share=rare_share).fit(df)
    return model, draws[best], means


def train_searched_model(joined: DataFrame, draws: list[dict], k: int = 5, seed: int = 42,
                         test_fraction: float = 0.2, strata: int = 10, base: BoostSettings = BoostSettings(),
                         tail_quantile: float = 0.9, parallelism: int = 4, model_dir: str | None = None) -> tuple[object, DataFrame]:
    """The searched-model flow: price-decile stratified test split, random
    search with key-hash folds on the training rows, refit of the best
    setting, test MAE overall / in the tail / in the body, the training-median
    baseline, and (optionally) model + report saved.  Returns the fitted
    pipeline and a 1-row report."""
    from ..operators.folds import balanced_folds, quantile_bins, stratified_holdout

    split = stratified_holdout(quantile_bins(joined.where(F.col("price").isNotNull()), "price", strata),
                               "stratum", test_fraction, seed)
    split = cut_lineage(split)
    train = cut_lineage(balanced_folds(split.where(~F.col("is_test")), k, seed))
    test = split.where(F.col("is_test"))
    model, best, cv_maes = random_search(train, draws, "fold", k, base, "log", 0.01, parallelism)
    scored = model.transform(with_label(test, "price", "log"))
    tail = ME.tail_metrics(scored, "price", PREDICTION, tail_quantile)
    baseline = ME.median_baseline(train, test, "price")
    counts = split.agg(F.sum((~F.col("is_test")).cast("long")).alias("train_rows"),
                       F.sum(F.col("is_test").cast("long")).alias("test_rows"))
    report = (tail.crossJoin(baseline).crossJoin(counts)
              .withColumn("saved_at", F.lit(datetime.datetime.now().strftime("%Y-%m-%d %H:%M:%S")))
              .withColumn("target", F.lit("price; fitted on its logarithm, predicted in price units"))
              .withColumn("features", F.array(*[F.lit(c) for c in MATRIX_CATEGORICAL_FEATURES], *[
                  F.lit(c) for c in matrix_model_columns(with_label(train, "price", "log"))[0]]))
              .withColumn("cv_mae_mean", F.lit(float(min(cv_maes))))
              .withColumn("best_params", F.lit(json.dumps(best, sort_keys=True))))
    if model_dir:
        model.write().overwrite().save(os.path.join(model_dir, "model"))
        io.write_json_record(report, os.path.join(model_dir, "metadata"))
    return model, report


# --- M10 --------------------------------------------------------------------
def feature_importances(model: PipelineModel, scored: DataFrame, top: int = 10) -> DataFrame:
    """Top feature importances with names from the assembled vector's metadata."""
    gbt_model = model.stages[-2]
    attrs = scored.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {a["idx"]: a["name"].replace("__imp", "").replace("__ohe", "") for group in attrs.values() for a in group}
    imp = gbt_model.featureImportances.toArray()
    rows = sorted(((names.get(i, f"f{i}"), float(v)) for i, v in enumerate(imp)), key=lambda r: (-r[1], r[0]))
    spark = scored.sparkSession
    return spark.createDataFrame(rows[:top], "feature string, importance double")


# --- P29, P30 ---------------------------------------------------------------
def align_features(df: DataFrame, feature_types: list[tuple[str, str]]) -> DataFrame:
    """Exactly the model's feature columns, in order: missing -> typed NULL,
    extras dropped, text coerced to the stored numeric type."""
    cols = []
    for name, typ in feature_types:
        if name not in df.columns:
            cols.append(F.lit(None).cast(typ).alias(name))
        elif isinstance(df.schema[name].dataType, StringType) and typ not in ("string",):
            cols.append(numeric_text(name).cast(typ).alias(name))
        else:
            cols.append(F.col(name).cast(typ).alias(name))
    return df.select(*cols)


# --- M5, S8, S9, S11 ----------------------------------------------------------
@dataclass
class TrainedModel:
    model: PipelineModel
    feature_types: list
    metrics: dict
    settings: BoostSettings
    transform: str
    uses_te: bool


def train_te_model(features: DataFrame, settings: BoostSettings, validation_fraction: float = 0.1,
                   seed: int = 42, te_scope: str = "all", model_dir: str | None = None) -> TrainedModel:
    """Final target-encoded model: encoding from all rows (``te_scope='all'``,
    as the reference) or from the training split only; 90/10 split by key
    hash (``settings.validation_col="__val"`` stops early on it); validation MAE/RMSE; model, metadata and encoding table saved."""
    from ..operators.folds import holdout_flag

    df = holdout_flag(features.where(F.col("price").isNotNull()), validation_fraction, seed, flag_col="__val")
    fit_rows = df if te_scope == "all" else df.where(~F.col("__val"))
    mapping, mean = EN.fit_target_encoding(fit_rows, TE_CATEGORY_COLUMN, "price")
    df = EN.apply_target_encoding(df, TE_CATEGORY_COLUMN, mapping, mean, out=TE_OUTPUT_COLUMN)
    df = cut_lineage(with_label(df, "price", "log1p"))
    numeric, categorical = te_model_columns(df)
    # With early stopping the fit itself sets the validation rows apart.
    rows = df if settings.validation_col == "__val" else df.where(~F.col("__val"))
    model = build_pipeline(numeric, categorical, settings, "log1p", mode_fill=True).fit(rows)
    scored = model.transform(df.where(F.col("__val")))
    row = ME.error_metrics(scored, "price", PREDICTION).first()
    types = [(c, dict(df.dtypes)[c]) for c in numeric + categorical]
    trained = TrainedModel(model, types, {"MAE": round(row["mae"], 2), "RMSE": round(row["rmse"], 2),
                                          "validation_rows": row["n"]}, settings, "log1p", True)
    if model_dir:
        save_trained(trained, model_dir, te=(mapping, mean), spark=features.sparkSession)
    return trained


def save_trained(trained: TrainedModel, model_dir: str, te: tuple[DataFrame, DataFrame] | None = None,
                 spark: SparkSession | None = None) -> str:
    """Model (Spark ML persistence), encoding table and a 1-row metadata record."""
    trained.model.write().overwrite().save(os.path.join(model_dir, "model"))
    if te is not None:
        io.write_target_encoding(te[0], te[1], os.path.join(model_dir, "target_encoding"))
    meta = {
        "model_name": f"{'GBT' if trained.settings.algorithm == 'gbt' else 'Second-order boosting'} regressor ({trained.transform} target"
                      + (" + neighbourhood target encoding)" if trained.uses_te else ")"),
        "trained_on": datetime.date.today().isoformat(),
        "features": [n for n, _ in trained.feature_types],
        "feature_types": [f"{n}:{t}" for n, t in trained.feature_types],
        "metrics": json.dumps(trained.metrics),
        "settings": json.dumps(asdict(trained.settings)),
        "target_transform": trained.transform,
        "uses_target_encoding": trained.uses_te,
    }
    session = spark or (te[0].sparkSession if te else SparkSession.builder.getOrCreate())
    io.write_json_record(session.createDataFrame([meta]), os.path.join(model_dir, "metadata"))
    return model_dir


# --- M11 --------------------------------------------------------------------
@dataclass
class StoredModel:
    """A saved model opened once: pipeline, feature types, encoding table."""
    model: PipelineModel
    feature_types: list
    te: tuple[DataFrame, DataFrame] | None


def load_stored(spark: SparkSession, model_dir: str) -> StoredModel:
    meta = spark.read.json(os.path.join(model_dir, "metadata")).first()
    types = [tuple(ft.split(":", 1)) for ft in meta["feature_types"]]
    te = (io.read_target_encoding(spark, os.path.join(model_dir, "target_encoding"))
          if meta["uses_target_encoding"] else None)
    return StoredModel(PipelineModel.load(os.path.join(model_dir, "model")), types, te)


def score(df: DataFrame, model_dir: str | StoredModel, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """Batch scoring: stored encoding -> feature alignment -> model.  The
    inverse target transform is part of the stored pipeline; ``keep`` columns
    (ids) ride along.  Pass a ``StoredModel`` to score many batches with one load."""
    stored = model_dir if isinstance(model_dir, StoredModel) else load_stored(df.sparkSession, model_dir)
    if stored.te is not None and TE_OUTPUT_COLUMN not in df.columns and TE_CATEGORY_COLUMN in df.columns:
        mapping, mean = stored.te
        df = EN.apply_target_encoding(df, TE_CATEGORY_COLUMN, mapping, mean, out=TE_OUTPUT_COLUMN)
    names = {n for n, _ in stored.feature_types}
    extra = [(c, t) for c, t in df.dtypes if c in keep and c not in names]
    return stored.model.transform(align_features(df, stored.feature_types + extra))
