"""Second-order gradient boosting with regularised leaves, as a Spark ML stage.

Every level of a tree is one job: the rows' gradients are summed per (node,
feature, bin) with map-side partial sums, split gains come from running sums
over that table, and one row per node reaches the driver.  So no job returns,
or holds in a task, more than nodes x features x bins rows, whatever the data.

With soft(G) = sign(G) max(|G| - alpha, 0), a split's gain is soft(GL)^2 / (HL +
lambda) + soft(GR)^2 / (HR + lambda) - soft(G)^2 / (H + lambda).  It is made if
that is positive, at least ``gamma``, and both sides have a hessian of at least
``min_child_weight``; ties go to the first feature and the lowest cut.  A leaf
adds -soft(G) / (H + lambda) times the step.  Features are drawn per tree, rows
per tree by a hash of their number.

``absolute``: gradients are signs, the start is the median, and leaves are
refitted as medians of their residuals (times the step), all leaves of a tree
in one distributed selection.

With a validation column the error on its rows is taken after every tree, for a
block of trees in one pass.  Boosting ends when ``patience`` trees have brought
no better one, and the trees up to the best are kept.

A feature's cuts are all its values where it has at most ``max_bins``, else
approximate quantiles.  Rows with a NaN in a feature go right at its splits;
rows without a label are not used.
"""

from __future__ import annotations

import json
import math
import random
from dataclasses import asdict, dataclass

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasValidationIndicatorCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .quantiles import exact_quantiles_long

#: Gains below this are rounding, and gains that agree in so many decimals tie.
LEAST_GAIN, GAIN_DECIMALS = 1e-9, 9
QUANTILE_ACCURACY = 10_000
TREES = "array<struct<feature:array<int>,cut:array<double>,value:array<double>>>"


@dataclass(frozen=True)
class TreeSettings:
    trees: int = 100
    step: float = 0.3
    depth: int = 6
    alpha: float = 0.0
    lam: float = 1.0
    gamma: float = 0.0
    min_child_weight: float = 1.0
    rows: float = 1.0  # share of rows drawn per tree
    features: float = 1.0  # share of features drawn per tree
    objective: str = "squared"  # or "absolute"
    max_bins: int = 64
    patience: int | None = None  # with a validation column
    block: int = 10  # trees between two writes of the rows' state
    seed: int = 42


# --- trees ------------------------------------------------------------------------
# A tree is three lists in heap order: node i has the children 2 i + 1 and 2 i + 2.
def _trees(trees: list[dict], cut: str) -> Column:
    """The trees as one constant; ``cut``: which of their two forms of a cut to compare with."""
    return F.from_json(F.lit(json.dumps([{"feature": t["feature"], "cut": t[cut], "value": t["value"]} for t in trees])), TREES)


def _at(values: Column, place: Column) -> Column:
    return F.element_at(values, place + 1)


def _leaf(tree: Column, x: Column, depth: int) -> Column:
    """The node in which a row ends: right where its value is not below the cut."""
    def step(node, _):
        feature = _at(tree["feature"], node)
        right = F.when(_at(x, feature) < _at(tree["cut"], node), 0).otherwise(1)
        return F.when(feature < 0, node).otherwise(2 * node + 1 + right)

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step) if depth else F.lit(0)


def _outputs(trees: list[dict], x: Column, depth: int, cut: str) -> Column:
    """Every tree's output for a row."""
    return F.transform(_trees(trees, cut), lambda t: _at(t["value"], _leaf(t, x, depth)))


# --- cuts -------------------------------------------------------------------------
def feature_cuts(x: DataFrame, features: int, max_bins: int) -> list[list[float]]:
    """Per feature of the array column ``x`` the values that a split may compare with:
    all but the smallest where there are few, else quantiles.  Two aggregates of one row."""
    values = [F.when(~F.isnan(F.col("x")[i]), F.col("x")[i]) for i in range(features)]
    about = x.agg(*[F.approx_count_distinct(v).alias(f"n{i}") for i, v in enumerate(values)]).first()
    probs = [k / max_bins for k in range(max_bins + 1)]
    found = x.agg(*[(F.collect_set(v) if about[f"n{i}"] <= max_bins else F.percentile_approx(v, probs, QUANTILE_ACCURACY)).alias(f"c{i}")
                    for i, v in enumerate(values)]).first()
    return [sorted(set(found[f"c{i}"] or []))[1:] for i in range(features)]


def _bins(cuts: list[list[float]]) -> Column:
    """Per feature the number of cuts that a value reaches (NaN: all)."""
    edges = F.from_json(F.lit(json.dumps(cuts)), "array<array<double>>")
    return F.zip_with(F.col("x"), edges, lambda v, own: F.size(F.filter(own, lambda c: v >= c)))


# --- growing ----------------------------------------------------------------------
def _soft(g: Column | float, alpha: float):
    if isinstance(g, Column):
        return F.signum(g) * F.greatest(F.abs(g) - alpha, F.lit(0.0))
    return math.copysign(max(abs(g) - alpha, 0.0), g)


def feature_rows(rows: DataFrame, features: list[int]) -> DataFrame:
    """(node, g, f, b) per row and feature.  All bins are passed over, in generated code: that
    costs less than an array of the wanted ones built for every row."""
    return rows.select("node", "g", F.posexplode("bins").alias("f", "b")).where(F.col("f").isin(features))


def best_splits(rows: DataFrame, features: list[int], s: TreeSettings) -> dict[int, dict]:
    """node -> its best split and totals, from rows (node, g, bins) with a hessian of one each."""
    table = feature_rows(rows, features).groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.count(F.lit(1)).cast("double").alias("h"))
    line = Window.partitionBy("node", "f")
    lower = line.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumns({"gl": F.sum("g").over(lower), "hl": F.sum("h").over(lower), "gt": F.sum("g").over(line), "ht": F.sum("h").over(line)})
    part = lambda g, h: F.pow(_soft(g, s.alpha), 2) / (h + s.lam)
    gl, hl, gt, ht = (F.col(c) for c in ("gl", "hl", "gt", "ht"))
    gain = F.round(part(gl, hl) + part(gt - gl, ht - hl) - part(gt, ht), GAIN_DECIMALS)
    allowed = (hl >= s.min_child_weight) & (ht - hl >= s.min_child_weight) & (gain > LEAST_GAIN) & (gain >= s.gamma)
    split = F.when(allowed, F.struct(gain.alias("gain"), (-F.col("f")).alias("f"), (-F.col("b")).alias("b"), "gl", "hl"))
    best = table.groupBy("node").agg(F.max(split).alias("split"), F.max_by("gt", -F.col("f")).alias("g"), F.max("ht").alias("h"))
    return {r["node"]: {"g": r["g"], "h": r["h"], "split": r["split"]} for r in best.collect()}


def grow(state: DataFrame, earlier: list[dict], cuts: list[list[float]], features: list[int], number: int, s: TreeSettings) -> dict:
    """One tree on the rows of ``state`` (row, y, held, bins, margin) after the ``earlier`` trees of its block."""
    margin = F.col("margin")
    if earlier:
        margin = margin + F.aggregate(_outputs(earlier, F.col("bins"), s.depth, "bin"), F.lit(0.0), lambda a, v: a + v)
    rows = state.where(~F.col("held"))
    if s.rows < 1:
        rows = rows.where(F.pmod(F.xxhash64("row", F.lit(number), F.lit(s.seed)), F.lit(1 << 20)) < int(s.rows * (1 << 20)))
    rows = rows.select("bins", (margin - F.col("y")).alias("residual"))
    rows = rows.withColumn("g", F.signum("residual") if s.objective == "absolute" else F.col("residual"))
    size = 2 ** (s.depth + 1) - 1
    tree = {"feature": [-1] * size, "bin": [0.0] * size, "cut": [0.0] * size, "value": [0.0] * size, "gain": [0.0] * size}
    totals, active, leaves = {}, [0], []
    for level in range(s.depth):
        node = _leaf(_trees([tree], "bin")[0], F.col("bins"), level)
        placed = rows.select(node.alias("node"), "g", "bins").where(F.col("node") >= 2 ** level - 1)  # not in a leaf
        found, following = best_splits(placed, features, s), []
        for i in active:
            got = found.get(i)
            if got is None:  # no row at all: a table without rows
                leaves.append(i)
                continue
            totals[i] = got["g"], got["h"]
            if got["split"] is None:
                leaves.append(i)
                continue
            feature, b = -got["split"]["f"], -got["split"]["b"]
            tree["feature"][i], tree["bin"][i], tree["cut"][i], tree["gain"][i] = feature, float(b), cuts[feature][b - 1], got["split"]["gain"]
            totals[2 * i + 1] = got["split"]["gl"], got["split"]["hl"]
            totals[2 * i + 2] = got["g"] - got["split"]["gl"], got["h"] - got["split"]["hl"]
            following += [2 * i + 1, 2 * i + 2]
        active = following
        if not active:
            break
    leaves += active
    if s.objective == "absolute":
        ends = rows.select(_leaf(_trees([tree], "bin")[0], F.col("bins"), s.depth).alias("c"), (-F.col("residual")).alias("v"))
        medians = exact_quantiles_long(ends, {i: [0.5] for i in leaves})
        values = {i: medians[i][0] or 0.0 for i in leaves}
    else:
        values = {i: -_soft(totals[i][0], s.alpha) / (totals[i][1] + s.lam) if i in totals else 0.0 for i in leaves}
    for i in leaves:
        tree["value"][i] = s.step * values[i]
    return tree


def validation_errors(state: DataFrame, trees: list[dict], s: TreeSettings) -> list[float]:
    """The error on the held-out rows after each of ``trees``: running sums of their outputs, one pass."""
    outputs = _outputs(trees, F.col("bins"), s.depth, "bin")
    margins = F.aggregate(outputs, F.array(F.col("margin")), lambda all_, v: F.array_append(all_, F.element_at(all_, -1) + v))
    error = F.col("m") - F.col("y")
    held = state.where("held").select("y", F.posexplode(margins).alias("n", "m")).where("n > 0")
    mean = F.avg(F.abs(error)) if s.objective == "absolute" else F.sqrt(F.avg(error * error))
    found = {r["n"]: r["e"] for r in held.groupBy("n").agg(mean.alias("e")).collect()}
    return [found[n] for n in range(1, len(trees) + 1)] if found else []


def boost(df: DataFrame, s: TreeSettings) -> dict:
    """Fit on rows (x array, y, held): the start value, the trees and the validation errors."""
    df = cut_lineage(df.where(F.col("y").isNotNull() & ~F.isnan("y")))
    first = df.select(F.size("x").alias("n")).first()
    if first is None:
        return {"start": 0.0, "trees": [], "errors": [], "best": 0, "n_features": 0, "depth": s.depth}
    n = first["n"]
    fit_rows = df.where(~F.col("held"))
    cuts = feature_cuts(fit_rows, n, s.max_bins)
    if s.objective == "absolute":
        start = exact_quantiles_long(fit_rows.select(F.lit(0).alias("c"), F.col("y").alias("v")), {0: [0.5]})[0][0]
    else:
        start = fit_rows.agg(F.avg("y")).first()[0]
    start = start or 0.0
    state = cut_lineage(df.select(F.monotonically_increasing_id().alias("row"), "y", "held", _bins(cuts).alias("bins"),
                                  F.lit(start).cast("double").alias("margin")))
    usable = [i for i in range(n) if cuts[i]]
    trees, errors, best = [], [], 0
    while len(trees) < s.trees and usable:
        block: list[dict] = []
        for number in range(len(trees), min(len(trees) + s.block, s.trees)):
            drawn = random.Random(s.seed * 1_000_003 + number).sample(usable, max(1, int(s.features * len(usable))))
            block.append(grow(state, block, cuts, sorted(drawn), number, s))
        if s.patience is not None:
            errors += validation_errors(state, block, s)
        trees += block
        if errors:
            best = min(range(len(errors)), key=lambda i: errors[i])
            if len(errors) - 1 - best >= s.patience:
                break
        if len(trees) < s.trees:
            added = F.aggregate(_outputs(block, F.col("bins"), s.depth, "bin"), F.lit(0.0), lambda a, v: a + v)
            state = cut_lineage(state.withColumn("margin", F.col("margin") + added))
    if errors:
        errors, best = _until_patience(errors, s.patience)
        trees = trees[:best + 1]
    return {"start": start, "trees": trees, "errors": errors, "best": best, "n_features": n, "depth": s.depth}


def _until_patience(errors: list[float], patience: int) -> tuple[list[float], int]:
    """The errors up to where tree-by-tree boosting would have ended, and the best of them."""
    best = 0
    for i, error in enumerate(errors):
        if error < errors[best]:
            best = i
        elif i - best >= patience:
            return errors[:i + 1], best
    return errors, best


# --- Spark ML stage ---------------------------------------------------------------
class _BoosterColumns(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasValidationIndicatorCol):
    pass


class RegularisedBooster(Estimator, _BoosterColumns, DefaultParamsReadable, DefaultParamsWritable):
    settings = Param(Params._dummy(), "settings", "JSON of TreeSettings", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction",
                 validationIndicatorCol=None, settings=None):
        super().__init__()
        self._setDefault(settings=json.dumps(asdict(TreeSettings())))
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "RegularisedBoosterModel":
        held = F.lit(False)
        if self.isDefined(self.validationIndicatorCol):
            held = F.coalesce(F.col(self.getValidationIndicatorCol()), F.lit(False))
        rows = df.select(vector_to_array(F.col(self.getFeaturesCol())).alias("x"),
                         F.col(self.getLabelCol()).cast("double").alias("y"), held.alias("held"))
        fitted = boost(rows, TreeSettings(**json.loads(self.getOrDefault(self.settings))))
        return RegularisedBoosterModel(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol(), fitted=json.dumps(fitted))


class RegularisedBoosterModel(Model, _BoosterColumns, DefaultParamsReadable, DefaultParamsWritable):
    fitted = Param(Params._dummy(), "fitted", "JSON: start, trees, validation errors", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, featuresCol="features", predictionCol="prediction", fitted=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fitted(self) -> dict:
        return json.loads(self.getOrDefault(self.fitted))

    def _transform(self, df: DataFrame) -> DataFrame:
        model = self._fitted()
        x, out = F.col("__x"), F.lit(model["start"]).cast("double")
        if model["trees"]:
            out = F.aggregate(_outputs(model["trees"], x, model["depth"], "cut"), out, lambda a, v: a + v)
        return (df.withColumn("__x", vector_to_array(F.col(self.getFeaturesCol())))
                .withColumn(self.getPredictionCol(), out).drop("__x"))

    @property
    def getNumTrees(self) -> int:
        return len(self._fitted()["trees"])

    @property
    def validationErrors(self) -> list[float]:
        """The error after every tree tried; the trees kept end at the smallest."""
        return self._fitted()["errors"]

    @property
    def featureImportances(self) -> DenseVector:
        """Mean gain of each feature's splits, as shares of one."""
        model = self._fitted()
        gains: dict[int, list[float]] = {}
        for tree in model["trees"]:
            for feature, gain in zip(tree["feature"], tree["gain"], strict=True):
                if feature >= 0:
                    gains.setdefault(feature, []).append(gain)
        means = [sum(gains[i]) / len(gains[i]) if i in gains else 0.0 for i in range(model["n_features"])]
        return DenseVector([m / sum(means) if sum(means) else 0.0 for m in means])
