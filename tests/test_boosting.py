"""Second-order boosting against the same trees grown by plain loops over numpy arrays."""

import json
from dataclasses import asdict

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from rentalytics.operators.boosting import RegularisedBooster, RegularisedBoosterModel, TreeSettings, _until_patience


def soft(g, alpha):
    return np.sign(g) * max(abs(g) - alpha, 0)


def brute_tree(x, g, s, residual):
    """(predict function, splits): every cut between two values of every feature."""
    def gain_of(g_sum, h):
        return soft(g_sum, s.alpha) ** 2 / (h + s.lam)

    def build(rows, depth):
        best = None
        if depth < s.depth:
            for f in range(x.shape[1]):
                for cut in sorted(set(x[rows, f]))[1:]:
                    left = rows & (x[:, f] < cut)
                    hl, hr = left.sum(), rows.sum() - left.sum()
                    gain = round(gain_of(g[left].sum(), hl) + gain_of(g[rows].sum() - g[left].sum(), hr) - gain_of(g[rows].sum(), rows.sum()), 9)
                    if min(hl, hr) >= s.min_child_weight and gain > 1e-9 and gain >= s.gamma and (best is None or gain > best[0]):
                        best = gain, f, cut
        if best is None:
            value = np.median(residual[rows]) if s.objective == "absolute" else -soft(g[rows].sum(), s.alpha) / (rows.sum() + s.lam)
            return s.step * value
        _, f, cut = best
        return f, cut, build(rows & (x[:, f] < cut), depth + 1), build(rows & (x[:, f] >= cut), depth + 1)

    return build(np.ones(len(x), bool), 0)


def outputs(node, x):
    if not isinstance(node, tuple):
        return np.full(len(x), node)
    f, cut, left, right = node
    return np.where(x[:, f] < cut, outputs(left, x), outputs(right, x))


def brute(x, y, held, s):
    """Predictions of every prefix of the trees."""
    fit = ~held
    start = np.median(y[fit]) if s.objective == "absolute" else y[fit].mean()
    margins = [np.full(len(y), start)]
    for _ in range(s.trees):
        residual = y - margins[-1]
        g = -np.sign(residual) if s.objective == "absolute" else -residual
        margins.append(margins[-1] + outputs(brute_tree(x[fit], g[fit], s, residual[fit]), x))
    return margins


def table(spark, n=150, seed=0):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 2, n), rng.integers(0, 5, n), rng.integers(-4, 4, n) / 2, np.ones(n)], 1).astype(float)
    y = np.round(x[:, 0] * 2 + x[:, 1] * x[:, 2] + rng.normal(size=n), 3)
    held = rng.random(n) < 0.3
    rows = [(i, Vectors.dense(v), float(t), bool(h)) for i, (v, t, h) in enumerate(zip(x, y, held))]
    return x, y, held, spark.createDataFrame(rows, ["i", "features", "label", "held"]).repartition(3)


def fit(df, s, validation=False):
    return RegularisedBooster(settings=json.dumps(asdict(s)), validationIndicatorCol="held" if validation else None).fit(df)


def predicted(model, df):
    return np.array([r.prediction for r in sorted(model.transform(df).collect(), key=lambda r: r.i)])


@pytest.mark.parametrize("s", [
    TreeSettings(trees=2, depth=2, step=0.5, lam=0.0),
    TreeSettings(trees=2, depth=2, step=0.3, lam=2.0, alpha=4.0, gamma=3.0, min_child_weight=8, block=1),
    TreeSettings(trees=2, depth=2, step=0.7, objective="absolute"),
], ids=["plain", "penalised", "absolute"])
def test_predictions_equal_brute_force(spark, s):
    x, y, held, df = table(spark)
    assert np.allclose(predicted(fit(df, s), df), brute(x, y, np.zeros(len(y), bool), s)[-1], atol=1e-9)


def test_patience_keeps_the_best_trees(spark, tmp_path):
    x, y, held, df = table(spark, n=80, seed=3)
    s = TreeSettings(trees=6, depth=1, step=1.5, lam=0.0, patience=2, block=3)
    margins = brute(x, y, held, s)[1:]
    errors = [float(np.sqrt(np.mean((y - m)[held] ** 2))) for m in margins]
    kept, best = _until_patience(errors, 2)
    model = fit(df, s, validation=True)
    assert np.allclose(model.validationErrors, kept) and model.getNumTrees == best + 1
    assert np.allclose(predicted(model, df), margins[best], atol=1e-9)
    model.write().overwrite().save(str(tmp_path / "m"))
    assert np.allclose(predicted(RegularisedBoosterModel.load(str(tmp_path / "m")), df), margins[best], atol=1e-9)


def test_until_patience():
    assert _until_patience([3.0, 2.0, 2.5, 2.2, 1.0], 2) == ([3.0, 2.0, 2.5, 2.2], 1)
    assert _until_patience([3.0, 2.0, 2.5, 1.0, 1.0], 2) == ([3.0, 2.0, 2.5, 1.0, 1.0], 3)


def test_drawn_rows_and_features_and_odd_tables(spark):
    x, y, held, df = table(spark)
    s = TreeSettings(trees=2, depth=2, rows=0.6, features=0.7)
    one, other = fit(df, s), fit(df, s)
    assert one._fitted() == other._fitted() and np.mean((predicted(one, df) - y) ** 2) < y.var()
    assert abs(sum(one.featureImportances) - 1) < 1e-9 and one.featureImportances[3] == 0
    gap = spark.createDataFrame(
        [(0, Vectors.dense([float("nan"), 1.0]), 1.0), (1, Vectors.dense([2.0, 1.0]), 3.0), (2, Vectors.dense([3.0, 1.0]), 3.0)],
        ["i", "features", "label"])
    assert len(predicted(fit(gap, TreeSettings(trees=1, depth=1)), gap)) == 3
    none = fit(df.limit(0), TreeSettings(trees=1))
    assert none.getNumTrees == 0 and none.transform(df).count() == len(y)
    constant = spark.createDataFrame([(i, Vectors.dense([1.0]), float(i)) for i in range(5)], ["i", "features", "label"])
    assert predicted(fit(constant, TreeSettings(trees=3)), constant).tolist() == [2.0] * 5


def test_rows_of_the_wanted_features_come_from_generated_code(spark, capsys):
    from rentalytics.operators.boosting import feature_rows

    rows = spark.createDataFrame([(0, 1.5, [3, 4, 5]), (2, -1.0, [6, 7, 8])], "node int, g double, bins array<int>")
    found = feature_rows(rows, [0, 2])
    assert sorted(map(tuple, found.collect())) == [(0, 1.5, 0, 3), (0, 1.5, 2, 5), (2, -1.0, 0, 6), (2, -1.0, 2, 8)]
    capsys.readouterr()
    found.explain()
    plan = capsys.readouterr().out
    assert "posexplode" in plan and "lambdafunction" not in plan
