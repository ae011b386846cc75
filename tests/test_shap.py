"""Shapley values against their definition: averages over all orders of the features."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import functions as F
from test_trees import data

from lodestat.errors import LodestatError
from lodestat.ml import shap
from lodestat.ml.boosting import Booster, Boosting
from lodestat.ml.trees import Growth

FEATURES = ["a", "b", "c", "d"]


def frame(spark, x, y):
    rows = [(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "row_key long, f array<double>, label double").select("row_key", "label", array_to_vector("f").alias("features"))


def expected(tree, row, inside, k=0):
    """Mean output where features outside the coalition follow both branches by training rows."""
    f = tree.feature[k]
    if f < 0:
        return tree.value[k]
    a, b = tree.left[k], tree.right[k]
    if f in inside:
        left = tree.missing_left[k] if np.isnan(row[f]) else row[f] <= tree.threshold[k]
        return expected(tree, row, inside, a if left else b)
    share = tree.cover[a] / tree.cover[k]
    return (share * expected(tree, row, inside, a) if share else 0) + ((1 - share) * expected(tree, row, inside, b) if share < 1 else 0)


def exhaustive(value, m):
    out = [0.0] * m
    for order in itertools.permutations(range(m)):
        for k, f in enumerate(order):
            out[f] = out[f] + (value(set(order[: k + 1])) - value(set(order[:k]))) / math.factorial(m)
    return np.array(out)


def test_tree_values_equal_the_definition(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(300, 6)), 1)
    x[rng.random(x.shape) < 0.1] = np.nan
    z = np.nan_to_num(x)
    y = z[:, 0] * z[:, 1] + z[:, 2] * (z[:, 3] > 0) + z[:, 4] - z[:, 5] ** 2
    model = Booster("regression", 0, Boosting(rounds=2, growth=Growth(4, ridge=1.0))).fit(frame(spark, x, y))
    for rounds in model.rounds:
        phi, base = shap.tree_values(rounds[0], x[:8], 6)
        for i in range(8):
            want = exhaustive(lambda s: expected(rounds[0], x[i], s)[0], 6)  # noqa: B023
            assert np.allclose(phi[i, :, 0], want, atol=1e-10)
        assert np.isclose(base[0], expected(rounds[0], x[0], set())[0])


@pytest.mark.parametrize("style", ["newton", "ordered", "single"])
def test_values_sum_to_the_output(spark, style):
    x, y = data(400, classes=3)
    df = frame(spark, x, y)
    growth = Growth(4, ridge=0.0 if style == "single" else 1.0, least_rows=0 if style == "ordered" else 1, oblivious=style == "ordered")
    model = Booster("classification", 3, Boosting(style, 5, 0.3, growth)).fit(df)
    got = shap.tree_shap(df, model, FEATURES, ["row_key"], "largest").groupBy("row_key").agg(F.sum("phi").alias("phi"), F.first("base_value").alias("base"), F.first("output").alias("k")).collect()
    margin = model.margins(x)
    assert len(got) == 400
    for r in got:
        assert np.isclose(r.phi + r.base, margin[r.row_key, r.k]) and np.isclose(margin[r.row_key].max(), margin[r.row_key, r.k])


def test_mllib_trees(spark):
    x, y = data(300)
    x = np.nan_to_num(x)
    df = frame(spark, x, y)
    classes = df.withColumn("label", (F.col("label") > 0.3).cast("double"))
    for estimator, table, raw in (
        (GBTRegressor(maxIter=4, maxDepth=3), df, "prediction"),
        (GBTClassifier(maxIter=4, maxDepth=3), classes, "rawPrediction"),
        (RandomForestClassifier(numTrees=4, maxDepth=4, seed=1), classes, "probability"),
    ):
        model = estimator.fit(table)
        got = {r.row_key: r.s for r in shap.tree_shap(table, model, FEATURES, ["row_key"], 1 if raw == "probability" else 0).groupBy("row_key").agg((F.sum("phi") + F.first("base_value")).alias("s")).collect()}
        scored = model.transform(table)
        want = {r.row_key: (r.v if raw == "prediction" else (2 * r.v[1] if raw == "rawPrediction" else r.v[1])) for r in scored.select("row_key", (F.col(raw) if raw == "prediction" else vector_to_array(raw)).alias("v")).collect()}
        assert all(np.isclose(got[k], want[k]) for k in want), raw
    with pytest.raises(LodestatError):
        shap.trees_of(LinearRegression().fit(df))


@pytest.mark.parametrize("samples", [100, 10])
def test_kernel_values(spark, samples):
    x, _ = data(60)
    x = np.nan_to_num(x)
    df = frame(spark, x, np.zeros(60))
    v = vector_to_array("features")

    def score(table):
        return table.withColumn("output", F.get(v, F.lit(0)) * F.get(v, F.lit(1)) + F.exp(F.get(v, F.lit(2))) - F.get(v, F.lit(3)))

    def f(r):
        return r[0] * r[1] + np.exp(r[2]) - r[3]

    rows, sample = df.where("row_key < 4"), df.where("row_key >= 55")
    got = shap.kernel_shap(rows, sample, score, FEATURES, ["row_key"], samples).collect()
    for i in range(4):
        mine = {r.feature: r for r in got if r.row_key == i}

        def value(s, i=i):
            return np.mean([f([x[i, k] if k in s else d[k] for k in range(4)]) for d in x[55:]])

        phi = np.array([mine[n].phi for n in FEATURES])
        assert np.isclose(phi.sum(), f(x[i]) - value(set())) and np.isclose(mine["a"].base_value, value(set()))
        if samples == 100:
            assert np.allclose(phi, exhaustive(value, 4), atol=1e-9)
    one = shap.kernel_plan(1, 10)[1]
    assert np.allclose(one, [[-1, 1]])


def test_attributions_take_trees_first_and_the_kernel_otherwise(spark):
    from lodestat.ml import explain, train

    x, y = data(120, classes=3)
    z = np.nan_to_num(x)
    rows = [(i, *map(float, r), "pqr"[int(t)]) for i, (r, t) in enumerate(zip(z, y, strict=True))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y string")
    for name in ("decision_tree", "logistic"):
        model, ready = train.fit(df, "y", ["id"], name)
        some = ready.test.limit(3)
        got = explain.attributions(model, some, ready.train, ["row_key"], donors=5, samples=20)
        sums = {r.row_key: r.s for r in got.groupBy("row_key").agg((F.sum("phi") + F.first("base_value")).alias("s")).collect()}
        best = {r.row_key: max(r.probability) for r in model.predict(some).collect()}
        assert sums.keys() == best.keys() and all(np.isclose(sums[k], best[k]) for k in best)
