"""Properties that hold for any data, and agreement of the large-table paths with the simple ones."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestat.ml.explain import linear_shap
from lodestat.operators import charts, clean, evaluate, neighbors, ordered, stats
from lodestat.operators.fitting import attach_codes, fit_codes
from lodestat.operators.neighbors import nearest
from lodestat.operators.quantiles import exact_quantiles

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
NUMBERS = st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6)), min_size=4, max_size=40).filter(lambda v: any(x is not None for x in v))


def table(spark, numbers):
    return spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "k int, x double")


@FEW
@given(NUMBERS)
def test_quantile_paths_agree_with_numpy(spark, numbers):
    df = table(spark, numbers)
    present = [x for x in numbers if x is not None]
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, ["x"], probs, small_column=1, accuracy=20)["x"]
    assert np.allclose(got, np.quantile(present, probs), rtol=1e-12, atol=1e-9)


@pytest.mark.parametrize("shape", ["hot", "spread", "skewed", "constant"])
def test_quantiles_of_large_columns(spark, shape):
    x = {
        "hot": F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") * 0.37 % 100),
        "spread": (F.col("id") * 7919 % 100003).cast("double"),
        "skewed": F.exp(F.col("id") % 1000 / 40.0),
        "constant": F.lit(2.5),
    }[shape]
    df = spark.range(200_000).select(x.alias("x"))
    probs = [0.001, 0.25, 0.5, 0.75, 0.999]
    got = exact_quantiles(df, ["x"], probs, small_column=1000, accuracy=100)["x"]
    want = np.quantile(df.toPandas()["x"], probs)
    assert np.allclose(got, want, rtol=1e-12)


@FEW
@given(NUMBERS)
def test_clean_properties(spark, numbers):
    df = table(spark, numbers)
    present = [x for x in numbers if x is not None]
    q1, q3 = np.quantile(present, [0.25, 0.75])
    clipped = [r["x"] for r in clean.clip_outliers(df, "x").collect() if r["x"] is not None]
    assert min(clipped) >= q1 - 1.5 * (q3 - q1) - 1e-6 and max(clipped) <= q3 + 1.5 * (q3 - q1) + 1e-6
    scaled = [r["x"] for r in clean.scale(df, "x", "minmax").collect() if r["x"] is not None]
    assert all(-1e-9 <= x <= 1 + 1e-9 for x in scaled)
    bins = [r["x_binned"] for r in clean.bin_equal_width(df, ["x"], 7).collect() if r["x_binned"] is not None]
    assert len(bins) == len(present) and set(bins) <= set(range(7))
    assert charts.histogram(df, ["x"]).agg(F.sum("count")).first()[0] == len(present)


def test_standard_scaling(spark):
    df = spark.range(1000).select((F.col("id") % 37).cast("double").alias("x"))
    row = clean.scale(df, "x", "standard").agg(F.avg("x"), F.stddev_pop("x")).first()
    assert abs(row[0]) < 1e-9 and abs(row[1] - 1) < 1e-9


def test_running_paths_agree(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 5003).alias("o"), (F.col("id") % 11).alias("v"))
    for keys in ([], ["g"]):
        def run(limit):
            out = ordered.running(df, keys, [F.col("o")], {"s": "v"}, "rn", {"nx": "v"}, max_group_rows=limit)
            return sorted(out.select("g", "o", "v", "s", "rn", F.coalesce("nx", F.lit(-1)).alias("nx")).collect())

        assert run(10**9) == run(10)


def test_carry_paths_agree(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), F.col("id").alias("o"), F.when(F.col("id") % 50 == 7, F.col("id")).alias("v"))
    for backward in (False, True):
        a, b = (
            sorted(
                ordered.carry_value(df, "v", ["g"], ["o"], backward, limit).select("o", F.coalesce("v", F.lit(-1)).alias("v")).collect()
            )
            for limit in (10**9, 10)
        )
        assert a == b


def test_label_code_paths_agree(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 700)).alias("s"))
    short = attach_codes(df, "s", fit_codes(df, "s"), "s")
    fitted = fit_codes(df, "s", broadcast_classes=10)
    assert [v for v, _ in fitted["hot"]] == ["hot"]
    assert sorted(short.collect()) == sorted(attach_codes(df, "s", fitted, "s").collect())


def test_duplicates_with_hot_copies(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.lit("text").alias("s"))
    assert stats.duplicate_count(df) == 999


def test_auc_of_reversed_scores(spark):
    df = spark.range(2000).select((F.col("id") * 31 % 7 < 3).cast("int").alias("label"), (F.col("id") * 17 % 101).cast("double").alias("score"))
    a = evaluate.auc(df).first()["auc"]
    b = evaluate.auc(df.withColumn("score", 1 - F.col("score")), max_group_rows=5).first()["auc"]
    assert abs(a + b - 1) < 1e-12
    whole = evaluate.roc_curve(df, 1).collect()
    assert (0.0, 0.0) in [tuple(r) for r in whole] and (1.0, 1.0) in [tuple(r) for r in whole]


def test_auc_equals_mllib(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    df = spark.range(3000).select((F.col("id") * 31 % 7 < 3).cast("double").alias("label"), (F.col("id") * F.col("id") % 997).cast("double").alias("score"))
    judge = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0)
    assert abs(judge.evaluate(df) - evaluate.auc(df).first()["auc"]) < 1e-9


def test_confusion_total(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("label"), (F.col("id") % 4).alias("prediction"))
    cells = evaluate.confusion_cells(df)
    assert cells.agg(F.sum("count")).first()[0] == 1000
    wide = evaluate.confusion_matrix(df, [0, 1, 2, 3])
    assert wide.select(sum(F.col(f"`{c}`") for c in "0123").alias("n")).agg(F.sum("n")).first()[0] == 1000


def test_linear_attributions_add_up(spark):
    df = spark.range(50).select("id", (F.col("id") * 1.5).alias("a"), (F.col("id") % 7).alias("b"))
    w = {"a": 2.0, "b": -3.0}
    f = df.withColumn("f", 2.0 * F.col("a") - 3.0 * F.col("b"))
    base = f.agg(F.avg("f")).first()[0]
    sums = linear_shap(df, w, ["id"]).groupBy("id").agg(F.sum("phi").alias("phi")).join(f, "id")
    assert sums.where(F.abs(F.col("phi") + base - F.col("f")) > 1e-9).count() == 0


def test_neighbors_against_brute_force_with_hot_copies(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(600, 5))
    points[::3] = points[0]  # a third of all rows are copies
    train = spark.createDataFrame([(i, p.tolist(), float(i % 4)) for i, p in enumerate(points)], "train_key bigint, x array<double>, label double")
    asked = np.concatenate([rng.normal(size=(60, 5)), points[:3]])
    test = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(asked)], "test_key bigint, x array<double>")
    got = nearest(test, train, 4, pivots=9, block_rows=50).toPandas().sort_values(["test_key", "rank"])
    dist = np.sqrt(((asked[:, None] - points[None]) ** 2).sum(-1))
    for i in range(len(asked)):
        order = sorted(range(len(points)), key=lambda j: (dist[i, j], j))[:4]
        assert got[got.test_key == i]["train_key"].tolist() == order


def _blocks_compared(spark, monkeypatch, test, train, k, **sizes):
    """The result of ``nearest``, the blocks and the pairs of rows that its tasks compared."""
    blocks, pairs, inner = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), neighbors._block_neighbors(k)

    def counted(k):
        def run(test, train):
            blocks.add(1)
            pairs.add(len(test) * len(train))
            return inner(test, train)

        return run

    monkeypatch.setattr(neighbors, "_block_neighbors", counted)
    got = nearest(test, train, k, **sizes).toPandas().sort_values(["test_key", "rank"])
    return got, blocks.value, pairs.value


def test_equal_vectors_are_compared_once(spark, monkeypatch):
    train = spark.range(4000).selectExpr("id AS train_key", "array(double(id % 8)) AS x", "double(id % 3) AS label")
    test = spark.range(1000).selectExpr("id AS test_key", "array(double(id % 8) + 0.25) AS x")
    got, _, pairs = _blocks_compared(spark, monkeypatch, test, train, 5)
    assert pairs <= 8 * 8 * 5
    assert len(got) == 5000 and (got["distance"] == 0.25).all()
    assert (got["train_key"] == got["test_key"] % 8 + 8 * (got["rank"] - 1)).all()
    assert (got["label"] == got["train_key"] % 3).all()


def test_blocks_grow_with_the_table(spark, monkeypatch):
    rng = np.random.default_rng(5)
    points, asked = rng.normal(size=(3000, 8)), rng.normal(size=(800, 8))
    train = spark.createDataFrame([(i, p.tolist(), 0.0) for i, p in enumerate(points)], "train_key bigint, x array<double>, label double")
    test = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(asked)], "test_key bigint, x array<double>")
    got, blocks, _ = _blocks_compared(spark, monkeypatch, test, train, 3, pivots=16, block_rows=20)
    assert blocks <= 2 * 16**2
    dist = np.sqrt(((asked[:, None] - points[None]) ** 2).sum(-1))
    assert got["train_key"].tolist() == np.argsort(dist, axis=1, kind="stable")[:, :3].ravel().tolist()


def test_neighbors_of_repeated_keys_far_from_the_origin(spark):
    rng = np.random.default_rng(6)
    points = 1e6 + rng.normal(size=(500, 3))
    train = spark.createDataFrame([(i // 2, p.tolist(), float(i)) for i, p in enumerate(points)], "train_key bigint, x array<double>, label double")
    train = train.union(spark.createDataFrame([(1000, [float("nan"), 1.0, 2.0], 0.0)], train.schema))
    test = spark.createDataFrame([(i // 2, p.tolist()) for i, p in enumerate(points[:20])], "test_key bigint, x array<double>")
    got = nearest(test, train, 3, pivots=4, block_rows=40).toPandas().sort_values(["test_key", "rank"])
    dist = np.sqrt(((points[:20, None] - points[None]) ** 2).sum(-1))
    for key in range(10):
        # both rows of a key are searched, and the nearest rows of both are ranked together
        near = sorted((dist[i, j], j // 2, j) for i in (2 * key, 2 * key + 1) for j in range(500))[:3]
        assert got[got.test_key == key]["distance"].tolist() == [d for d, _, _ in near]


def test_groups_of_keys_keep_large_tables_exact(spark):
    rng = np.random.default_rng(7)
    points, asked = rng.normal(size=20_000), rng.normal(size=50)
    train = spark.createDataFrame(pd.DataFrame({"train_key": np.arange(20_000), "x": [[v] for v in points], "label": points}), "train_key bigint, x array<double>, label double")
    test = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate(asked)], "test_key bigint, x array<double>")
    got = nearest(test, train, 5).toPandas().sort_values(["test_key", "rank"])
    want = np.argsort(np.abs(asked[:, None] - points[None]), axis=1, kind="stable")[:, :5]
    assert got["train_key"].tolist() == want.ravel().tolist()
