"""Models recover known structure; saved, streamed and searched models behave."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from lodestat import errors
from lodestat.ml import explain, margins, models, train
from lodestat.plans.recipe import fit_recipe
from lodestat.sources import readers, sinks
from lodestat.sources.readers import read_table
from lodestat.streaming.apply import clean_stream, score_stream, write_available


@pytest.fixture(scope="module")
def linear_rows(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 3))
    y = x @ np.array([3.0, -2.0, 0.5]) + 4 + rng.normal(size=400) * 0.3
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id bigint, a double, b double, c double, y double"), x, y


def vectors(df):
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).withColumn("label", F.col("y"))


def test_ridge_matches_the_closed_form(linear_rows):
    df, x, y = linear_rows
    ready = vectors(df)
    model = models.build("ridge", "regression", models.training_facts(ready, "regression"), alpha=5.0).fit(ready)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 5.0 * np.eye(3), xc.T @ yc)
    assert np.allclose(model.coefficients.toArray(), want, atol=1e-6)


@pytest.mark.parametrize("l1", [1.0, 0.5])
def test_lasso_and_elasticnet_match_coordinate_descent(linear_rows, l1):
    df, x, y = linear_rows
    ready = vectors(df)
    name = "lasso" if l1 == 1.0 else "elasticnet"
    model = models.build(name, "regression", models.training_facts(ready, "regression"), alpha=0.4).fit(ready)
    xc, yc, n = x - x.mean(0), y - y.mean(), len(y)
    w = np.zeros(3)
    for _ in range(500):
        for j in range(3):
            r = yc - xc @ w + xc[:, j] * w[j]
            c = xc[:, j] @ r / n
            w[j] = np.sign(c) * max(abs(c) - 0.4 * l1, 0) / (xc[:, j] @ xc[:, j] / n + 0.4 * (1 - l1))
    assert np.allclose(model.coefficients.toArray(), w, atol=1e-4)


def test_train_all_ranks_and_skips_failures(linear_rows):
    df, _, _ = linear_rows
    run = train.train_all(df, "y", ["id"], ["linear", "knn", "svc"], folds=2)
    assert run.problem == "regression"
    assert [r["name"] for r in run.results] == ["linear", "knn"]
    assert run.results[0]["test_score"] > 0.95
    assert dict(train.importances(run.best)).keys() == {"a", "b", "c"}
    with pytest.raises(errors.NoModelTrained):
        train.train_all(df, "y", ["id"], ["svc"], folds=2)


def test_search_draws_from_the_grid():
    assert len(train.search_settings("random_forest")) == 8
    assert train.search_settings("random_forest") == train.search_settings("random_forest")
    assert len(train.search_settings("ridge")) == 5
    assert train.search_settings("naive_bayes") == []


def test_saved_model_scores_the_same(spark, linear_rows, tmp_path):
    df, _, _ = linear_rows
    for name in ("decision_tree", "knn"):
        model, _ = train.fit(df, "y", ["id"], name)
        sinks.save_trained(model, str(tmp_path / name))
        again = sinks.load_trained(str(tmp_path / name))
        a, b = (sorted(train.score(m, df, ["id"]).select("id", "prediction").collect()) for m in (model, again))
        assert a == b


def test_kernel_machine_learns_a_ring(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2))
    rows = [(i, float(a), float(b), "in" if a * a + b * b < 1.2 else "out") for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, side string")
    run = train.train_all(df, "side", ["id"], ["svc"], folds=2)
    assert run.results[0]["test_score"] > 0.9
    scored = train.score(run.best, df, ["id"])
    assert set(scored.columns) == {"id", "a", "b", "side", "prediction", "prediction_confidence", "probabilities"}
    found = scored.collect()
    assert {r["prediction"] for r in found} == {"in", "out"}
    assert all(abs(sum(r["probabilities"]) - 1) < 1e-9 and max(r["probabilities"]) == r["prediction_confidence"] for r in found)


def test_scoring_fills_absent_and_missing_features(spark, linear_rows):
    df, _, _ = linear_rows
    model, _ = train.fit(df, "y", ["id"], "linear")
    out = train.score(model, spark.createDataFrame([(1, None, 2.0)], "id bigint, a double, extra double"), ["id"]).first()
    assert out["a"] is None and out["extra"] == 2.0 and out["prediction"] is not None


def test_sampled_attributions_add_up(linear_rows):
    df, _, _ = linear_rows
    model, ready = train.fit(df, "y", ["id"], "linear")
    rows, sample = explain.background(ready.train, 10, ["row_key"]), explain.background(ready.train, 20, ["row_key"], "other")
    phis = explain.sampled_shap(
        rows, sample, lambda t: model.predict(t).withColumn("output", F.col("prediction")), model.feature_names, ["row_key"], permutations=8
    )
    sums = phis.groupBy("row_key").agg(F.sum("phi").alias("phi"), F.first("base_value").alias("base"))
    both = sums.join(model.predict(rows).select("row_key", "prediction"), "row_key")
    assert both.count() == 10
    assert both.where(F.abs(F.col("phi") + F.col("base") - F.col("prediction")) > 1e-6).count() == 0


def test_streamed_cleaning_and_scoring_equal_batch(spark, data, tmp_path, linear_rows):
    events = read_table(spark, data, "events")
    fitted = fit_recipe(events, [{"op": "log", "columns": ["value"]}, {"op": "scale", "column": "value", "method": "standard"}])
    folder = str(tmp_path / "in")
    events.repartition(3).write.parquet(folder)
    stream = spark.readStream.schema(events.schema).parquet(folder)
    query = write_available(clean_stream(stream, fitted), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("event_id", "value", "value_log")
    assert sorted(got.collect()) == sorted(fitted.transform(events).select("event_id", "value", "value_log").collect())

    df, _, _ = linear_rows
    model, _ = train.fit(df, "y", ["id"], "linear")
    df.write.parquet(str(tmp_path / "rows"))
    scored = score_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "rows")), model, ["id"])
    write_available(scored, str(tmp_path / "scored"), str(tmp_path / "state2")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "scored")).select("id", "prediction")
    assert sorted(got.collect()) == sorted(train.score(model, df, ["id"]).select("id", "prediction").collect())


def test_csv_reader(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text("name,age,city,flag\nJohn,25,NYC,True\nJane,NA,LA,False\n\"Bob, Jr\",35.5,,True\n")
    df = readers.read_csv(spark, str(folder))
    assert dict(df.dtypes) == {"name": "string", "age": "double", "city": "string", "flag": "boolean"}
    assert [r["city"] for r in df.collect()] == ["NYC", "LA", None]
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(errors.EmptySource):
        readers.read_csv(spark, str(tmp_path / "empty.csv"))
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n1,2,3\n")
    with pytest.raises(Exception, match="MALFORMED"):
        readers.read_csv(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "rows.json").write_text('[{"a": 1, "b": "x"}, {"a": 2, "b": null}]')
    assert readers.read_json(spark, str(tmp_path / "rows.json")).count() == 2


def test_experiment_log(spark, tmp_path, linear_rows):
    path = str(tmp_path / "log")
    assert sinks.read_experiments(spark, path).count() == 0
    df, _, _ = linear_rows
    run = train.train_all(df, "y", ["id"], ["linear"], folds=2)
    for i in (1, 2):
        sinks.log_experiment(train.experiment_row(spark, run, f"job{i}", f"2024-01-0{i}T00:00:00"), path)
    assert [r["job_id"] for r in sinks.read_experiments(spark, path).collect()] == ["job2", "job1"]


def test_text_features_with_many_classes_take_the_join(spark, tmp_path, monkeypatch):
    from lodestat.ml import prepare

    df = spark.range(600).select("id", F.concat(F.lit("c"), F.col("id") % 90).alias("s"), (F.col("id") % 90 + 0.5).alias("y"))
    short, _ = train.fit(df, "y", ["id"], "decision_tree")
    monkeypatch.setattr(prepare, "INDEXED_CLASSES", 20)
    wide, ready = train.fit(df, "y", ["id"], "decision_tree")
    assert not short.features.codes and set(wide.features.codes) == {"s"}
    sinks.save_trained(wide, str(tmp_path / "wide"))
    got = [sorted(train.score(m, df, ["id"]).select("id", "prediction").collect()) for m in (short, wide, sinks.load_trained(str(tmp_path / "wide")))]
    assert got[0] == got[1] == got[2]
    unseen = spark.createDataFrame([(1, "never seen")], "id bigint, s string")
    assert train.score(wide, unseen, ["id"]).first()["prediction"] is not None


def test_one_against_rest_gives_probabilities(spark):
    rows = [(i, float(i % 3), "pqr"[i % 3]) for i in range(120)]
    model, _ = train.fit(spark.createDataFrame(rows, "id bigint, x double, y string"), "y", ["id"], "gradient_boosting", n_estimators=5)
    scored = train.score(model, spark.createDataFrame(rows, "id bigint, x double, y string"), ["id"]).collect()
    assert all(r["prediction"] == r["y"] and 0 < r["prediction_confidence"] <= 1 for r in scored)
    assert all(abs(sum(r["probabilities"]) - 1) < 1e-9 and len(r["probabilities"]) == 3 for r in scored)


def test_a_failed_search_trains_the_untuned_model(linear_rows, monkeypatch):
    def broken(*_, **__):
        raise errors.LodestatError("no search")

    monkeypatch.setattr(train, "tune", broken)
    run = train.train_all(linear_rows[0], "y", ["id"], ["ridge"], folds=2, tuning=True)
    assert run.results[0]["model_name"] == "Ridge Regression"


def test_failed_models_are_listed(spark, linear_rows):
    run = train.train_all(linear_rows[0], "y", ["id"], ["linear", "nonsense"], folds=2)
    rows = {r["name"]: r for r in run.table(spark).collect()}
    assert rows["nonsense"]["error"].startswith("UnknownOperation") and rows["linear"]["error"] is None


def test_quick_rules_train_two_models(spark, linear_rows):
    run = train.train_all(linear_rows[0], "y", ["id"], folds=2, rules="quick")
    assert {r["name"] for r in run.results} == {"random_forest", "linear"}
    assert models.build("boosting:unheard", "regression", models.TrainingFacts(10, 1, 0, 1.0)).settings.growth.least_weight == 1.0


def test_json_arrays_grow_in_number_not_in_length(spark, tmp_path, monkeypatch):
    from lodestat.plans import queries_models
    from lodestat.plans.registry import QUERIES

    path = str(tmp_path / "arrays")
    monkeypatch.setattr(queries_models, "scratch", lambda spark, name: path)
    monkeypatch.setattr(queries_models, "ARRAY_KEYS", 100)
    parts = "id AS p_partkey, 'n' AS p_name, 'b' AS p_brand, 't' AS p_type, 1 AS p_size, 2.5D AS p_retailprice"
    spark.range(1, 10_001).selectExpr(*parts.split(", ")).write.parquet(str(tmp_path / "part.parquet"))
    got = QUERIES["a03_json_array"](spark, str(tmp_path))
    assert got.select("p_partkey").distinct().count() == got.count() == 10_000
    files = spark.read.text(path, wholetext=True).selectExpr("json_array_length(value) AS n")
    assert files.count() == 101 and files.agg(F.max("n")).first()[0] == 100


@pytest.mark.parametrize("name", ["svr", "random_forest"])
def test_training_rows_are_spread_over_partitions(spark, monkeypatch, name):
    monkeypatch.setattr(models, "PARTITION_ROWS", 50)
    df = spark.range(500).coalesce(1).selectExpr("IF(id % 4 = 0, NULL, id) AS id", "double(id % 8) AS f", "double(id % 8 * 10) AS y")
    estimator, seen = RandomForestRegressor if name == "random_forest" else Pipeline, []
    inner = estimator.fit

    def fit(self, rows, *more):
        seen.append([len(p) for p in rows.rdd.glom().collect()])
        return inner(self, rows, *more)

    monkeypatch.setattr(estimator, "fit", fit)
    _, ready = train.fit(df, "y", ["id"], name, problem="regression", **({"n_estimators": 3} if name == "random_forest" else {}))
    dealt = seen[-1]
    assert len(dealt) == -(-ready.train.count() // 50) and sum(dealt) == ready.train.count()


@pytest.fixture(scope="module")
def noisy_rows(spark):
    """Prepared rows of two classes that no model parts: few values, so that histograms of any kind have the same bins."""
    rng = np.random.default_rng(11)
    x = rng.integers(0, 12, (600, 2)).astype(float)
    y = (x[:, 0] + 3 * np.sin(x[:, 1]) + rng.normal(0, 2, 600) > 5).astype(int)
    rows = [(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))]
    return train.prepare_rows(spark.createDataFrame(rows, "id bigint, a double, b double, y int"), "y", ["id"]).train.persist()


def test_small_tables_train_in_few_jobs_on_few_partitions(spark, noisy_rows):
    dealt = models.spread(noisy_rows.repartition(50), noisy_rows.count())
    assert dealt.rdd.getNumPartitions() == 1 and sorted(dealt.collect()) == sorted(noisy_rows.collect())
    facts = models.training_facts(dealt, "classification")
    for name in ("svc", "gradient_boosting"):
        spark.sparkContext.setJobGroup(f"jobs of {name}", name)
        try:
            models.build(name, "classification", facts).fit(dealt)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"jobs of {name}")) < 60


def test_gradient_boosting_takes_the_steps_of_mllib(noisy_rows):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.regression import GBTRegressor

    facts = models.training_facts(noisy_rows, "classification")
    for problem, theirs, output in [
        ("classification", GBTClassifier(maxIter=8, maxDepth=3, stepSize=0.1), lambda t: F.get(vector_to_array("probability"), F.lit(1))),
        ("regression", GBTRegressor(maxIter=8, maxDepth=3, stepSize=0.1), lambda t: F.col("prediction")),
    ]:
        ours = models.build("gradient_boosting", problem, facts, n_estimators=8, max_depth=3)
        a, b = ([r.v for r in e.fit(noisy_rows).transform(noisy_rows).orderBy("row_key").select(output(e).alias("v")).collect()] for e in (ours, theirs))
        assert np.allclose(a, b, atol=1e-9)


def test_kernel_machine_finds_the_least_hinge_loss(noisy_rows, monkeypatch):
    from pyspark.ml.classification import LinearSVC

    strength = 1 / noisy_rows.count()
    found = margins.MarginMachine([], strength).fit(noisy_rows)
    theirs = LinearSVC(regParam=strength, maxIter=30).fit(noisy_rows.coalesce(1))
    # the same steps as jobs over several partitions
    monkeypatch.setattr(margins, "TASK_ROWS", 0)
    spread_out = margins.MarginMachine([], strength).fit(noisy_rows.repartition(2, "row_key"))

    def cost(model, weights):
        table = model.transform(noisy_rows).select("label", F.get(vector_to_array("rawPrediction"), F.lit(1)).alias("m"))
        # features have deviation 1
        return table.agg(F.avg(F.greatest(F.lit(0.0), 1 - (2 * F.col("label") - 1) * F.col("m")))).first()[0] + strength / 2 * sum(w * w for w in weights)

    ours = found.stages[-1]
    assert cost(found, ours.getOrDefault("weights")) <= cost(theirs, theirs.coefficients) + 0.005
    assert np.allclose(ours.getOrDefault("weights"), spread_out.stages[-1].getOrDefault("weights"), atol=1e-6)
    shares = found.transform(noisy_rows).agg(F.avg("label"), F.avg(F.get(vector_to_array("probability"), F.lit(1)))).first()
    assert abs(shares[0] - shares[1]) < 1e-3  # the logistic fit is calibrated


def test_a_saved_kernel_machine_scores_the_same(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b), "in" if a * a + b * b < 1.2 else "out") for i, (a, b) in enumerate(rng.normal(size=(200, 2)))]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, side string")
    model, _ = train.fit(df, "side", ["id"], "svc")
    sinks.save_trained(model, str(tmp_path / "svc"))
    again = sinks.load_trained(str(tmp_path / "svc"))
    a, b = (sorted(train.score(m, df, ["id"]).select("id", "prediction", "prediction_confidence").collect()) for m in (model, again))
    assert a == b
