"""Training, cross-validation, random search, ranking, importances and batch scoring."""

from __future__ import annotations

import itertools
import logging
import random
import statistics
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Estimator
from pyspark.ml.classification import OneVsRestModel
from pyspark.ml.feature import IndexToString
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.errors import NoModelTrained
from lodestat.functions.columns import named, present
from lodestat.ml.margins import MarginMachine
from lodestat.ml.models import CLASSIFIERS, ENGINES, PARTITION_ROWS, REGRESSORS, TITLES, build, spread, training_facts
from lodestat.ml.prepare import FOLDS, FeatureModel, fit_features, model_inputs, model_table, problem_type, split, target_stage, with_folds
from lodestat.operators import evaluate
from lodestat.sources.sinks import EXPERIMENT

LOG = logging.getLogger(__name__)
SEARCH_SIZE = 8
#: Models of one run that are trained at the same time; each has up to five fits in flight.
MODELS_AT_ONCE = 3
# The settings tried by the random search.
GRIDS = {
    "logistic": {"C": [0.01, 0.1, 1, 10]},
    "svc": {"C": [0.1, 1, 10], "kernel": ["rbf", "linear"]},
    "knn": {"n_neighbors": [3, 5, 7, 11], "weights": ["uniform", "distance"]},
    "random_forest": {"n_estimators": [50, 100, 200], "max_depth": [5, 10, 15, None]},
    "decision_tree": {"max_depth": [5, 10, 15, None], "min_samples_split": [2, 5, 10]},
    "xgboost": {"n_estimators": [50, 100], "max_depth": [3, 6, 10], "learning_rate": [0.01, 0.1]},
    "lightgbm": {"n_estimators": [50, 100], "max_depth": [3, 6, 10], "learning_rate": [0.01, 0.1]},
    "gradient_boosting": {"n_estimators": [50, 100], "max_depth": [3, 6], "learning_rate": [0.01, 0.1]},
    "ridge": {"alpha": [0.01, 0.1, 1, 10, 100]},
    "lasso": {"alpha": [0.01, 0.1, 1, 10, 100]},
    "elasticnet": {"alpha": [0.01, 0.1, 1, 10], "l1_ratio": [0.2, 0.5, 0.8]},
    "svr": {"C": [0.1, 1, 10], "kernel": ["rbf", "linear"]},
}


@dataclass
class TrainedModel:
    """One fitted model with its feature pipeline: scores raw tables."""

    name: str
    title: str
    problem: str
    model: object
    features: FeatureModel
    feature_names: list[str]
    classes: list[str] = field(default_factory=list)
    settings: dict = field(default_factory=dict)

    def predict(self, prepared: DataFrame) -> DataFrame:
        return self.model.transform(prepared)


@dataclass
class Experiment:
    """Results of one training run, best model first."""

    problem: str
    target: str
    results: list[dict]
    models: dict[str, TrainedModel]
    failed: dict[str, str] = field(default_factory=dict)

    @property
    def best(self) -> TrainedModel:
        return self.models[self.results[0]["name"]]

    def table(self, spark: SparkSession) -> DataFrame:
        columns = ["name", "model_name", "metric", "test_score", "cv_score", "cv_std", "accuracy", "precision", "recall", "f1", "auc"]
        columns += ["r2", "mse", "rmse", "mae"]
        schema = "name string, model_name string, metric string, " + ", ".join(f"{c} double" for c in columns[3:])
        columns += ["engine", "error"]
        schema += ", engine string, error string"
        broken = [{"name": n, "model_name": TITLES.get(n, n), "error": e} for n, e in self.failed.items()]
        rows = [tuple(r.get(c) for c in columns) for r in [*self.results, *broken]]
        return spark.createDataFrame(rows, schema).withColumn("problem_type", F.lit(self.problem))


def positive_score(scored: DataFrame):
    """Probability of class 1 where the model gives one, else its raw margin."""
    if "probability" in scored.columns:
        return F.get(vector_to_array("probability"), F.lit(1))
    if "rawPrediction" in scored.columns:
        return F.get(vector_to_array("rawPrediction"), F.lit(1))
    return None


def score_metrics(scored: DataFrame, problem: str, average: str = "auto") -> dict:
    """Test metrics of a scored table, from a few grouped counts."""
    if problem == "regression":
        return evaluate.regression_metrics(scored).first().asDict()
    return {**evaluate.accuracy(_pairs(scored)).first().asDict(), **evaluate.prf(_pairs(scored), average).first().asDict()}


def main_score(scored: DataFrame, problem: str) -> float:
    """The test metric that ranks models, in one pass."""
    if problem == "regression":
        return score_metrics(scored, problem)[_main(problem)[0]]
    return evaluate.accuracy(_pairs(scored)).first()["accuracy"]


def _pairs(scored: DataFrame) -> DataFrame:
    return scored.select(F.col("label").cast("double").alias("label"), F.col("prediction").cast("double").alias("prediction"))


def _main(problem: str) -> tuple[str, str]:
    return ("accuracy", "accuracy") if problem == "classification" else ("r2", "r2_score")


def cross_validate(name: str, prepared: DataFrame, problem: str, k: int = FOLDS, key: str = "row_key", parallelism: int = 4, **settings) -> tuple[float, float]:
    """Mean and population deviation of the score over k folds, each fitted with its own fold's facts.

    ``prepared`` has ``fold``, ``label`` and ``features``. A fit is a distributed job; the threads
    only keep several of them in flight.
    """

    def one(fold: int) -> float:
        train = prepared.where(F.col("fold") != fold)
        model = build(name, problem, training_facts(train, problem), key, **settings).fit(train)
        return main_score(model.transform(prepared.where(F.col("fold") == fold)), problem)

    with ThreadPoolExecutor(parallelism) as pool:
        scores = list(pool.map(one, range(k)))
    return statistics.fmean(scores), statistics.pstdev(scores)


def search_settings(name: str, size: int = SEARCH_SIZE, seed: int = 42) -> list[dict]:
    """Up to ``size`` settings drawn without repetition from the model's grid; the whole grid if smaller."""
    grid = GRIDS.get(name, {})
    every = [dict(zip(grid, values)) for values in itertools.product(*grid.values())] if grid else []
    return every if len(every) <= size else random.Random(seed).sample(every, size)


def tune(name: str, prepared: DataFrame, problem: str, k: int = FOLDS, key: str = "row_key", size: int = SEARCH_SIZE) -> tuple[dict, float, float]:
    """Best settings by cross-validated score, with mean and deviation; no grid means the defaults."""
    tried = [(cross_validate(name, prepared, problem, k, key, **s), s) for s in search_settings(name, size) or [{}]]
    (mean, std), best = max(tried, key=lambda t: t[0][0])
    return best, mean, std


@dataclass
class Prepared:
    """Train and test tables with row_key, label and features, and what produced them."""

    problem: str
    train: DataFrame
    test: DataFrame
    features: FeatureModel
    feature_names: list[str]
    classes: list[str]

    def trained(self, name: str, title: str, model: object, settings: dict) -> TrainedModel:
        return TrainedModel(name, title, self.problem, model, self.features, self.feature_names, self.classes, settings)


def prepare_rows(df: DataFrame, target: str, keys: list[str], test_size: float = 0.2, rules: str = "trainer", problem: str | None = None) -> Prepared:
    """Split by key hash, fit the feature pipeline on the training rows and apply it to both parts."""
    problem = problem or problem_type(df, target, rules)
    table = model_table(df, target, keys).withColumn("row_key", row_key(keys))
    if problem == "regression":
        table = table.withColumn("label", named(target).cast("double"))
    train_rows, test_rows = split(table, test_size, keys)
    skip = [*keys, "row_key", "label"]
    features = fit_features(train_rows, target, skip, rules)
    indexer = target_stage(table, target, problem)
    labeller = indexer[0].fit(table.select(target)) if indexer else None

    def apply(rows: DataFrame) -> DataFrame:
        made = features.transform(rows)
        made = labeller.transform(made) if labeller else made
        return made.select(*[named(k) for k in keys], "row_key", "label", "features")

    numeric, texts = model_inputs(train_rows, target, skip)
    return Prepared(problem, apply(train_rows), apply(test_rows), features, numeric + texts, labeller.labels if labeller else [])


def fit(df: DataFrame, target: str, keys: list[str], name: str, test_size: float = 0.2, rules: str = "trainer", problem: str | None = None, **settings) -> tuple[TrainedModel, Prepared]:
    """Fit one named model on the training part; returns it with the prepared tables."""
    ready = prepare_rows(df, target, keys, test_size, rules, problem)
    facts = training_facts(ready.train, ready.problem)
    estimator = build(name, ready.problem, facts, **settings)
    # MLlib's estimators and the kernel machine train on the partitions they get; the others deal their rows themselves
    model = estimator.fit(spread(ready.train, facts.rows) if isinstance(estimator, Estimator | MarginMachine) and facts.rows > PARTITION_ROWS else ready.train)
    return ready.trained(name, TITLES.get(name, name), model, settings), ready


def train_all(
    df: DataFrame,
    target: str,
    keys: list[str],
    models: list[str] | None = None,
    test_size: float = 0.2,
    folds: int = FOLDS,
    tuning: bool = False,
    rules: str = "trainer",
    settings: dict[str, dict] | None = None,
) -> Experiment:
    """Train the named models on one split, test and rank them; a failing model is listed with its error.

    Without names all models of the problem are trained; under the quick rules an unlimited random forest and a linear model. A
    failing search falls back to the untuned model.

    ``keys`` identify a row (split, folds and the neighbour join use them) and are not features.
    The prepared tables are persisted, spilling to disk: all fits read them.
    """
    ready = prepare_rows(df, target, keys, test_size, rules)
    problem = ready.problem
    stratify = "label" if problem == "classification" else None
    train = spread(with_folds(ready.train, folds, ["row_key"], stratify, seed="folds"), ready.train.count()).persist()
    test = ready.test.persist()
    try:
        return _train_each(df.sparkSession, ready, train, test, target, models, folds, tuning, rules, settings)
    finally:
        train.unpersist()
        test.unpersist()


def _train_each(spark, ready: Prepared, train: DataFrame, test: DataFrame, target, models, folds, tuning, rules, settings) -> Experiment:
    problem = ready.problem
    facts = training_facts(train, problem)
    linear = "logistic" if problem == "classification" else "linear"
    every = CLASSIFIERS if problem == "classification" else REGRESSORS
    wanted = models or (["random_forest", linear] if rules == "quick" else every)
    short, metric = _main(problem)

    def last(name: str, chosen: dict) -> tuple[object, dict]:
        model = build(name, problem, facts, **chosen).fit(train)
        scored = model.transform(test)
        margin = positive_score(scored) if problem == "classification" and facts.classes == 2 else None
        # one pass of the model serves all metrics
        scored = scored.select("label", "prediction", *([] if margin is None else [margin.alias("score")])).persist()
        try:
            found = score_metrics(scored, problem, "weighted" if rules == "quick" else "auto")
            if margin is not None:
                found["auc"] = evaluate.auc(scored.select("label", "score")).first()["auc"]
            elif problem == "classification" and rules == "quick":
                found["auc"] = 0.0
        finally:
            scored.unpersist()
        return model, found

    def one(name: str) -> tuple[str, dict, object, str, dict]:
        name = {"auto": linear}.get(name, name)
        chosen = (settings or {}).get(name, {"max_depth": None} if rules == "quick" and name == "random_forest" else {})
        title, searched = TITLES.get(name, name), False
        try:
            if tuning and name in GRIDS:
                try:
                    chosen, cv, cv_std = tune(name, train, problem, folds)
                    title, searched = title + " (Tuned)", True
                except Exception as error:  # the untuned model is trained instead
                    LOG.warning("search for %s failed: %s", name, error)
            with ThreadPoolExecutor(1) as pool:
                fit = pool.submit(last, name, chosen)  # beside the folds
                if not searched:
                    cv, cv_std = cross_validate(name, train, problem, folds, **chosen)
                model, found = fit.result()
        except Exception as error:  # one broken model must not lose the others
            LOG.warning("model %s failed: %s", name, error)
            return name, chosen, None, title, {"error": f"{type(error).__name__}: {error}"[:500]}
        if name in ENGINES:
            found["engine"] = ENGINES[name]
        return name, chosen, model, title, {"name": name, "model_name": title, "metric": metric, "test_score": found[short], "cv_score": cv, "cv_std": cv_std, **found}

    # a small table leaves most cores idle in a fit, so some models are trained side by side
    with ThreadPoolExecutor(MODELS_AT_ONCE) as pool:
        made = list(pool.map(one, wanted))
    results = [found for *_, model, _, found in made if model is not None]
    fitted = {name: ready.trained(name, title, model, chosen) for name, chosen, model, title, _ in made if model is not None}
    failed = {name: found["error"] for name, _, model, _, found in made if model is None}
    if not results:
        raise NoModelTrained(f"none of {wanted} could be trained: {failed}")
    results.sort(key=lambda r: (-r["test_score"], r["model_name"]))
    return Experiment(problem, target, results, fitted, failed)


def importances(trained: TrainedModel, width: int | None = None) -> list[tuple[str, float]]:
    """|coefficient| or tree importance per feature; empty for models without either."""
    model = trained.model
    if hasattr(model, "coefficientMatrix"):
        values = abs(model.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(model, "coefficients"):
        values = abs(model.coefficients.toArray())
    elif hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    elif isinstance(model, OneVsRestModel) and hasattr(model.models[0], "featureImportances"):
        values = sum(m.featureImportances.toArray() for m in model.models) / len(model.models)
    else:
        return []
    return list(zip(trained.feature_names, map(float, values)))


def score(trained: TrainedModel, df: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``prediction`` (decoded) and, for classes, ``prediction_confidence`` and ``probabilities`` (in class order) to a raw table.

    The confidence is the largest probability. One-against-rest models give one margin for each class; their logistic values,
    made to sum to 1, are the probabilities. Neighbour votes have a confidence only.

    Absent feature columns count as missing. The model is a projection, so this also scores streams.
    """
    filled = trained.features.outputs()

    def feature(c: str):
        source = present(df, c) if c in df.columns else F.lit(None)
        return source.cast("double").alias(c) if f"{c}__filled" in filled else F.coalesce(source.cast("string"), F.lit("nan")).alias(c)

    row = F.struct(*[named(c) for c in df.columns]).alias("_row")
    ready = df.select(row, row_key(keys).alias("row_key"), *[feature(c) for c in trained.feature_names])
    scored = trained.predict(trained.features.transform(ready))
    made = {"prediction": F.col("prediction")}
    if trained.classes:
        scored = IndexToString(inputCol="prediction", outputCol="_decoded", labels=trained.classes).transform(scored)
        made = {"prediction": F.col("_decoded")}
        if "confidence" in scored.columns:
            made["prediction_confidence"] = F.col("confidence")
        elif "probability" in scored.columns:
            made["prediction_confidence"] = F.array_max(vector_to_array("probability"))
            made["probabilities"] = vector_to_array("probability")
        elif "rawPrediction" in scored.columns:
            each = F.transform(vector_to_array("rawPrediction"), lambda x: 1 / (1 + F.exp(-x)))
            total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
            share = F.transform(each, lambda x: x / total)
            made["prediction_confidence"] = F.array_max(share)
            made["probabilities"] = share
    return scored.select(*[F.col("_row").getField(c).alias(c) for c in df.columns], *[v.alias(k) for k, v in made.items()])


def row_key(keys: list[str]) -> Column:
    """One integer key: the key column itself, or a hash of several."""
    return F.xxhash64(*[named(k) for k in keys]) if len(keys) > 1 else named(keys[0]).cast("bigint")


def experiment_row(spark: SparkSession, run: Experiment, job_id: str, timestamp: str) -> DataFrame:
    """The record of a run for the experiment log."""
    best = run.results[0]
    row = (job_id, timestamp, run.target, run.problem, best["model_name"], best["test_score"], best["metric"], len(run.results))
    return spark.createDataFrame([row], EXPERIMENT)
