"""Model zoo: names mapped to MLlib estimators with the expected default settings.

Regularisation strengths are given on the total loss and converted to MLlib's mean loss, which
needs the number of training rows and, because MLlib scales the label, its standard deviation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.errors import UnknownOperation
from lodestat.ml.boosting import Booster, Boosting
from lodestat.ml.margins import SEED, MarginMachine, RandomFourierFeatures
from lodestat.ml.trees import Growth
from lodestat.operators.neighbors import mean_label, nearest, vote

#: Training rows of one partition: a few hundred numbers a row, as the kernel machines and forests keep, stay below 100 MB in a task.
PARTITION_ROWS = 1 << 15
CLASSIFIERS = [
    "logistic", "svc", "knn", "naive_bayes", "random_forest", "decision_tree", "xgboost", "lightgbm", "gradient_boosting",
]
REGRESSORS = [
    "linear", "ridge", "lasso", "elasticnet", "svr", "knn", "random_forest", "decision_tree", "xgboost", "lightgbm",
    "gradient_boosting",
]
# Display names of the models.
TITLES = {
    "logistic": "Logistic Regression", "linear": "Linear Regression", "ridge": "Ridge Regression", "lasso": "Lasso Regression",
    "elasticnet": "ElasticNet", "svc": "Support Vector Classifier", "svr": "Support Vector Regressor", "knn": "K-Nearest Neighbors",
    "naive_bayes": "Gaussian Naive Bayes", "decision_tree": "Decision Tree", "random_forest": "Random Forest", "xgboost": "XGBoost",
    "lightgbm": "LightGBM", "catboost": "CatBoost", "gradient_boosting": "Gradient Boosting",
}
# what trains a model whose title names a library that is not Spark-native
ENGINES = {
    "gradient_boosting": "first-order boosting of histogram trees with MLlib's steps (lodestat.ml.boosting)",
    "xgboost": "second-order boosting of depth-wise histogram trees (lodestat.ml.boosting)",
    "lightgbm": "second-order boosting of leaf-wise histogram trees (lodestat.ml.boosting)",
    "catboost": "ordered boosting of oblivious histogram trees (lodestat.ml.boosting)",
}


@dataclass(frozen=True)
class TrainingFacts:
    """What an estimator needs to know of its training rows."""

    rows: int
    features: int
    classes: int
    label_std: float


def training_facts(train: DataFrame, problem: str) -> TrainingFacts:
    """One pass for rows, label spread, classes and features."""
    width = F.max(F.size(vector_to_array("features")))
    row = train.agg(F.count("*").alias("n"), F.stddev_pop("label").alias("s"), F.max("label").alias("m"), width.alias("w")).first()
    classes = int(row["m"]) + 1 if problem == "classification" and row["m"] is not None else 0
    return TrainingFacts(row["n"], row["w"] or 0, classes, row["s"] or 1.0)


def spread(train: DataFrame, rows: int, key: str = "row_key") -> DataFrame:
    """The training rows in partitions of about PARTITION_ROWS rows, in an order that every retry repeats.

    A small file is read by few tasks, and a trainer keeps far more bytes a row than the file has. A few rows that come out of a shuffle
    stand in hundreds of partitions, of which each of a trainer's many jobs makes tasks. Vectors are part of the hash, as keys may repeat
    or be missing.
    """
    parts = max(1, -(-rows // PARTITION_ROWS))
    return train.repartition(parts, key, "label", vector_to_array("features")).sortWithinPartitions(key, "label")


class KnnModel:
    """Keeps the training rows; prediction is a distributed exact k-nearest-neighbour join."""

    def __init__(self, train: DataFrame, problem: str, k: int, weights: str, key: str):
        self.train, self.problem, self.k, self.weights, self.key = train, problem, k, weights, key

    def transform(self, df: DataFrame) -> DataFrame:
        train = self.train.select(
            F.col(self.key).cast("bigint").alias("train_key"), vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label")
        )
        test = df.select(F.col(self.key).cast("bigint").alias("test_key"), vector_to_array("features").alias("x"))
        found = nearest(test, train, self.k)
        made = vote(found, self.weights) if self.problem == "classification" else mean_label(found, self.weights)
        return df.join(made.withColumnRenamed("test_key", "_test_key"), F.col(self.key) == F.col("_test_key"), "left").drop("_test_key")


class Knn:
    """Estimator of ``KnnModel``; needs one integer key column."""

    def __init__(self, problem: str, k: int = 5, weights: str = "uniform", key: str = "row_key"):
        self.problem, self.k, self.weights, self.key = problem, k, weights, key

    def fit(self, train: DataFrame) -> KnnModel:
        return KnnModel(train, self.problem, self.k, self.weights, self.key)


def ridge_strength(alpha: float, facts: TrainingFacts) -> float:
    return alpha / facts.rows * facts.label_std


def build(name: str, problem: str, facts: TrainingFacts, key: str = "row_key", **given) -> Estimator | Knn | Booster | MarginMachine:
    """An unfitted estimator for ``name``; ``given`` overrides single settings (as in tuning)."""
    if name == "auto":
        name = "logistic" if problem == "classification" else "linear"
    if name.startswith("boosting:"):  # the boosting tool takes any unknown library name for XGBoost
        name = name.removeprefix("boosting:") if name.removeprefix("boosting:") in ENGINES else "xgboost"
    if name not in TITLES:
        raise UnknownOperation(f"unknown model {name}")
    maker = _classifier if problem == "classification" else _regressor
    return maker(name, facts, key, dict(given))


def _classifier(name: str, facts: TrainingFacts, key: str, p: dict) -> Estimator | Knn | Booster | MarginMachine:
    binary = facts.classes <= 2
    if name == "logistic":
        return LogisticRegression(maxIter=p.get("max_iter", 1000), regParam=1 / (p.get("C", 1.0) * facts.rows), standardization=False)
    if name == "naive_bayes":
        return NaiveBayes(modelType="gaussian")
    if name == "knn":
        return Knn("classification", p.get("n_neighbors", 5), p.get("weights", "uniform"), key)
    if name == "svc":
        kernel = _rbf(facts, p)
        if binary:
            return MarginMachine(kernel, 1 / (p.get("C", 1.0) * facts.rows))
        svm = LinearSVC(featuresCol=_kernel_col(kernel), regParam=1 / (p.get("C", 1.0) * facts.rows), maxIter=100)
        machine = OneVsRest(classifier=svm, featuresCol=_kernel_col(kernel), parallelism=4)
        # probabilities from a logistic fit on the margins
        platt = LogisticRegression(
            featuresCol="rawPrediction", predictionCol="platt_prediction", rawPredictionCol="platt_raw", probabilityCol="probability"
        )
        return Pipeline(stages=[*kernel, machine, platt])
    if name == "decision_tree":
        return _single_tree("classification", facts, key, p)
    if name == "random_forest":
        return RandomForestClassifier(
            numTrees=p.get("n_estimators", 100), maxDepth=_depth(p, 15), minInstancesPerNode=2, featureSubsetStrategy="sqrt", seed=SEED
        )
    if name == "gradient_boosting":
        return _gradient_boosting("classification", facts, key, p)
    if name in ENGINES:
        return _histogram_boosting(name, "classification", facts, key, p)
    raise UnknownOperation(f"{name} is not a classifier")


def _regressor(name: str, facts: TrainingFacts, key: str, p: dict) -> Estimator | Knn | Booster | MarginMachine:
    alpha = p.get("alpha", 1.0)
    if name == "linear":
        return LinearRegression(regParam=0.0, solver="normal")
    if name == "ridge":
        return LinearRegression(regParam=ridge_strength(alpha, facts), elasticNetParam=0.0, standardization=False, solver="normal")
    if name == "lasso":
        return LinearRegression(regParam=alpha, elasticNetParam=1.0, standardization=False, maxIter=1000, tol=1e-9)
    if name == "elasticnet":
        l1 = p.get("l1_ratio", 0.5)
        strength = alpha * l1 + alpha * (1 - l1) * facts.label_std
        return LinearRegression(regParam=strength, elasticNetParam=alpha * l1 / strength, standardization=False, maxIter=1000, tol=1e-9)
    if name == "knn":
        return Knn("regression", p.get("n_neighbors", 5), p.get("weights", "uniform"), key)
    if name == "svr":
        kernel = _rbf(facts, p)
        line = LinearRegression(
            featuresCol=_kernel_col(kernel), loss="huber", elasticNetParam=0.0, regParam=1 / (p.get("C", 1.0) * facts.rows), maxIter=100
        )
        return Pipeline(stages=[*kernel, line])
    if name == "decision_tree":
        return _single_tree("regression", facts, key, p)
    if name == "random_forest":
        return RandomForestRegressor(
            numTrees=p.get("n_estimators", 100), maxDepth=_depth(p, 15), minInstancesPerNode=2, featureSubsetStrategy="all", seed=SEED
        )
    if name == "gradient_boosting":
        return _gradient_boosting("regression", facts, key, p)
    if name in ENGINES:
        return _histogram_boosting(name, "regression", facts, key, p)
    raise UnknownOperation(f"{name} is not a regressor")


def _depth(p: dict, default: int) -> int:
    depth = p.get("max_depth", default)
    return 30 if depth is None else depth  # 30 is MLlib's deepest tree


def _gradient_boosting(problem: str, facts: TrainingFacts, key: str, p: dict) -> Booster:
    """First-order trees with the steps of MLlib's gradient-boosted trees; several classes one against the rest."""
    growth = Growth(_depth(p, 6), ridge=0.0)
    return Booster(problem, facts.classes, Boosting("gradient", p.get("n_estimators", 100), p.get("learning_rate", 0.1), growth, seed=SEED), key)


def _single_tree(problem: str, facts: TrainingFacts, key: str, p: dict) -> Booster:
    """Gini or variance tree; ``max_depth`` None grows until nodes are pure or smaller than ``min_samples_split``."""
    growth = Growth(p.get("max_depth", 10), ridge=0.0, least_split=p.get("min_samples_split", 10))
    return Booster(problem, facts.classes, Boosting("single", growth=growth), key)


def _histogram_boosting(name: str, problem: str, facts: TrainingFacts, key: str, p: dict) -> Booster:
    depth = p.get("max_depth", 6)
    # The libraries' default regularisation and least node sizes.
    growth = {
        "xgboost": Growth(depth, ridge=p.get("reg_lambda", 1.0), least_gain=p.get("gamma", 0.0), least_weight=p.get("min_child_weight", 1.0)),
        "lightgbm": Growth(depth, p.get("num_leaves", 31), p.get("reg_lambda", 0.0), 0.0, p.get("min_child_weight", 1e-3), p.get("min_child_samples", 20)),
        "catboost": Growth(depth or 16, ridge=p.get("l2_leaf_reg", 3.0), least_rows=0, oblivious=True),
    }[name]
    style = "ordered" if name == "catboost" else "newton"
    sampled = {"top_rate": p["top_rate"], "other_rate": p.get("other_rate", 0.1)} if "top_rate" in p else {}
    settings = Boosting(style, p.get("n_estimators", 100), p.get("learning_rate", 0.1), growth, seed=SEED, **sampled)
    return Booster(problem, facts.classes, settings, key)


def _rbf(facts: TrainingFacts, p: dict) -> list:
    if p.get("kernel", "rbf") == "linear":
        return []
    # features are standardised, so both usual choices of gamma come to 1 / features
    return [RandomFourierFeatures(width=facts.features, gamma=1 / max(1, facts.features))]


def _kernel_col(kernel: list) -> str:
    return "rff" if kernel else "features"
