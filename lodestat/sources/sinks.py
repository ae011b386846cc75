"""Sinks: scored tables, the experiment log and models."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXPERIMENT = (
    "job_id string, timestamp string, target_column string, problem_type string, "
    "best_model string, score double, metric string, models_trained int"
)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    out = df.write.mode(mode).option("header", True).option("escape", '"')
    out.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def log_experiment(rows: DataFrame, path: str) -> None:
    """Append experiment records; earlier records are never rewritten."""
    rows.write.mode("append").json(path)


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    """All experiment records, newest first; empty if nothing was logged yet."""
    try:
        log = spark.read.schema(EXPERIMENT).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        log = spark.createDataFrame([], EXPERIMENT)
    return log.orderBy(F.desc("timestamp"), "job_id")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_trained(trained, path: str) -> None:
    """Write a trained model: feature pipeline, estimator and a small settings table.

    A neighbour model is stored as its training rows, histogram trees as text in the settings table.
    """
    spark = SparkSession.active()
    save_model(trained.features.pipeline, f"{path}/features")
    codes = {}
    for i, (column, fitted) in enumerate(trained.features.codes.items()):
        codes[column] = {k: v for k, v in fitted.items() if k != "table"}
        if "table" in fitted:
            fitted["table"].write.mode("overwrite").parquet(f"{path}/codes/{i}")
    knn = hasattr(trained.model, "train")
    if knn:
        trained.model.train.write.mode("overwrite").parquet(f"{path}/rows")
        extra = {"k": trained.model.k, "weights": trained.model.weights}
    elif hasattr(trained.model, "to_json"):
        extra = {"trees": trained.model.to_json()}
    else:
        extra = {}
        save_model(PipelineModel(stages=[trained.model]), f"{path}/model")
    about = {
        "name": trained.name,
        "title": trained.title,
        "problem": trained.problem,
        "feature_names": trained.feature_names,
        "classes": trained.classes,
        "codes": codes,
        **extra,
    }
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_trained(path: str):
    from lodestat.ml.boosting import BoostedModel
    from lodestat.ml.models import KnnModel
    from lodestat.ml.prepare import FeatureModel
    from lodestat.ml.train import TrainedModel

    spark = SparkSession.active()
    about = json.loads(spark.read.text(f"{path}/about").first()["value"])
    if "k" in about:
        model = KnnModel(spark.read.parquet(f"{path}/rows"), about["problem"], about["k"], about["weights"], "row_key")
    elif "trees" in about:
        model = BoostedModel.from_json(about["trees"])
    else:
        model = load_model(f"{path}/model").stages[0]
    codes = about["codes"]
    for i, fitted in enumerate(codes.values()):
        if "classes" not in fitted:
            fitted["table"] = spark.read.parquet(f"{path}/codes/{i}")
    features = FeatureModel(load_model(f"{path}/features"), codes)
    return TrainedModel(about["name"], about["title"], about["problem"], model, features, about["feature_names"], about["classes"])
