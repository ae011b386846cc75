"""Problem type, splits, folds and feature pipelines."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import ElementwiseProduct, Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.functions.columns import hash_number, hash_percent, hash_text, is_missing, named, present
from lodestat.operators.fitting import BROADCAST_BYTES, attach_codes, fit_codes
from lodestat.operators.ordered import MAX_GROUP_ROWS, running
from lodestat.operators.schema import categorical_columns, kind, need, numeric_columns

FOLDS = 5
INDEXED_CLASSES = 20_000


def problem_type(df: DataFrame, target: str, rules: str = "trainer") -> str:
    """classification or regression.

    trainer: a text target or fewer than 10 distinct values is classification;
    quick: fewer than 20 distinct values of a text or integer target.
    The check needs to know whether the count stays below the limit, so at most ``limit`` distinct
    values are fetched, whatever the cardinality.
    """
    need(df, target)
    limit = 20 if rules == "quick" else 10
    text = kind(df.schema[target]) == "categorical"
    if text and rules == "trainer":
        return "classification"
    few = df.select(present(df, target).alias("y")).where("y IS NOT NULL").distinct().limit(limit).count() < limit
    if rules == "quick":
        return "classification" if few and (text or isinstance(df.schema[target].dataType, T.IntegralType)) else "regression"
    return "classification" if few else "regression"


def split(df: DataFrame, test_size: float, keys: list[str], seed: str = "") -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the key: narrow, and the same in every plan and retry."""
    need(df, *keys)
    bucket = hash_percent(*[named(k) for k in keys], seed=seed)
    cut = round(test_size * 100)
    return df.where(bucket >= cut), df.where(bucket < cut)


def with_folds(
    df: DataFrame, k: int, keys: list[str], stratify: str | None = None, seed: str = "", max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Add ``fold`` 0..k-1: hash of the key, or per class in hash order so that each fold gets its share.

    Ranking inside a class splits a large class over many tasks (see ``running``).
    """
    columns = [named(x) for x in keys]
    if stratify is None:
        return df.withColumn("fold", F.pmod(hash_number(*columns, seed=seed), F.lit(k)).cast("int"))
    ranked = running(
        df.withColumn("_hash", hash_text(*columns, seed=seed)),
        [stratify],
        [F.col("_hash"), *columns],
        row_number="_rank",
        max_group_rows=max_group_rows,
    )
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_hash", "_rank")


def model_inputs(df: DataFrame, target: str, keys: list[str]) -> tuple[list[str], list[str]]:
    """Numeric and text feature columns; types that cannot feed a model are left out."""
    skip = {target, *keys}
    return [c for c in numeric_columns(df) if c not in skip], [c for c in categorical_columns(df) if c not in skip]


def model_table(df: DataFrame, target: str, keys: list[str]) -> DataFrame:
    """Keys, doubles, texts with missing as 'nan', and the target; rows without a target are dropped."""
    numeric, texts = model_inputs(df, target, keys)
    ready = df.where(~is_missing(df, target))
    return ready.select(
        *[named(k) for k in keys],
        *[present(df, c).cast("double").alias(c) for c in numeric],
        *[F.coalesce(named(c), F.lit("nan")).alias(c) for c in texts],
        named(target),
    )


@dataclass
class FeatureModel:
    """Fitted feature pipeline; text columns with very many classes are coded by a join beforehand."""

    pipeline: PipelineModel
    codes: dict[str, dict] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        for c, fitted in self.codes.items():
            df = attach_codes(df, c, fitted, f"{c}__code")
            # a class not seen in training gets a code of its own, as the indexer does
            df = df.withColumn(f"{c}__code", F.coalesce(named(f"{c}__code"), F.lit(fitted["size"])).cast("double"))
        return self.pipeline.transform(df)

    def outputs(self) -> set[str]:
        stages = [s for s in self.pipeline.stages if s.hasParam("outputCols") and s.isDefined("outputCols")]
        return {name for s in stages for name in s.getOutputCols()}


def many_classes(df: DataFrame, texts: list[str]) -> list[str]:
    """Text columns whose classes are too many or too long to go through the driver, from one pass of sketches.

    The sketch only picks the route; both routes give the same codes.
    """
    if not texts:
        return []
    row = df.agg(
        *[F.approx_count_distinct(named(c)).alias(f"d{i}") for i, c in enumerate(texts)],
        *[F.max(F.octet_length(named(c))).alias(f"b{i}") for i, c in enumerate(texts)],
    ).first()
    return [c for i, c in enumerate(texts) if row[f"d{i}"] > INDEXED_CLASSES or row[f"d{i}"] * (row[f"b{i}"] or 0) > BROADCAST_BYTES]


def feature_stages(numeric: list[str], texts: list[str], rules: str = "trainer", joined: list[str] | None = None, rows: int = 0, classes: list[int] | None = None) -> list:
    """Unfitted stages ending in ``features``; ``joined`` text columns have their codes already.

    trainer: label codes for text, mean fill, vector standardised by the population deviation of its ``rows``; quick: mean fill,
    no scaling, and a dummy for each of a text column's ``classes`` but the first (an unseen class has none).
    """
    filled = [f"{c}__filled" for c in numeric]
    coded = [f"{c}__code" for c in texts]
    stages: list = []
    if numeric:
        stages.append(Imputer(strategy="mean", inputCols=numeric, outputCols=filled))
    indexed = [c for c in texts if c not in (joined or [])]
    if indexed:
        stages.append(StringIndexer(inputCols=indexed, outputCols=[f"{c}__code" for c in indexed], stringOrderType="alphabetAsc", handleInvalid="keep"))
    if rules == "quick":
        if texts:
            dummy, kept = [f"{c}__dummy" for c in texts], [f"{c}__kept" for c in texts]
            stages.append(OneHotEncoder(inputCols=coded, outputCols=dummy, dropLast=False))
            for c, out, n in zip(dummy, kept, classes or [], strict=True):
                stages.append(VectorSlicer(inputCol=c, outputCol=out, indices=list(range(1, n))))
            coded = [out for out, n in zip(kept, classes or [], strict=True) if n > 1]
            stages = [s for s in stages if not isinstance(s, VectorSlicer) or s.getIndices()]
        return [*stages, VectorAssembler(inputCols=filled + coded, outputCol="features")]
    stages.append(VectorAssembler(inputCols=filled + coded, outputCol="raw_features"))
    # the scaler divides by the sample deviation; the factor makes that the population deviation
    stages.append(StandardScaler(inputCol="raw_features", outputCol="sample_scaled", withMean=True, withStd=True))
    factor = (rows / (rows - 1)) ** 0.5 if rows > 1 else 1.0
    stages.append(ElementwiseProduct(inputCol="sample_scaled", outputCol="features", scalingVec=Vectors.dense([factor] * len(filled + coded))))
    return stages


def target_stage(df: DataFrame, target: str, problem: str) -> list:
    """Indexer of the target's classes, which are the model's outputs and so must fit in the driver."""
    if problem != "classification":
        return []
    return [StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc")]


def fit_features(train: DataFrame, target: str, keys: list[str], rules: str = "trainer") -> FeatureModel:
    """Fit encoders, fills and scaling on the training rows only."""
    numeric, texts = model_inputs(train, target, keys)
    wide = many_classes(train, texts)
    coded = FeatureModel(PipelineModel([]), {c: fit_codes(train, c, INDEXED_CLASSES) for c in wide})
    ready = coded.transform(train)
    rows, classes = 0, []
    if rules == "quick":
        # as many dummy columns as classes come out, so the classes are counted where the dummies are fitted
        if texts:
            row = ready.agg(*[F.count_distinct(named(c)).alias(f"n{i}") for i, c in enumerate(texts)]).first()
            classes = [row[f"n{i}"] for i in range(len(texts))]
    else:
        rows = ready.count()
    pipeline = Pipeline(stages=feature_stages(numeric, texts, rules, wide, rows, classes)).fit(ready)
    return FeatureModel(pipeline, coded.codes)
