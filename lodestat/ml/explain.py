"""Feature attributions: exact for linear models and trees, kernel regression or permutation sampling for any other model."""

from __future__ import annotations

import json
import random
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.errors import LodestatError
from lodestat.functions.columns import constant, named, number, ratio
from lodestat.ml import shap
from lodestat.operators.charts import hash_sample
from lodestat.operators.schema import need_numeric


def background(df: DataFrame, n: int, keys: list[str], seed: str = "42") -> DataFrame:
    """A reproducible sample of n rows that stands for the training data."""
    return hash_sample(df, n, keys, seed)


def linear_shap(df: DataFrame, weights: dict[str, float], keys: list[str]) -> DataFrame:
    """Exact attributions of a linear model: phi = w * (x - mean(x)), one row per key and feature.

    One aggregate pass for the means; the rest is a projection, so it runs over the whole table.
    """
    need_numeric(df, *weights)
    means = df.agg(*[F.avg(number(df, c)).alias(f"m{i}") for i, c in enumerate(weights)]).first()
    parts = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                number(df, c).alias("value"),
                (F.lit(float(w)) * (number(df, c) - constant(means[f"m{i}"]))).alias("phi"),
            )
            for i, (c, w) in enumerate(weights.items())
        ]
    )
    return df.select(*[named(k) for k in keys], F.inline(parts))


def shap_importance(phis: DataFrame) -> DataFrame:
    """Mean |phi| per feature."""
    return phis.groupBy("feature").agg(F.avg(F.abs("phi")).alias("importance"))


def explain_rows(phis: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """The k largest attributions per row with direction and size relative to the row's largest."""
    per_row = Window.partitionBy(*[named(x) for x in keys])
    size = F.abs("phi")
    ranked = phis.withColumn("rank", F.row_number().over(per_row.orderBy(size.desc(), F.col("feature"))))
    top = ranked.withColumn("relative", ratio(size, F.max(size).over(per_row))).where(F.col("rank") <= k)
    return top.withColumn("contribution", F.when(F.col("phi") > 0, "positive").otherwise("negative"))


def sampled_shap(
    rows: DataFrame,
    sample: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    features: list[str],
    keys: list[str],
    permutations: int = 16,
    seed: int = 42,
) -> DataFrame:
    """Shapley values of any model by permutation sampling (Strumbelj and Kononenko 2014).

    ``rows`` and ``sample`` carry a vector ``features``; ``score`` adds a double ``output`` to such
    a table. For every explained row, permutation and background row, features are switched one after
    another from the background row to the explained row; a feature's value is the mean change at
    its switch. The row and background samples are bounded by the caller (100 and 50 rows by default
    elsewhere); the table scored has rows x permutations x background rows x (features + 1) rows. The attributions of a row sum
    exactly to its output minus the mean output of its background rows.
    """
    rng = random.Random(seed)
    donors = [list(map(float, r["x"])) for r in sample.select(vector_to_array("features").alias("x")).collect()]
    plan = []
    for _ in range(permutations):
        order = list(range(len(features)))
        rng.shuffle(order)
        place = [order.index(i) for i in range(len(features))]
        plan += [{"p": len(plan) + i, "place": place, "donor": donor} for i, donor in enumerate(donors)]
    orders = F.from_json(F.lit(json.dumps(plan)), "array<struct<p:int,place:array<int>,donor:array<double>>>")
    base = rows.select(*[named(k) for k in keys], vector_to_array("features").alias("x")).withColumn("plan", F.explode(orders))
    steps = base.withColumn("switched", F.explode(F.sequence(F.lit(0), F.lit(len(features)))))
    pairs = F.arrays_zip(F.col("x").alias("x"), F.col("plan.donor").alias("d"), F.col("plan.place").alias("o"))
    mixed = F.transform(pairs, lambda t: F.when(t["o"] < F.col("switched"), t["x"]).otherwise(t["d"]))
    scored = score(steps.select(*keys, "plan.p", "plan.place", "switched", "x", array_to_vector(mixed).alias("features")))
    # one group per explained row and permutation: its outputs in switching order
    outputs = scored.groupBy(*[named(k) for k in keys], "p").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("switched", "output"))), lambda t: t["output"]).alias("outputs"),
        F.first("place").alias("place"),
        F.first("x").alias("x"),
    )

    def change(at: Column) -> Column:
        return F.get(F.col("outputs"), at + 1) - F.get(F.col("outputs"), at)

    parts = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), F.get(F.col("x"), F.lit(i)).alias("value"), change(F.get(F.col("place"), F.lit(i))).alias("delta"))
            for i, f in enumerate(features)
        ]
    )
    deltas = outputs.select(*[named(k) for k in keys], F.get("outputs", F.lit(0)).alias("base"), F.inline(parts))
    return deltas.groupBy(*[named(k) for k in keys], "feature").agg(
        F.first("value").alias("value"), F.avg("delta").alias("phi"), F.avg("base").alias("base_value")
    )


def explain_predicted_class(trained, train: DataFrame, keys: list[str], n: int = 100, donors: int = 50, k: int = 10, permutations: int = 16) -> DataFrame:
    """Sampled attributions to the probability of the class predicted for each explained row."""
    rows = background(train, n, keys, seed="rows")
    chosen = trained.predict(rows).select(*[named(x) for x in keys], F.col("prediction").cast("int").alias("_class"))

    def output(table: DataFrame) -> DataFrame:
        scored = trained.predict(table)
        joined = scored.drop("prediction").join(chosen, keys)  # n rows
        return joined.withColumn("output", F.get(vector_to_array("probability"), F.col("_class")))

    phis = sampled_shap(rows, background(train, donors, keys), output, trained.feature_names, keys, permutations)
    return explain_rows(phis, keys, k).join(chosen.withColumnRenamed("_class", "predicted_class"), keys)


def attributions(trained, rows: DataFrame, train: DataFrame, keys: list[str], donors: int = 50, samples: int = 100) -> DataFrame:
    """(keys, feature, value, phi, base_value): of trees exactly, over all ``rows``; of any other model by kernel regression.

    Classes are explained by the output of the class predicted for each row: margins or shares of trees, else its probability (models
    without probabilities: the class number). Kernel regression scores rows x samples x donors rows, so pass a sample of rows there.
    """
    try:
        shap.trees_of(trained.model)
    except LodestatError:
        chosen = trained.predict(rows).select(*[named(x) for x in keys], F.col("prediction").cast("int").alias("_class"))

        def output(table: DataFrame) -> DataFrame:
            scored = trained.predict(table)
            if trained.problem == "regression" or "probability" not in scored.columns:
                return scored.withColumn("output", F.col("prediction"))
            return scored.drop("prediction").join(chosen, keys).withColumn("output", F.get(vector_to_array("probability"), F.col("_class")))

        return shap.kernel_shap(rows, background(train, donors, keys), output, trained.feature_names, keys, samples)
    return shap.tree_shap(rows, trained.model, trained.feature_names, keys, "largest").drop("output")


def importance_or_fallback(spark, trained, attributions: Callable[[], DataFrame]) -> DataFrame:
    """Importance from attributions, or the model's own importances if computing them fails."""
    from lodestat.ml.train import importances

    try:
        return shap_importance(attributions()).withColumns({"fallback": F.lit(False), "error": F.lit(None).cast("string")})
    except (LodestatError, PySparkException, AttributeError, TypeError, ValueError) as error:
        own = spark.createDataFrame(importances(trained), "feature string, importance double")
        reason = F.lit(f"{type(error).__name__}: {error}"[:500])
        return own.orderBy(F.desc("importance"), "feature").withColumns({"fallback": F.lit(True), "error": reason})
