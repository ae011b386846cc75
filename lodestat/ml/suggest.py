"""Rule-based training suggestions over a table of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The advice texts.
LOW_ACCURACY = "Model accuracy is low (< 70%). Consider collecting more data or engineering new features."
LOW_PRECISION = "Precision is low. The model has a high false-positive rate."
LOW_RECALL = "Recall is low. The model is missing many positive instances."
LOW_R2 = "R² score is low (< 0.5). The model explains less than 50% of the variance."
IMBALANCE = "Significant class imbalance detected. Consider techniques like SMOTE oversampling or class weighting."
OUTLIERS = "Outliers detected in feature columns. Consider robust scaling or clipping outliers."
GENERAL = {
    "trainer": ["Try removing noisy features to improve generalization.", "Collect more diverse training samples if possible."],
    "quick": [
        "Try training on a larger subset of data if available.",
        "Feature selection (removing noisy columns) might improve performance.",
    ],
}


def suggest(results: DataFrame, keys: list[str], rules: str = "trainer") -> DataFrame:
    """One row per result and advice line: keys, position, suggestion.

    Needs problem_type and test_score; precision, recall and, for the quick rules, rarest_share
    and has_outliers are used where present. A missing number gives no advice.
    """
    have = set(results.columns)
    is_class = F.col("problem_type") == "classification"

    def rule(test, text):
        return F.when(F.coalesce(test, F.lit(False)), F.lit(text))

    lines = [rule(is_class & (F.col("test_score") < 0.7), LOW_ACCURACY)]
    if "precision" in have:
        lines.append(rule(is_class & (F.col("precision") < 0.6), LOW_PRECISION))
    if "recall" in have:
        lines.append(rule(is_class & (F.col("recall") < 0.6), LOW_RECALL))
    if rules == "quick" and "rarest_share" in have:
        lines.append(rule(is_class & (F.col("rarest_share") < 0.1), IMBALANCE))
    lines.append(rule(~is_class & (F.col("test_score") < 0.5), LOW_R2))
    if rules == "quick" and "has_outliers" in have:
        lines.append(rule(~is_class & F.col("has_outliers"), OUTLIERS))
    lines += [F.lit(text) for text in GENERAL[rules]]
    given = F.filter(F.array(*lines), lambda x: x.isNotNull())
    rows = results.select(*keys, F.posexplode(given).alias("position", "suggestion"))
    return rows.withColumn("position", F.col("position") + 1)
