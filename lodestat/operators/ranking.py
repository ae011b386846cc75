"""Ordering and banding of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.functions.columns import named
from lodestat.operators.ordered import MAX_GROUP_ROWS, running


def leaderboard(results: DataFrame, by: list[str] | None = None, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Rank models by test score, best first, ties by name; one ranking per value of ``by``."""
    order = [F.col("test_score").desc(), F.col("model_name").asc()]
    return running(results, by or [], order, row_number="rank", max_group_rows=max_group_rows)


def sort_models(results: DataFrame, key: str, ascending: bool = False) -> DataFrame:
    """Order by any metric, a missing one counting as 0; ties by name."""
    value = F.coalesce(named(key), F.lit(0))
    return results.orderBy(value.asc() if ascending else value.desc(), "model_name")


def overfit_gap(results: DataFrame) -> DataFrame:
    """Cross-validation score minus test score; a large gap hints at overfitting."""
    cv, test = F.coalesce("cv_score", F.lit(0.0)), F.coalesce("test_score", F.lit(0.0))
    return results.select("model_name", cv.alias("cv_score"), test.alias("test_score"), (cv - test).alias("gap"))
