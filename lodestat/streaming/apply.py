"""Fitted recipes and trained models on streams.

Fitting needs the whole table and stays a batch job; a fitted step or model is a projection, so
the same object runs on a streaming DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestat.ml.train import TrainedModel, score
from lodestat.plans.recipe import FittedRecipe


def clean_stream(stream: DataFrame, fitted: FittedRecipe) -> DataFrame:
    return fitted.transform(stream)


def score_stream(stream: DataFrame, trained: TrainedModel, keys: list[str]) -> DataFrame:
    return score(trained, stream, keys)


def write_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process everything that has arrived, append it to parquet and stop; restartable by its checkpoint."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
