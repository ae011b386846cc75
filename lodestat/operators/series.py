"""Time series: detection of the date column, extraction and down-sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.functions.columns import named, number
from lodestat.operators.ordered import MAX_GROUP_ROWS, running
from lodestat.operators.schema import categorical_columns, columns_of, need, need_numeric, numeric_columns


def detect_datetime(df: DataFrame) -> list[str]:
    """Temporal columns, then text columns whose present values all parse as timestamps."""
    texts = categorical_columns(df)
    if not texts:
        return columns_of(df, "temporal")
    row = df.agg(
        *[F.count(named(c)).alias(f"n{i}") for i, c in enumerate(texts)],
        *[F.count(named(c).try_cast("timestamp")).alias(f"p{i}") for i, c in enumerate(texts)],
    ).first()
    return columns_of(df, "temporal") + [c for i, c in enumerate(texts) if row[f"n{i}"] and row[f"n{i}"] == row[f"p{i}"]]


def _timestamp(df: DataFrame, column: str) -> Column:
    col = named(column)
    return col.try_cast("timestamp_ntz") if column in categorical_columns(df) else col.cast("timestamp_ntz")


def time_series(df: DataFrame, time: str | None = None, values: list[str] | None = None) -> DataFrame:
    """Long series (series, t, value) of the first date column and the first 3 numeric columns, NULLs dropped."""
    if time is None:
        found = detect_datetime(df)
        if not found:
            return df.sparkSession.createDataFrame([], "series string, t timestamp_ntz, value double")
        time = found[0]
    values = numeric_columns(df)[:3] if values is None else values
    need(df, time)
    need_numeric(df, *values)
    points = F.array(*[F.struct(F.lit(v).alias("series"), number(df, v).alias("value")) for v in values])
    rows = df.select(_timestamp(df, time).alias("t"), F.inline(points))
    return rows.dropna(subset=["t", "value"]).select("series", "t", "value")


def downsample(
    series: DataFrame,
    points: int = 1000,
    rounding: str = "floor",
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Every step-th row of each series in (t, value) order, once it has more than ``points`` rows.

    step is n div points (``floor``) or ceil(n / points) (``ceil``). Equal (t, value) rows are
    merged with a count first, so a hot instant is one row; the running count then tells which
    rows hold a multiple of the step.
    """
    merged = series.groupBy("series", "t", "value").agg(F.count("*").alias("n"))
    sizes = {r["series"]: r["n"] for r in series.groupBy("series").agg(F.count("*").alias("n")).collect()}
    steps = {}
    for name, n in sizes.items():
        steps[name] = 1 if n <= points else (n // points if rounding == "floor" else math.ceil(n / points))
    if not steps:
        return series.select("series", "t", "value", F.lit(0).cast("bigint").alias("position"))
    counted = running(merged, ["series"], [F.col("t"), F.col("value")], {"upto": "n"}, max_group_rows=max_group_rows, group_rows=max(sizes.values()))
    lookup = F.create_map(*[F.lit(x) for pair in steps.items() for x in pair])
    step = F.element_at(lookup, F.col("series"))
    before = F.col("upto") - F.col("n")
    first, last = F.ceil(before / step).cast("bigint"), F.ceil(F.col("upto") / step).cast("bigint") - 1
    kept = counted.where(first <= last).select("series", "t", "value", F.explode(F.sequence(first, last)).alias("position"))
    return kept.select("series", "t", "value", "position")


def format_date(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd")
