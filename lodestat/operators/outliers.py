"""Outlier detection and removal. Bounds are fitted once and become literals in the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.errors import UnknownOperation
from lodestat.functions.columns import long_rows, number, outside, percent
from lodestat.operators.quantiles import exact_quantiles
from lodestat.operators.schema import need, numeric_columns


def fences(df: DataFrame, cols: list[str], k: float = 1.5) -> dict[str, tuple[float, float] | None]:
    """Q1 - k * IQR and Q3 + k * IQR per column, from exact quartiles."""
    out = {}
    for c, (q1, q3) in exact_quantiles(df, cols, [0.25, 0.75]).items():
        out[c] = None if q1 is None else (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    return out


def _numeric_targets(df: DataFrame, cols: list[str] | None) -> list[str]:
    numeric = numeric_columns(df)
    if cols:
        need(df, *cols)
        return [c for c in cols if c in numeric]
    return numeric


def outlier_flags(df: DataFrame, cols: list[str], method: str, k: float) -> dict[str, Column]:
    """A never-NULL test per column; missing values are not outliers."""
    if method == "iqr":
        found = fences(df, cols, k)
        return {c: F.lit(False) if b is None else outside(number(df, c), *b) for c, b in found.items()}
    if method != "zscore":
        raise UnknownOperation(f"unknown outlier method {method}")
    row = df.agg(
        F.count("*").alias("rows"),
        *[F.avg(number(df, c)).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(number(df, c)).alias(f"s{i}") for i, c in enumerate(cols)],
    ).first()
    flags = {}
    for i, c in enumerate(cols):
        mean, std = row[f"m{i}"], row[f"s{i}"]
        flags[c] = F.coalesce(F.abs(number(df, c) - mean) / std > k, F.lit(False)) if std else F.lit(False)
    return flags


def _any(flags: dict[str, Column]) -> Column:
    hit: Column = F.lit(False)
    for flag in flags.values():
        hit = hit | flag
    return hit


def detect_outliers(df: DataFrame, cols: list[str] | None = None, method: str = "iqr", k: float = 1.5, samples: int = 5) -> DataFrame:
    """Per column: outliers, their share of present values, rows flagged in any column, sample values.

    The samples are the smallest outliers: a table has no first rows. Every task keeps only
    ``samples`` of them per column.
    """
    cols = _numeric_targets(df, cols)
    if not cols:
        schema = "column string, outlier_count bigint, percentage double, total_outlier_rows bigint, sample_values array<double>"
        return df.sparkSession.createDataFrame([], schema)
    flags = outlier_flags(df, cols, method, k)
    row = df.agg(
        F.count_if(_any(flags)).alias("total"),
        *[F.count_if(flags[c]).alias(f"o{i}") for i, c in enumerate(cols)],
        *[F.count(number(df, c)).alias(f"n{i}") for i, c in enumerate(cols)],
    )
    counts = long_rows(
        row,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"o{i}").alias("outlier_count"),
                percent(F.col(f"o{i}"), F.col(f"n{i}")).alias("percentage"),
                F.col("total").alias("total_outlier_rows"),
            )
            for i, c in enumerate(cols)
        ],
    )
    tagged = F.array(*[F.struct(F.lit(c).alias("column"), F.when(flags[c], number(df, c)).alias("value")) for c in cols])
    by_value = Window.partitionBy("column").orderBy("value")
    shown = df.select(F.inline(tagged)).where("value IS NOT NULL").withColumn("at", F.row_number().over(by_value))
    shown = shown.where(F.col("at") <= samples).groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("sample_values"))
    none = F.array().cast("array<double>")
    # one row per column on the broadcast side
    return counts.join(F.broadcast(shown), "column", "left").withColumn("sample_values", F.coalesce("sample_values", none))


def total_outlier_rows(df: DataFrame, cols: list[str] | None = None, method: str = "iqr", k: float = 1.5) -> int:
    cols = _numeric_targets(df, cols)
    return df.agg(F.count_if(_any(outlier_flags(df, cols, method, k)))).first()[0]


def remove_outliers(df: DataFrame, cols: list[str] | None = None, method: str = "iqr", k: float = 1.5) -> DataFrame:
    """Drop rows flagged in any column; all bounds come from the input, rows with NULL stay."""
    return df.where(~_any(outlier_flags(df, _numeric_targets(df, cols), method, k)))


def outlier_report(df: DataFrame) -> DataFrame:
    """Columns with IQR outliers and their share of all rows."""
    cols = numeric_columns(df)
    flags = outlier_flags(df, cols, "iqr", 1.5)
    row = df.agg(F.count("*").alias("rows"), *[F.count_if(flags[c]).alias(f"o{i}") for i, c in enumerate(cols)])
    report = long_rows(
        row,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"o{i}").alias("count"),
                percent(F.col(f"o{i}"), F.col("rows")).alias("percentage"),
                F.lit("clip").alias("recommendation"),
            )
            for i, c in enumerate(cols)
        ],
        "column string, count bigint, percentage double, recommendation string",
    )
    return report.where(F.col("count") > 0)
