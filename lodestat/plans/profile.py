"""The full profile: every report and chart table of one rule set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.errors import UnknownOperation
from lodestat.operators import charts, quality, schema, series, stats


def column_profile(df: DataFrame) -> DataFrame:
    """Missing values and descriptive statistics of every column as one long table."""
    counts = stats.missing_counts(df)
    missing = counts.select("column", "missing", (F.col("rows") - F.col("missing")).alias("count"))
    numbers = stats.describe(df).drop("zeros", "count")
    # one row per column on the broadcast side
    return missing.join(F.broadcast(numbers), "column", "left")


def profile(df: DataFrame, rules: str = "dashboard") -> dict[str, DataFrame]:
    """Tables by name. The column limits of each rule set apply; the rows are never sampled for statistics."""
    if rules not in ("dashboard", "engine"):
        raise UnknownOperation(f"unknown rule set {rules}")
    numeric, texts = schema.numeric_columns(df), schema.categorical_columns(df)
    shown = texts[: 8 if rules == "dashboard" else 6]
    facts = quality.table_facts(df, texts if rules == "engine" else None)
    parts = {
        "basic_info": schema.basic_info(df),
        "missing_values": stats.missing_values(df),
        "missing_chart": stats.missing_chart(df, rules),
        "quality_score": quality.quality_score(df, rules, facts),
        "quality_issues": quality.quality_issues(df, rules, facts),
        "recommendations": quality.recommendations(df, rules),
    }
    if numeric:
        parts["numeric_stats"] = stats.describe(df) if rules == "dashboard" else stats.numeric_stats(df)
        parts["distributions"] = charts.histogram(df, rules=rules)
        parts["box_plots"], parts["box_plot_outliers"] = charts.box_plot(df)
    if texts:
        parts["categorical_counts"] = stats.top_values(df, shown)
    if rules == "dashboard":
        parts["insights"] = quality.insights(df)
    elif texts:
        parts["categorical_stats"] = stats.categorical_stats(df)
    if len(numeric) > 1:
        parts["correlations"] = stats.corr_matrix(df, rules=rules)
        parts["scatter_pairs"] = charts.scatter_pairs(df, rules=rules)
        if rules == "engine":
            parts["strong_correlations"] = stats.strong_correlations(df)
    if rules == "engine":
        parts["time_series"] = series.downsample(series.time_series(df))
    return parts
