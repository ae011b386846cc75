"""Chart data as long relational tables: histograms, density, box plots, scatter samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions.columns import (
    constant,
    equal_width_bin,
    hash_text,
    json_safe,
    melt,
    named,
    number,
    ratio,
)
from lodestat.operators.quantiles import exact_quantiles
from lodestat.operators.schema import need, need_numeric, numeric_columns
from lodestat.operators.stats import QUARTILES, corr_matrix

HISTOGRAM_COLUMNS = {"dashboard": 8, "engine": 6}


def _bounds(df: DataFrame, cols: list[str]) -> dict[str, tuple]:
    """count, min, max, mean, sample std per column: one row to the driver."""
    stats = [F.count("v"), F.min("v"), F.max("v"), F.avg("v"), F.stddev_samp("v")]
    rows = melt(df, cols, lambda t, c: json_safe(number(t, c))).groupBy("c").agg(*[s.alias(f"s{i}") for i, s in enumerate(stats)]).collect()
    found = {c: (0, None, None, None, None) for c in cols}
    found.update({cols[r["c"]]: tuple(r[f"s{i}"] for i in range(len(stats))) for r in rows})
    return found


def histogram(df: DataFrame, cols: list[str] | None = None, bins: int = 20, rules: str = "dashboard") -> DataFrame:
    """Equal-width histogram per column: column, bin, left edge, count, mean, median.

    Bins are closed on the left, the last one on both sides; a constant column spans v - 0.5 .. v + 0.5.
    One pass finds the bounds, one counts. Empty bins are listed with count 0.
    """
    if cols is None:
        cols = numeric_columns(df)[: HISTOGRAM_COLUMNS[rules]]
    need_numeric(df, *cols)
    found = {c: b for c, b in _bounds(df, cols).items() if b[0] > 0}
    finite = df.select(*[json_safe(number(df, c)).alias(c) for c in found])
    medians = exact_quantiles(finite, list(found), [0.5], bounds={c: b[:3] for c, b in found.items()})
    lows, widths, grid = [], [], []
    for c, (_, low, high, mean, _) in found.items():
        if low == high:
            low, high = low - 0.5, high + 0.5
        lows.append(low)
        widths.append((high - low) / bins)
        grid += [(c, len(lows) - 1, b, low + b * widths[-1], mean, medians[c][0]) for b in range(bins)]
    edges = df.sparkSession.createDataFrame(grid, "column string, c int, bin int, left_edge double, mean double, median double")
    if not found:
        return edges.drop("c").withColumn("count", F.lit(0).cast("bigint"))
    long = melt(df, list(found), lambda t, c: json_safe(number(t, c)), {"low": lows, "width": widths}).where("v IS NOT NULL")
    placed = long.select("c", equal_width_bin(F.col("v"), F.col("low"), F.col("width"), bins, False).cast("int").alias("bin"))
    counts = placed.groupBy("c", "bin").agg(F.count("*").alias("count"))
    # the counts have at most columns x bins rows, a bound known before the job
    return edges.join(F.broadcast(counts), ["c", "bin"], "left").fillna(0, ["count"]).drop("c")


def kde(df: DataFrame, column: str, grid: int = 200, bandwidth: float | None = None) -> DataFrame:
    """Gaussian density on ``grid`` points between min and max; bandwidth n^(-1/5) * sample std.

    Every row adds to every grid point; each task sums its rows and sends one row per point.
    """
    need_numeric(df, column)
    n, low, high, _, std = _bounds(df, [column])[column]
    schema = "point int, x double, density double"
    if not n or not std:
        return df.sparkSession.createDataFrame([], schema)
    h = bandwidth or n ** (-1 / 5) * std
    step = (high - low) / (grid - 1)
    grid_x = np.arange(grid) * step + low

    def densities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(grid)
        for batch in batches:
            v = batch.column("v").to_numpy()
            for at in range(0, len(v), 4096):
                z = (v[at : at + 4096, None] - grid_x) / h
                total += np.exp(-z * z / 2).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(grid, dtype=np.int32)), pa.array(total)], ["point", "total"])

    rows = df.select(json_safe(number(df, column)).alias("v")).where("v IS NOT NULL")
    sums = rows.mapInArrow(densities, "point int, total double").groupBy("point").agg(F.sum("total").alias("total"))
    points = df.sparkSession.range(grid).select(F.col("id").cast("int").alias("point"))
    scale = 1 / (n * h * (2 * 3.141592653589793) ** 0.5)
    return points.join(F.broadcast(sums), "point", "left").select(
        "point", (F.col("point") * step + low).alias("x"), (F.coalesce("total", F.lit(0.0)) * scale).alias("density")
    )


def box_plot(df: DataFrame, cols: list[str] | None = None, k: float = 1.5, max_outliers: int = 50) -> tuple[DataFrame, DataFrame]:
    """Five-number summary per column, and up to 50 outliers per column in value order."""
    cols = numeric_columns(df)[:6] if cols is None else cols
    need_numeric(df, *cols)
    quart = {c: q for c, q in exact_quantiles(df, cols, [0.0, *QUARTILES, 1.0]).items() if q[0] is not None}
    summary = df.sparkSession.createDataFrame(
        [(c, *q) for c, q in quart.items()], "column string, min double, q1 double, median double, q3 double, max double"
    )
    if not quart:
        return summary, df.sparkSession.createDataFrame([], "column string, position int, value double")
    by_value = Window.partitionBy("column").orderBy("value")
    lows = [q[1] - k * (q[3] - q[1]) for q in quart.values()]
    highs = [q[3] + k * (q[3] - q[1]) for q in quart.values()]
    names = F.array(*[F.lit(c) for c in quart])
    long = melt(df, list(quart), extra={"low": lows, "high": highs}).where((F.col("v") < F.col("low")) | (F.col("v") > F.col("high")))
    flagged = long.select(F.get(names, F.col("c")).alias("column"), F.col("v").alias("value"))
    outliers = flagged.withColumn("position", F.row_number().over(by_value))
    return summary, outliers.where(F.col("position") <= max_outliers).select("column", "position", "value")


def scatter_pairs(df: DataFrame, cols: list[str] | None = None, rules: str = "dashboard") -> DataFrame:
    """Column pairs worth a scatter plot, with their correlation.

    dashboard: |r| > 0.3 over the first 8 numeric columns, the first 6 pairs in column order;
    engine: every pair of the first 4 numeric columns.
    """
    if cols is None:
        cols = numeric_columns(df)[: 8 if rules == "dashboard" else 4]
    pairs = corr_matrix(df, cols).where("i < j")
    if rules == "dashboard":
        pairs = pairs.where(F.abs("r") > 0.3).orderBy("i", "j").limit(6)
    return pairs.select(F.col("col1").alias("x_column"), F.col("col2").alias("y_column"), F.col("r").alias("correlation"))


def hash_sample(df: DataFrame, n: int, keys: list[str], seed: str = "42") -> DataFrame:
    """n rows in the order of a keyed hash: a uniform sample that every plan and retry repeats."""
    need(df, *keys)
    return df.orderBy(hash_text(*[named(k) for k in keys], seed=seed), *[named(k) for k in keys]).limit(n)


def scatter_points(df: DataFrame, x: str, y: str, keys: list[str], n: int = 200, seed: str = "42") -> DataFrame:
    """Up to n sampled points where both values are present."""
    need_numeric(df, x, y)
    points = df.select(*[named(k) for k in keys], number(df, x).alias("x"), number(df, y).alias("y")).dropna(subset=["x", "y"])
    return hash_sample(points, n, keys, seed).select("x", "y")


def top_features(importances: DataFrame, k: int = 10) -> DataFrame:
    """The k largest importances, also relative to the largest one."""
    top = importances.orderBy(F.desc("importance"), "feature").limit(k)
    # at most k rows remain, so the unpartitioned window is bounded
    largest = F.max("importance").over(Window.partitionBy(F.lit(0)))
    return top.select("feature", "importance", ratio(F.col("importance"), largest).alias("relative"))


def normalize_confusion(cells: DataFrame) -> DataFrame:
    """Each confusion count as a share of the largest cell."""
    largest = cells.agg(F.max("count")).first()[0]
    return cells.withColumn("share", ratio(F.col("count"), constant(largest)))
