"""Column statistics. Each function is one aggregate pass unless it says otherwise."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.functions.columns import (
    comparable,
    is_missing,
    long_rows,
    melt,
    named,
    number,
    percent,
    present,
    ratio,
    sample_kurtosis,
    sample_skewness,
    unused,
)
from lodestat.operators.quantiles import exact_quantiles
from lodestat.operators.schema import categorical_columns, need, need_numeric, numeric_columns

QUARTILES = [0.25, 0.5, 0.75]


# ---------------------------------------------------------------- missing values and duplicates


def missing_counts(df: DataFrame) -> DataFrame:
    """ordinal, column, missing, rows for every column."""
    row = df.agg(F.count("*").alias("rows"), *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)])
    return long_rows(
        row,
        [
            F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.col(f"m{i}").alias("missing"), F.col("rows"))
            for i, c in enumerate(df.columns)
        ],
    )


def missing_values(df: DataFrame) -> DataFrame:
    """Missing per column with the table's total and its share of all cells."""
    total: Column = F.lit(0).cast("bigint")
    for i in range(len(df.columns)):
        total = total + F.col(f"m{i}")
    row = df.agg(F.count("*").alias("rows"), *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)])
    row = row.withColumn("total", total)
    cells = F.col("rows") * len(df.columns)
    return long_rows(
        row,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"m{i}").alias("missing"),
                F.col("total").alias("total_missing"),
                percent(F.col("total"), cells).alias("missing_percentage"),
            )
            for i, c in enumerate(df.columns)
        ],
    )


def missing_chart(df: DataFrame, rules: str = "dashboard") -> DataFrame:
    """Columns with missing values; position follows the table (dashboard) or the count (engine)."""
    hit = missing_counts(df).where(F.col("missing") > 0)
    if rules == "engine":
        order, share = [F.desc("missing"), F.asc("ordinal")], ratio(F.col("missing"), F.col("rows")) * 100
    else:
        order, share = [F.asc("ordinal")], percent(F.col("missing"), F.col("rows"))
    # at most one row per column of the table, so the unpartitioned window is bounded by its width
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    return hit.select(place.alias("position"), "column", "missing", share.alias("percentage"))


def duplicate_count(df: DataFrame) -> int:
    """Rows beyond the first of each group of equal rows; NaN equals NULL, maps are compared by their entries.

    Only a 64-bit row hash is shuffled at first, pre-counted per task. Rows whose hash repeats are then compared in full, so a hash
    collision cannot be counted as a duplicate. Copies of one row are split over tasks by the join and counted there before they meet.
    """
    hash_name = unused("_h", df)
    rows = df.select(*comparable(df))
    hashed = rows.withColumn(hash_name, F.xxhash64(*[named(c) for c in rows.columns]) if rows.columns else F.lit(0))
    repeated = hashed.groupBy(hash_name).agg(F.count("*").alias("n")).where("n > 1").select(hash_name)
    suspects = hashed.join(repeated, hash_name, "left_semi")
    sizes = suspects.groupBy(*[named(c) for c in suspects.columns]).agg(F.count("*").alias(hash_name + "n")).select(hash_name + "n")
    return sizes.agg(F.coalesce(F.sum(F.col(hash_name + "n") - 1), F.lit(0))).first()[0]


# ---------------------------------------------------------------- numeric summaries


def describe(df: DataFrame, cols: list[str] | None = None, probs: list[float] | None = None) -> DataFrame:
    """count, mean, sample std, min, 25/50/75 % (interpolated, exact), max, G1 skewness, G2 kurtosis."""
    cols = numeric_columns(df) if cols is None else cols
    need_numeric(df, *cols)
    schema = "column string, count bigint, mean double, std double, min double, q25 double, q50 double, q75 double, max double"
    schema += ", skew double, kurtosis double, zeros bigint"
    n, spread = F.col("n"), F.col("max") - F.col("min")
    moments = melt(df, cols).groupBy("c").agg(
        F.count("v").alias("n"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.skewness("v").alias("g1"),
        F.kurtosis("v").alias("g2"),
        F.count_if(F.col("v") == 0).alias("zeros"),
    )
    skew, kurtosis = sample_skewness(n, F.col("g1"), spread), sample_kurtosis(n, F.col("g2"), spread)
    # one row per column
    found = {r["c"]: r for r in moments.withColumns({"skew": skew, "kurtosis": kurtosis}).collect()}
    bounds = {cols[i]: (r["n"], r["min"], r["max"]) for i, r in found.items()}
    quart = exact_quantiles(df, cols, QUARTILES, bounds=bounds)
    rows = []
    for i, c in enumerate(cols):
        r = found[i].asDict() if i in found else {"n": 0, "zeros": 0}
        std = r["std"] if r["n"] > 1 else None
        # an infinite value leaves no spread or shape to speak of
        mean, std, skew, kurtosis = (None if x is None or x != x else x for x in (r.get("mean"), std, r.get("skew"), r.get("kurtosis")))
        rows.append((c, r["n"], mean, std, r.get("min"), *quart[c], r.get("max"), skew, kurtosis, r["zeros"]))
    return df.sparkSession.createDataFrame(rows, schema)


def distinct_counts(df: DataFrame, cols: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Distinct present values per column.

    Columns of one class (whole numbers and dates, floating, text) are melted to (column, value)
    pairs of one narrow type, which every task reduces to its distinct pairs before the shuffle;
    one count over many columns would instead copy each row once per column at full width.
    ``approx`` swaps the shuffle of values for mergeable sketches.
    """
    cols = df.columns if cols is None else cols
    need(df, *cols)
    parts = []
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, distinct bigint")
    if approx:
        row = df.agg(*[F.approx_count_distinct(present(df, c)).alias(f"d{i}") for i, c in enumerate(cols)])
        return long_rows(row, [F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("distinct")) for i, c in enumerate(cols)])
    groups: dict[str, list[str]] = {}
    for c in cols:
        groups.setdefault(_value_class(df.schema[c].dataType), []).append(c)
    for name, members in groups.items():
        if name == "other":
            row = df.agg(*[F.count_distinct(present(df, c)).alias(f"d{i}") for i, c in enumerate(members)])
            parts.append(long_rows(row, [F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("distinct")) for i, c in enumerate(members)]))
            continue
        pairs = melt(df, members, _AS_CLASS[name]).where("v IS NOT NULL").groupBy("c", "v").agg(F.lit(1).alias("one"))
        counts = pairs.groupBy("c").agg(F.count("*").alias("distinct"))
        labels = df.sparkSession.createDataFrame(list(enumerate(members)), "c int, column string")
        # one row per column on both sides
        joined = labels.join(F.broadcast(counts), "c", "left")
        parts.append(joined.select("column", F.coalesce("distinct", F.lit(0)).cast("bigint").alias("distinct")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _value_class(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.IntegralType, T.BooleanType, T.DateType, T.TimestampType)):
        return "whole"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "floating"
    return "text" if isinstance(dtype, T.StringType) else "other"


def _whole(df: DataFrame, c: str) -> Column:
    dtype = df.schema[c].dataType
    if isinstance(dtype, T.DateType):
        return F.unix_date(named(c)).cast("bigint")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(named(c))
    return named(c).cast("bigint")


_AS_CLASS = {"whole": _whole, "floating": number, "text": present}


def constant_columns(df: DataFrame) -> list[str]:
    """Columns with exactly one present value, found by min = max without counting distinct values."""
    cols = [f.name for f in df.schema if f.dataType.typeName() != "map"]
    row = df.agg(*[(F.min(present(df, c)) == F.max(present(df, c))).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[f"s{i}"]]


def numeric_stats(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``describe`` plus distinct and zero counts."""
    cols = numeric_columns(df) if cols is None else cols
    return describe(df, cols).join(F.broadcast(distinct_counts(df, cols)), "column")


def quantile(df: DataFrame, column: str, prob: float) -> float | None:
    need_numeric(df, column)
    return exact_quantiles(df, [column], [prob])[column][0]


def value_ranges(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """max - min per numeric column."""
    cols = numeric_columns(df) if cols is None else cols
    row = df.agg(F.count("*").alias("rows"), *[(F.max(number(df, c)) - F.min(number(df, c))).alias(f"r{i}") for i, c in enumerate(cols)])
    return long_rows(row, [F.struct(F.lit(c).alias("column"), F.col(f"r{i}").alias("range")) for i, c in enumerate(cols)], "column string, range double")


def sigma_outliers(df: DataFrame, cols: list[str] | None = None, k: float = 3.0) -> DataFrame:
    """Per column, whether any value lies more than k sample deviations from the mean.

    The farthest values are the minimum and maximum, so one pass is enough.
    """
    cols = numeric_columns(df) if cols is None else cols
    aggs = []
    for i, c in enumerate(cols):
        v = number(df, c)
        aggs += [F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    structs = []
    for i, c in enumerate(cols):
        far = F.greatest(F.col(f"hi{i}") - F.col(f"m{i}"), F.col(f"m{i}") - F.col(f"lo{i}")) > k * F.col(f"s{i}")
        structs.append(F.struct(F.lit(c).alias("column"), F.coalesce(far, F.lit(False)).alias("has_outliers")))
    return long_rows(df.agg(F.count("*").alias("rows"), *aggs), structs, "column string, has_outliers boolean")


def has_sigma_outliers(df: DataFrame, cols: list[str] | None = None, k: float = 3.0) -> bool:
    return bool(sigma_outliers(df, cols, k).agg(F.bool_or("has_outliers")).first()[0])


# ---------------------------------------------------------------- categorical summaries


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """column, value, count over several columns in one scan; each task pre-counts its rows."""
    need(df, *cols)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), present(df, c).cast("string").alias("value")) for c in cols])
    return df.select(F.inline(pairs)).where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("count"))


def top_values(df: DataFrame, cols: list[str] | None = None, k: int = 10, max_columns: int | None = 8) -> DataFrame:
    """The k most frequent values per column, ties by value.

    ``row_number() <= k`` makes Spark cut every partition to k rows per column before the shuffle.
    """
    if cols is None:
        cols = categorical_columns(df)[:max_columns]
    by_count = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    ranked = value_counts(df, cols).withColumn("rank", F.row_number().over(by_count))
    return ranked.where(F.col("rank") <= k).select("column", "rank", "value", "count")


def categorical_stats(df: DataFrame, cols: list[str] | None = None, k: int = 10) -> DataFrame:
    """Distinct count, most common value with its count and the top k per categorical column."""
    cols = categorical_columns(df) if cols is None else cols
    top = top_values(df, cols, k).groupBy("column").agg(
        F.max_by("value", -F.col("rank")).alias("most_common"),
        F.max("count").alias("most_common_count"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "value", "count"))),
            lambda t: F.concat(t["value"], F.lit("="), t["count"].cast("string")),
        ).alias("top"),
    )
    result = distinct_counts(df, cols).join(F.broadcast(top), "column", "left")
    return result.select(
        "column",
        F.col("distinct").alias("unique_values"),
        "most_common",
        F.coalesce("most_common_count", F.lit(0)).alias("most_common_count"),
        F.coalesce(F.array_join("top", "; "), F.lit("")).alias("top_values"),
    )


def modes(df: DataFrame, cols: list[str]) -> dict[str, object]:
    """Most frequent value per column, the smallest one on ties, None if nothing is present.

    Counted with a grouped aggregate: no task keeps a value-to-count map of a whole column.
    """
    found = {}
    for c in cols:
        counts = df.select(present(df, c).alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
        top = counts.orderBy(F.desc("n"), F.asc("v")).limit(1).collect()
        found[c] = top[0]["v"] if top else None
    return found


def class_balance(df: DataFrame, column: str) -> DataFrame:
    """Share of each present class; ``imbalanced`` if the rarest has under 10 %."""
    need(df, column)
    counts = df.select(present(df, column).cast("string").alias("class")).where("class IS NOT NULL")
    counts = counts.groupBy("class").agg(F.count("*").alias("count"))
    facts = counts.agg(F.sum("count").alias("total"), F.min("count").alias("rarest")).first()
    total = F.lit(facts["total"])
    return counts.select(
        "class",
        "count",
        ratio(F.col("count"), total).alias("share"),
        (ratio(F.lit(facts["rarest"]), total) < 0.1).alias("imbalanced"),
    )


# ---------------------------------------------------------------- correlation


def corr_matrix(df: DataFrame, cols: list[str] | None = None, rules: str = "engine") -> DataFrame:
    """Pearson correlation of every ordered pair, from the rows where both values are present.

    A column without spread has no correlation: NULL (engine) or 0 (dashboard, first 10 columns).
    One pass finds means and columns without spread. In one more each task keeps the cross products of the centred columns and
    of their masks as matrices, whatever the number of columns, and sends one row per pair.
    """
    if cols is None:
        cols = numeric_columns(df)
        cols = cols[:10] if rules == "dashboard" else cols
    need_numeric(df, *cols)
    schema = "i int, j int, col1 string, col2 string, r double"
    if not cols:
        return df.sparkSession.createDataFrame([], schema)
    facts = {r["c"]: r for r in melt(df, cols).groupBy("c").agg(F.avg("v").alias("mean"), (F.min("v") == F.max("v")).alias("flat")).collect()}
    flat = [i not in facts or facts[i]["flat"] is not False for i in range(len(cols))]
    means = np.array([facts[i]["mean"] if i in facts and facts[i]["mean"] is not None else 0.0 for i in range(len(cols))])
    names = [str(i) for i in range(len(cols))]
    parts = ["n", "sx", "sy", "sxx", "syy", "sxy"]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(names)
        total = {k: np.zeros((width, width)) for k in ("n", "sx", "sxx", "sxy")}
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in names], axis=1) if batch.num_rows else np.zeros((0, width))
            mask = ~np.isnan(x)
            x = np.where(mask, x - means, 0.0)
            mask = mask.astype(np.float64)
            total["n"] += mask.T @ mask
            total["sx"] += x.T @ mask
            total["sxx"] += (x * x).T @ mask
            total["sxy"] += x.T @ x
        i, j = np.triu_indices(width)
        sums = [total["n"][i, j], total["sx"][i, j], total["sx"][j, i], total["sxx"][i, j], total["sxx"][j, i], total["sxy"][i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *map(pa.array, sums)], ["i", "j", *parts])

    wide = df.select(*[number(df, c).alias(n) for n, c in zip(names, cols, strict=True)])
    sums = wide.mapInArrow(products, "i int, j int, " + ", ".join(f"{k} double" for k in parts)).groupBy("i", "j").agg(*[F.sum(k).alias(k) for k in parts])

    def spread(square: str, linear: str) -> Column:
        whole = F.col("n") * F.col(square)
        rest = whole - F.col(linear) * F.col(linear)
        return F.when(rest > 1e-12 * whole, rest)  # less is rounding: the pair's rows hold one value

    r = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.sqrt(spread("sxx", "sx")) * F.sqrt(spread("syy", "sy")))
    # an infinite value has no correlation either
    r = F.nanvl(F.when(F.col("i") == F.col("j"), F.when(r.isNotNull() & ~F.isnan(r), 1.0)).otherwise(r), F.lit(None).cast("double"))
    known = sums.where(~(F.col("i").isin(*[k for k in range(len(cols)) if flat[k]]) | F.col("j").isin(*[k for k in range(len(cols)) if flat[k]]))) if any(flat) else sums
    known = known.select("i", "j", r.alias("r"))
    known = known.union(known.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "r"))
    spark = df.sparkSession
    labels = spark.createDataFrame(list(enumerate(cols)), "i int, col1 string")
    pairs = labels.crossJoin(labels.select(F.col("i").alias("j"), F.col("col1").alias("col2")))  # of column names
    empty = F.lit(0.0) if rules == "dashboard" else F.lit(None).cast("double")
    # one row per pair of columns on the broadcast side
    return pairs.join(F.broadcast(known), ["i", "j"], "left").select("i", "j", "col1", "col2", F.coalesce("r", empty).alias("r"))


def strong_correlations(df: DataFrame, threshold: float = 0.7, cols: list[str] | None = None) -> DataFrame:
    """Upper-triangle pairs with |r| above the threshold."""
    return corr_matrix(df, cols).where((F.col("i") < F.col("j")) & (F.abs("r") > threshold)).select("col1", "col2", "r")


def top_correlations(df: DataFrame, k: int = 5, cols: list[str] | None = None) -> DataFrame:
    """The k pairs with the largest |r|, ties by name."""
    pairs = corr_matrix(df, cols).where((F.col("i") < F.col("j")) & F.col("r").isNotNull())
    return pairs.select("col1", "col2", F.abs("r").alias("abs_r")).orderBy(F.desc("abs_r"), "col1", "col2").limit(k)
