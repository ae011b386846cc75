"""Column classes, dataset information and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.errors import NotNumeric, UnknownColumn
from lodestat.functions.columns import is_missing, long_rows, named

TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)


def kind(field: T.StructField) -> str:
    if isinstance(field.dataType, T.NumericType):
        return "numeric"
    if isinstance(field.dataType, T.StringType):
        return "categorical"
    if isinstance(field.dataType, TEMPORAL):
        return "temporal"
    return "other"


def columns_of(df: DataFrame, wanted: str) -> list[str]:
    return [f.name for f in df.schema if kind(f) == wanted]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, "numeric")


def categorical_columns(df: DataFrame) -> list[str]:
    return columns_of(df, "categorical")


def need(df: DataFrame, *cols: str) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise UnknownColumn(f"columns not in the table: {missing}; it has {df.columns}")


def need_numeric(df: DataFrame, *cols: str) -> None:
    need(df, *cols)
    bad = [c for c in cols if kind(df.schema[c]) != "numeric"]
    if bad:
        raise NotNumeric(f"columns are not numeric: {bad}")


def classify_columns(df: DataFrame) -> DataFrame:
    """One row per column: ordinal, name, type and class. Needs no job on the data."""
    rows = [(i, f.name, f.dataType.simpleString(), kind(f)) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, column string, dtype string, kind string")


def dataset_info(df: DataFrame) -> DataFrame:
    """Per column: type, row count, present and missing values, in one aggregate pass."""
    row = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(is_missing(df, f.name)).alias(f"m{i}") for i, f in enumerate(df.schema)],
    )
    return long_rows(
        row,
        [
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.col("rows").alias("rows"),
                F.lit(len(df.columns)).alias("columns"),
                (F.col("rows") - F.col(f"m{i}")).alias("non_null"),
                F.col(f"m{i}").alias("missing"),
            )
            for i, f in enumerate(df.schema)
        ],
    )


def basic_info(df: DataFrame) -> DataFrame:
    """Row count and number of columns in all, numeric and categorical."""
    return df.agg(F.count("*").alias("num_rows")).select(
        "num_rows",
        F.lit(len(df.columns)).alias("num_columns"),
        F.lit(len(numeric_columns(df))).alias("numeric_columns"),
        F.lit(len(categorical_columns(df))).alias("categorical_columns"),
    )


def align_features(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """Keep the known features that are present; also return the absent ones.

    With none present, all numeric columns are kept.
    """
    known = [n for n in names if n in df.columns] or numeric_columns(df)
    return df.select(*[named(n) for n in known]), [n for n in names if n not in df.columns]


def split_xy(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    need(df, target)
    return df.select(*[named(c) for c in df.columns if c != target]), df.select(named(target))


def keep_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows with low <= column <= high; missing values do not pass."""
    need_numeric(df, column)
    inside = named(column).between(low, high)
    return df.where(inside)


def drop_missing(df: DataFrame, *cols: str) -> DataFrame:
    """Rows in which every named column (all columns by default) is present."""
    keep: Column = F.lit(True)
    for c in cols or df.columns:
        keep = keep & ~is_missing(df, c)
    return df.where(keep)


def preview(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """First n rows in an explicit order; runs as a per-partition top-n."""
    return df.orderBy(*[named(c) for c in order]).limit(n)
