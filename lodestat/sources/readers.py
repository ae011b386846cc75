"""Readers for tables, CSV and JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.errors import EmptySource
from lodestat.functions.columns import named
from lodestat.operators.clean import NUMBER

# The texts a CSV reader takes for a missing value.
NA_TOKENS = [
    "", " ", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
WHOLE_NUMBER = r"^\s*[+-]?\d+\s*$"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table; filters and column choices made on it reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def normalize_na(df: DataFrame, tokens: list[str] | None = None) -> DataFrame:
    """Missing-value tokens in text columns become NULL."""
    tokens = [t.strip() for t in (NA_TOKENS if tokens is None else tokens)]

    def clean(f: T.StructField) -> Column:
        col = named(f.name)
        if not isinstance(f.dataType, T.StringType):
            return col
        return F.when(~F.trim(col).isin(tokens), col).alias(f.name)

    return df.select(*[clean(f) for f in df.schema])


def infer_types(df: DataFrame) -> DataFrame:
    """Give text columns the narrowest of bigint, double, boolean that fits every present value.

    One aggregate pass over all columns, run after ``normalize_na`` so that tokens do not force text.
    """
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    aggs = []
    for i, c in enumerate(texts):
        aggs += [
            F.count(named(c)).alias(f"n{i}"),
            F.bool_and(named(c).rlike(WHOLE_NUMBER)).alias(f"whole{i}"),
            F.bool_and(F.trim(named(c)).try_cast("bigint").isNotNull()).alias(f"int{i}"),
            F.bool_and(named(c).rlike(NUMBER)).alias(f"num{i}"),
            F.bool_and(named(c).isin("True", "False", "true", "false", "TRUE", "FALSE")).alias(f"bool{i}"),
        ]
    row = df.agg(*aggs).first()
    types = {}
    for i, c in enumerate(texts):
        if row[f"n{i}"]:
            if row[f"whole{i}"] and not row[f"int{i}"]:
                continue  # whole numbers beyond bigint: a double would lose digits, so they stay text
            types[c] = "bigint" if row[f"whole{i}"] else "double" if row[f"num{i}"] else "boolean" if row[f"bool{i}"] else None
    casts = {c: F.trim(named(c)).cast(t) for c, t in types.items() if t}
    return df.withColumns(casts) if casts else df


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, multi_line: bool = True) -> DataFrame:
    """CSV with a header. Malformed rows fail the read; an empty file raises ``EmptySource``.

    With a schema the file is read once. Without one the columns are read as text, missing-value
    tokens are cleared and the types are found in one more pass; give the schema for large files.
    Quoted values may hold line breaks; without them ``multi_line=False`` lets Spark split large files.
    """
    reader = spark.read.option("header", True).option("mode", "FAILFAST").option("escape", '"').option("multiLine", multi_line)
    if schema is not None:
        return reader.schema(schema).csv(path)
    raw = reader.csv(path)
    if not raw.columns:
        raise EmptySource(f"no header in {path}")
    return infer_types(normalize_na(raw))


def read_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None, multi_line: bool = True) -> DataFrame:
    """JSON records: an array per file (``multi_line``), or one record per line, which Spark can split."""
    reader = spark.read.option("multiLine", multi_line).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema is not None else reader).json(path)
