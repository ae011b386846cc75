"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATING = (T.FloatType, T.DoubleType)


def named(name: str) -> Column:
    """Reference a column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, with underscores added until no column of the tables is called so."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN in a floating column."""
    col = named(name)
    if isinstance(df.schema[name].dataType, FLOATING):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL, so that aggregates skip it."""
    col = named(name)
    if isinstance(df.schema[name].dataType, FLOATING):
        return F.nanvl(col, F.lit(None).cast(df.schema[name].dataType))
    return col


def number(df: DataFrame, name: str) -> Column:
    """``present`` as double."""
    return present(df, name).cast("double")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column."""
    return df.select(*[present(df, c).alias(c) for c in df.columns])


def json_safe(col: Column) -> Column:
    """NaN and infinities become NULL."""
    col = col.cast("double")
    inf = F.lit(float("inf"))
    return F.when(~F.isnan(col) & (F.abs(col) != inf), col)


def ratio(num: Column, den: Column) -> Column:
    """num / den as double; NULL where the denominator is 0."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, 2 decimals, half to even; an empty whole gives 0."""
    return F.bround(F.coalesce(ratio(part, whole) * 100, F.lit(0.0)), 2)


def outside(col: Column, low, high) -> Column:
    """Out-of-range test that is false (not NULL) for missing values."""
    return F.coalesce((col < low) | (col > high), F.lit(False))


def constant(value) -> Column:
    """A double literal, NULL for None."""
    return F.lit(None if value is None else float(value)).cast("double")


def sample_skewness(n: Column, g1: Column, spread: Column) -> Column:
    """Bias-corrected skewness G1 from the population value; 0 for a constant, NULL below 3 rows."""
    n = n.cast("double")
    fixed = F.when(spread == 0, F.lit(0.0)).otherwise(g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
    return F.when(n >= 3, fixed)


def sample_kurtosis(n: Column, g2: Column, spread: Column) -> Column:
    """Bias-corrected excess kurtosis G2; 0 for a constant, NULL below 4 rows."""
    n = n.cast("double")
    scale = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    fixed = F.when(spread == 0, F.lit(0.0)).otherwise(scale * ((n + 1) * g2 + 6))
    return F.when(n >= 4, fixed)


def equal_width_bin(col: Column, low, width, bins: int, right_closed: bool) -> Column:
    """0-based equal-width bin of ``col`` from ``low`` on, both ends of the range included.

    The arithmetic guess can be off by one next to an edge, so it is checked against the edges
    themselves. ``right_closed`` puts a value that equals an inner edge into the lower bin.
    """
    guess = F.least(F.greatest(F.floor((col - low) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    lower, upper = guess * width + low, (guess + 1) * width + low
    if right_closed:
        down, up = (col <= lower) & (guess > 0), (col > upper) & (guess < bins - 1)
    else:
        down, up = (col < lower) & (guess > 0), (col >= upper) & (guess < bins - 1)
    return F.when(col.isNotNull(), guess + F.when(down, -1).when(up, 1).otherwise(0))


def score_band(col: Column) -> Column:
    return F.when(col > 0.8, "high").when(col > 0.5, "medium").otherwise("low")


def correlation_band(col: Column) -> Column:
    return F.when(F.abs(col) > 0.7, "strong").when(F.abs(col) > 0.4, "moderate").otherwise("weak")


def hash_percent(*keys: Column, seed: str = "") -> Column:
    """0..99 from the md5 of the key: the same row gets the same number in every plan."""
    return F.pmod(hash_number(*keys, seed=seed), F.lit(100)).cast("int")


def hash_text(*keys: Column, seed: str = "") -> Column:
    parts = [F.coalesce(k.cast("string"), F.lit("")) for k in keys]
    text = parts[0] if len(parts) == 1 and not seed else F.concat_ws("|", F.lit(seed), *parts) if seed else F.concat_ws("|", *parts)
    return F.md5(text)


def hash_number(*keys: Column, seed: str = "") -> Column:
    return F.conv(F.substring(hash_text(*keys, seed=seed), 1, 8), 16, 10).cast("bigint")


def long_rows(row: DataFrame, structs: list[Column], schema: str = "") -> DataFrame:
    """Unfold a one-row aggregate into one row per struct, inside the JVM; without structs an empty table of ``schema``."""
    if not structs:
        return row.sparkSession.createDataFrame([], schema)
    return row.select(F.inline(F.array(*structs)))


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType)


def _entries_for_maps(col: Column, kind: T.DataType) -> Column:
    """The value with every map in it as its entries in key order, which can be compared, grouped and hashed."""
    if not _holds_map(kind):
        return col
    if isinstance(kind, T.MapType):
        entry = lambda e: F.struct(_entries_for_maps(e["key"], kind.keyType).alias("key"), _entries_for_maps(e["value"], kind.valueType).alias("value"))
        return F.array_sort(F.transform(F.map_entries(col), entry))
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: _entries_for_maps(x, kind.elementType))
    fields = [_entries_for_maps(col.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
    return F.when(col.isNotNull(), F.struct(*fields))


def comparable(df: DataFrame) -> list[Column]:
    """What rows are compared by: every column, NaN counting as NULL and maps as their sorted entries at any depth."""
    return [(_entries_for_maps(named(f.name), f.dataType) if _holds_map(f.dataType) else present(df, f.name)).alias(f.name) for f in df.schema]


def melt(df: DataFrame, cols: list[str], value=None, extra: dict[str, list] | None = None) -> DataFrame:
    """One row (c, v, ...) per input row and column, c being the position in ``cols``.

    ``extra`` adds per-column numbers, looked up by c. Aggregates over many columns are grouped by
    c afterwards. The generated code then holds each aggregate once instead of once per column,
    which keeps it small enough for the JIT whatever the width of the table, and every task still
    reduces its rows to one per column.
    """
    value = value or number
    if not cols:
        more = "".join(f", {k} double" for k in extra or {})
        return df.sparkSession.createDataFrame([], "c int, v double" + more)
    names = [str(i) for i in range(len(cols))]
    wide = df.select(*[value(df, c).alias(n) for n, c in zip(names, cols)])
    long = wide.unpivot([], [named(n) for n in names], "c", "v").withColumn("c", F.col("c").cast("int"))
    looked_up = {k: F.get(F.array(*[F.lit(x) for x in xs]), F.col("c")) for k, xs in (extra or {}).items()}
    return long.withColumns(looked_up) if looked_up else long
