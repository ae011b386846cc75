"""Cleaning and feature steps.

A step is a dict such as ``{"op": "fill_na", "column": "age", "method": "mean"}``. ``OPERATIONS``
says for each op which statistics it needs, which columns it writes and how it is applied; the
recipe module uses that to fit many steps in few passes. The plain functions below fit and apply
one step.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.errors import LodestatError, TooManyCategories, UnknownOperation
from lodestat.functions.columns import comparable, constant, equal_width_bin, named, number, present, unused
from lodestat.operators.fitting import attach_codes, fit_statistics
from lodestat.operators.ordered import carry_value
from lodestat.operators.schema import categorical_columns, drop_missing, kind, need, need_numeric, numeric_columns

# text accepted as a number; Spark's own cast also takes Java suffixes such as "1d"
NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$"


@dataclass(frozen=True)
class Operation:
    apply: Callable[[DataFrame, dict, dict], DataFrame]
    needs: Callable[[DataFrame, dict], list[tuple]] = lambda df, p: []
    writes: Callable[[DataFrame, dict], set[str]] = lambda df, p: {p["column"]}
    changes_rows: Callable[[dict], bool] = lambda p: False


def _has(df: DataFrame, p: dict) -> bool:
    return p["column"] in df.columns


def _is_numeric(df: DataFrame, c: str) -> bool:
    return kind(df.schema[c]) == "numeric"


def _set(df: DataFrame, column: str, value: Column) -> DataFrame:
    return df.withColumn(column, value)


# ---------------------------------------------------------------- fill


def _fill_needs(df: DataFrame, p: dict) -> list[tuple]:
    c, method = p["column"], p.get("method")
    if not _has(df, p):
        return []
    if method == "mode":
        return [("mode", c)]
    if method == "mean" and _is_numeric(df, c):
        return [("mean", c)]
    if method == "median" and _is_numeric(df, c):
        return [("quantile", c, 0.5)]
    return []


def _fill_apply(df: DataFrame, p: dict, stats: dict) -> DataFrame:
    c, method = p["column"], p.get("method")
    if not _has(df, p):
        return df
    if method in ("ffill", "bfill"):
        ready = _set(df, c, present(df, c))
        return carry_value(ready, c, p.get("partition_by", []), p["order_by"], method == "bfill")
    if method in ("mean", "median") and _is_numeric(df, c):
        stat = stats[("mean", c)] if method == "mean" else stats[("quantile", c, 0.5)]
        return _set(df, c, F.coalesce(number(df, c), constant(stat)))
    if not method:
        if p.get("value") is None:
            return df
        value = p["value"]
    elif method == "mode":
        value = stats[("mode", c)]
        value = 0 if value is None else value
    else:
        value = 0
    dtype = df.schema[c].dataType
    if isinstance(value, float) and isinstance(dtype, T.IntegralType) and value != int(value):
        return _set(df, c, F.coalesce(number(df, c), constant(value)))
    if isinstance(value, (int, float)) and kind(df.schema[c]) == "temporal":
        raise LodestatError(f"{value} cannot fill the date column {c}")
    return _set(df, c, F.coalesce(present(df, c), F.lit(value).cast(dtype)))


# ---------------------------------------------------------------- cast and encode


def parse_number(df: DataFrame, column: str) -> Column:
    """Text to double, NULL where it is not a number."""
    col = named(column)
    if kind(df.schema[column]) == "categorical":
        return F.when(col.rlike(NUMBER), F.trim(col).try_cast("double"))
    return present(df, column).cast("double")


def _cast_apply(df: DataFrame, p: dict, stats: dict) -> DataFrame:
    c, to = p["column"], p["type"]
    if not _has(df, p):
        return df
    dtype = df.schema[c].dataType
    if to == "int":
        whole = named(c).cast("bigint") if isinstance(dtype, T.IntegralType) else parse_number(df, c).try_cast("bigint")
        return _set(df, c, F.coalesce(whole, F.lit(0).cast("bigint")))
    if to in ("float", "numeric"):
        return _set(df, c, F.nanvl(parse_number(df, c), constant(None)))
    if to == "datetime":
        return _set(df, c, named(c).try_cast("timestamp_ntz"))
    if to in ("categorical", "string"):
        return _set(df, c, present(df, c).cast("string"))
    raise UnknownOperation(f"unknown type {to}")


def _one_hot_columns(df: DataFrame, c: str, classes: list, drop_first: bool, limit: int | None) -> dict[str, Column]:
    if limit is not None and len(classes) > limit:
        raise TooManyCategories(f"{c} has more than {limit} categories; use label encoding or raise max_categories")
    shown = classes[1:] if drop_first else classes
    return {f"{c}_{v}": F.coalesce(present(df, c) == F.lit(v), F.lit(False)).cast("int") for v in shown}


def _one_hot(df: DataFrame, c: str, p: dict, stats: dict) -> DataFrame:
    limit = p.get("max_categories")
    added = _one_hot_columns(df, c, stats[("classes", c, limit)], p.get("drop_first", True), limit)
    kept = [named(x) for x in df.columns if x != c]
    return df.select(*kept, *[v.alias(k) for k, v in added.items()])


def _encode_needs(df: DataFrame, p: dict) -> list[tuple]:
    if not _has(df, p):
        return []
    if p["method"] == "one_hot":
        return [("classes", p["column"], p.get("max_categories"))]
    return [("codes", p["column"])]


def _encode_apply(df: DataFrame, p: dict, stats: dict) -> DataFrame:
    if not _has(df, p):
        return df
    if p["method"] == "one_hot":
        return _one_hot(df, p["column"], p, stats)
    if p["method"] == "label":
        return attach_codes(df, p["column"], stats[("codes", p["column"])], p["column"])
    raise UnknownOperation(f"unknown encoding {p['method']}")


def _dummies_needs(df: DataFrame, p: dict) -> list[tuple]:
    return [("classes", c, p.get("max_categories")) for c in categorical_columns(df) if c not in p.get("keep", [])]


def _dummies_apply(df: DataFrame, p: dict, stats: dict) -> DataFrame:
    for key in [k for k in stats if k[0] == "classes"]:
        if key[1] in df.columns and key[1] not in p.get("keep", []):
            df = _one_hot(df, key[1], p, stats)
    return df


# ---------------------------------------------------------------- outliers and scaling


def _fence_needs(df: DataFrame, p: dict) -> list[tuple]:
    c = p["column"]
    return [("quantile", c, 0.25), ("quantile", c, 0.75)] if _has(df, p) and _is_numeric(df, c) else []


def _fence_apply(df: DataFrame, p: dict, stats: dict) -> DataFrame:
    c, k = p["column"], float(p.get("threshold", 1.5))
    if not _fence_needs(df, p):
        return df
    q1, q3 = stats[("quantile", c, 0.25)], stats[("quantile", c, 0.75)]
    if p["method"] not in ("clip", "drop"):
        raise UnknownOperation(f"unknown outlier handling {p['method']}")
    if q1 is None:
        return df if p["method"] == "clip" else df.where(F.lit(False))
    low, high = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
    v = number(df, c)
    if p["method"] == "clip":
        # greatest and least skip NULL, hence the guard
        return _set(df, c, F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(low)), F.lit(high))))
    return df.where(v.between(F.lit(low), F.lit(high)))


def _scale_needs(df: DataFrame, p: dict) -> list[tuple]:
    need_numeric(df, p["column"])
    wanted = {"standard": ("mean", "std"), "minmax": ("min", "max")}.get(p["method"])
    if wanted is None:
        raise UnknownOperation(f"unknown scaling {p['method']}")
    return [(w, p["column"]) for w in wanted]


def _scale_apply(df: DataFrame, p: dict, stats: dict) -> DataFrame:
    c = p["column"]
    a, b = (stats[k] for k in _scale_needs(df, p))
    if a is None:
        return _set(df, c, number(df, c))
    width = (b if p["method"] == "standard" else b - a) or 1.0
    return _set(df, c, (number(df, c) - F.lit(a)) / F.lit(float(width)))


# ---------------------------------------------------------------- features


def _numeric_of(df: DataFrame, p: dict) -> list[str]:
    return [c for c in p["columns"] if c in df.columns and _is_numeric(df, c)]


def _polynomial(df: DataFrame, p: dict, stats: dict) -> DataFrame:
    d = p.get("degree", 2)
    return df.withColumns({f"{c}_pow{d}": F.pow(number(df, c), F.lit(float(d))) for c in _numeric_of(df, p)})


def _log(df: DataFrame, p: dict, stats: dict) -> DataFrame:
    added = {}
    for c in _numeric_of(df, p):
        v = number(df, c)
        added[f"{c}_log"] = F.log1p(F.when(v < 0, F.lit(0.0)).otherwise(v))
    return df.withColumns(added)


def _interaction(df: DataFrame, p: dict, stats: dict) -> DataFrame:
    if len(p["columns"]) < 2 or any(c not in df.columns for c in p["columns"][:2]):
        return df
    a, b = p["columns"][:2]
    need_numeric(df, a, b)
    return df.withColumn(f"{a}_x_{b}", number(df, a) * number(df, b))


def _bin_needs(df: DataFrame, p: dict) -> list[tuple]:
    return [(s, c) for c in _numeric_of(df, p) for s in ("min", "max")]


def _bin(df: DataFrame, p: dict, stats: dict) -> DataFrame:
    added = {}
    for c in _numeric_of(df, p):
        low, high = stats[("min", c)], stats[("max", c)]
        bins = p.get("bins", 5)
        if low is None or low == high:
            # a constant column lies in the middle bin
            binned = F.when(number(df, c).isNotNull(), F.lit((bins - 1) // 2))
        else:
            binned = equal_width_bin(number(df, c), F.lit(low), F.lit((high - low) / bins), bins, right_closed=True)
        added[f"{c}_binned"] = binned
    return df.withColumns(added)


def _feature_writes(df: DataFrame, p: dict) -> set[str]:
    d = p.get("degree", 2)
    names = {f"{c}_{s}" for c in p["columns"] for s in (f"pow{d}", "log", "binned")}
    return names | ({"{}_x_{}".format(*p["columns"][:2])} if len(p["columns"]) > 1 else set())


def _impute_needs(df: DataFrame, p: dict) -> list[tuple]:
    return [("mean", c) for c in numeric_columns(df) if c not in p.get("keep", [])]


def _impute_apply(df: DataFrame, p: dict, stats: dict) -> DataFrame:
    filled = {k[1]: F.coalesce(number(df, k[1]), constant(v)) for k, v in stats.items() if k[0] == "mean" and k[1] in df.columns}
    return df.withColumns({c: v for c, v in filled.items() if c not in p.get("keep", [])})


def _drop_duplicates(df: DataFrame, p: dict, stats: dict) -> DataFrame:
    """One row of each group that ``duplicate_count`` counts as equal: NaN equals NULL, maps are compared by their entries."""
    helper = unused("_row", df)
    tagged = df.withColumn(helper, F.struct(*comparable(df)) if df.columns else F.lit(0))
    return tagged.dropDuplicates([helper]).drop(helper)


def _all(df: DataFrame, p: dict) -> set[str]:
    return set(df.columns)


OPERATIONS: dict[str, Operation] = {
    "drop_column": Operation(lambda df, p, s: df.drop(p["column"])),
    "fill_na": Operation(_fill_apply, _fill_needs),
    "drop_na": Operation(lambda df, p, s: drop_missing(df), writes=lambda df, p: set(), changes_rows=lambda p: True),
    "drop_duplicates": Operation(_drop_duplicates, writes=lambda df, p: set(), changes_rows=lambda p: True),
    "rename": Operation(
        lambda df, p, s: df.withColumnRenamed(p["column"], p["new_name"]), writes=lambda df, p: {p["column"], p["new_name"]}
    ),
    "cast": Operation(_cast_apply),
    "encode": Operation(_encode_apply, _encode_needs),
    "handle_outliers": Operation(_fence_apply, _fence_needs, changes_rows=lambda p: p["method"] == "drop"),
    "scale": Operation(_scale_apply, _scale_needs),
    "polynomial": Operation(_polynomial, writes=_feature_writes),
    "log": Operation(_log, writes=_feature_writes),
    "interaction": Operation(_interaction, writes=_feature_writes),
    "binning": Operation(_bin, _bin_needs, writes=_feature_writes),
    "dummies": Operation(_dummies_apply, _dummies_needs, writes=_all),
    "impute_all": Operation(_impute_apply, _impute_needs, writes=_all),
}


def operation(step: dict) -> Operation:
    if step["op"] not in OPERATIONS:
        raise UnknownOperation(f"unknown operation {step['op']}")
    return OPERATIONS[step["op"]]


def run_step(df: DataFrame, step: dict) -> DataFrame:
    op = operation(step)
    return op.apply(df, step, fit_statistics(df, op.needs(df, step)))


# ---------------------------------------------------------------- one function per step


def drop_column(df: DataFrame, column: str) -> DataFrame:
    return run_step(df, {"op": "drop_column", "column": column})


def fill_na(df, column, method=None, value=None, order_by=None, partition_by=None) -> DataFrame:
    """Fill by mean, median, mode, ffill, bfill, zero (also for an unknown method) or a constant."""
    step = {"op": "fill_na", "column": column, "method": method, "value": value}
    if order_by:
        step.update(order_by=order_by, partition_by=partition_by or [])
    return run_step(df, step)


def drop_na(df: DataFrame) -> DataFrame:
    return run_step(df, {"op": "drop_na"})


def drop_duplicates(df: DataFrame) -> DataFrame:
    return run_step(df, {"op": "drop_duplicates"})


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    return run_step(df, {"op": "rename", "column": old, "new_name": new})


def cast(df: DataFrame, column: str, to: str) -> DataFrame:
    return run_step(df, {"op": "cast", "column": column, "type": to})


def one_hot(df: DataFrame, column: str, drop_first: bool = True, max_categories: int | None = None) -> DataFrame:
    return run_step(df, {"op": "encode", "column": column, "method": "one_hot", "drop_first": drop_first, "max_categories": max_categories})


def label_encode(df: DataFrame, column: str) -> DataFrame:
    return run_step(df, {"op": "encode", "column": column, "method": "label"})


def clip_outliers(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    return run_step(df, {"op": "handle_outliers", "column": column, "method": "clip", "threshold": k})


def drop_outliers(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    return run_step(df, {"op": "handle_outliers", "column": column, "method": "drop", "threshold": k})


def scale(df: DataFrame, column: str, method: str) -> DataFrame:
    return run_step(df, {"op": "scale", "column": column, "method": method})


def polynomial(df: DataFrame, columns: list[str], degree: int = 2) -> DataFrame:
    return run_step(df, {"op": "polynomial", "columns": columns, "degree": degree})


def log_transform(df: DataFrame, columns: list[str]) -> DataFrame:
    return run_step(df, {"op": "log", "columns": columns})


def interaction(df: DataFrame, a: str, b: str) -> DataFrame:
    need(df, a, b)
    return run_step(df, {"op": "interaction", "columns": [a, b]})


def bin_equal_width(df: DataFrame, columns: list[str], bins: int = 5) -> DataFrame:
    return run_step(df, {"op": "binning", "columns": columns, "bins": bins})


def dummies(df: DataFrame, keep: tuple[str, ...] = (), max_categories: int | None = None) -> DataFrame:
    return run_step(df, {"op": "dummies", "keep": list(keep), "max_categories": max_categories})


def impute_all_mean(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return run_step(df, {"op": "impute_all", "keep": list(keep)})
