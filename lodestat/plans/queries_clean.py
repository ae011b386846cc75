"""Queries: cleaning, features, recipes, outliers and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestat.operators import clean, outliers, quality
from lodestat.plans.inputs import EVENTS, LINEITEM, ORDERS, as_sql, derived
from lodestat.plans.recipe import Recipe, apply_recipe, auto_clean
from lodestat.plans.registry import longs, query, rounded
from lodestat.sources.readers import read_table

KEYS = ["l_orderkey", "l_linenumber"]
T = f"WITH t AS ({as_sql('lineitem', LINEITEM)})"
O = f"WITH t AS ({as_sql('orders', ORDERS)})"  # noqa: E741
E = f"WITH t AS ({as_sql('events', EVENTS)})"
IQR = "q AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM t)"
FENCE = "(q1 - {k} * (q3 - q1)) AS lo, (q3 + {k} * (q3 - q1)) AS hi"


def fence(c, k=1.5):
    return IQR.format(c=c) + ", f AS (SELECT " + FENCE.format(k=k) + " FROM q)"


def dirty(spark, d):
    return derived(spark, d, "lineitem", LINEITEM)


def priced(spark, d):
    return derived(spark, d, "orders", ORDERS)


@query("c01_drop_column", "SELECT n_nationkey, n_name FROM nation")
def _(spark, d):
    t = read_table(spark, d, "nation")
    return clean.drop_column(clean.drop_column(t, "n_regionkey"), "absent")


@query("c02_fill_na_mean", f"{T} SELECT l_orderkey, l_linenumber, round(coalesce(qty_n, (SELECT avg(qty_n) FROM t)), 6) AS qty_n FROM t")
def _(spark, d):
    return rounded(clean.fill_na(dirty(spark, d), "qty_n", "mean").select(*KEYS, "qty_n"), 6, "qty_n")


@query(
    "c03_fill_na_median",
    f"{T} SELECT l_orderkey, l_linenumber, round(coalesce(qty_n, (SELECT quantile_cont(qty_n, 0.5) FROM t)), 6) AS qty_n FROM t",
)
def _(spark, d):
    return rounded(clean.fill_na(dirty(spark, d), "qty_n", "median").select(*KEYS, "qty_n"), 6, "qty_n")


@query(
    "c04_fill_na_mode",
    f"{T}, m AS (SELECT flag_n FROM t WHERE flag_n IS NOT NULL GROUP BY flag_n ORDER BY count(*) DESC, flag_n LIMIT 1), "
    "k AS (SELECT qty_n FROM t WHERE qty_n IS NOT NULL GROUP BY qty_n ORDER BY count(*) DESC, qty_n LIMIT 1) "
    "SELECT l_orderkey, l_linenumber, coalesce(flag_n, (SELECT flag_n FROM m)) AS flag_n, coalesce(qty_n, (SELECT qty_n FROM k)) AS qty_n FROM t",
)
def _(spark, d):
    t = clean.fill_na(clean.fill_na(dirty(spark, d), "flag_n", "mode"), "qty_n", "mode")
    return t.select(*KEYS, "flag_n", "qty_n")


@query(
    "c05_fill_na_zero",
    f"{T} SELECT l_orderkey, l_linenumber, coalesce(qty_n, 0.0) AS qty_n, coalesce(flag_n, '0') AS flag_n, coalesce(tax_n, 0.0) AS tax_n FROM t",
)
def _(spark, d):
    t = clean.fill_na(dirty(spark, d), "qty_n", "zero")
    t = clean.fill_na(clean.fill_na(t, "flag_n", "mean"), "tax_n", "impute")
    return t.select(*KEYS, "qty_n", "flag_n", "tax_n")


@query(
    "c06_fill_na_value",
    f"{T} SELECT l_orderkey, l_linenumber, coalesce(qty_n, 99.5) AS qty_n, coalesce(flag_n, 'X') AS flag_n FROM t",
)
def _(spark, d):
    t = clean.fill_na(clean.fill_na(dirty(spark, d), "qty_n", value=99.5), "flag_n", value="X")
    return t.select(*KEYS, "qty_n", "flag_n")


def carried(order, key):
    part = f"PARTITION BY {key} " if key else ""
    return (
        f"{E} SELECT event_id, last_value(value_n IGNORE NULLS) OVER ({part}ORDER BY event_id {order} "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value_n FROM t"
    )


@query("c07_forward_fill", carried("", "user_id"))
def _(spark, d):
    t = derived(spark, d, "events", EVENTS)
    return clean.fill_na(t, "value_n", "ffill", order_by=["event_id"], partition_by=["user_id"]).select("event_id", "value_n")


@query("c07_forward_fill_hot_group", carried("", "event_type"))
def _(spark, d):
    from lodestat.operators.ordered import carry_value

    # few large groups: the rows are cut into sorted pieces that carry their last value on
    t = derived(spark, d, "events", EVENTS)
    return carry_value(t, "value_n", ["event_type"], ["event_id"], max_group_rows=100).select("event_id", "value_n")


@query("c08_backward_fill", carried("DESC", "user_id"))
def _(spark, d):
    t = derived(spark, d, "events", EVENTS)
    return clean.fill_na(t, "value_n", "bfill", order_by=["event_id"], partition_by=["user_id"]).select("event_id", "value_n")


@query(
    "c09_drop_na",
    f"{T} SELECT l_orderkey, l_linenumber, qty_n, tax_n, disc_n, flag_n FROM t "
    "WHERE qty_n IS NOT NULL AND tax_n IS NOT NULL AND disc_n IS NOT NULL AND flag_n IS NOT NULL",
)
def _(spark, d):
    return clean.drop_na(dirty(spark, d)).select(*KEYS, "qty_n", "tax_n", "disc_n", "flag_n")


@query("c10_drop_duplicates", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, l_quantity FROM lineitem")
def _(spark, d):
    return clean.drop_duplicates(read_table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"))


@query("c11_rename", "SELECT s_suppkey, s_name AS supplier_name, s_nationkey, s_acctbal FROM supplier")
def _(spark, d):
    return clean.rename(read_table(spark, d, "supplier"), "s_name", "supplier_name")


@query(
    "c12_cast_int",
    f"{O} SELECT o_orderkey, coalesce(CAST(trunc(TRY_CAST(num_s AS DOUBLE)) AS BIGINT), 0) AS num_s, CAST(trunc(o_totalprice) AS BIGINT) AS o_totalprice FROM t",
)
def _(spark, d):
    t = clean.cast(clean.cast(priced(spark, d), "num_s", "int"), "o_totalprice", "int")
    return t.select("o_orderkey", "num_s", "o_totalprice")


@query("c12_cast_float", f"{O} SELECT o_orderkey, TRY_CAST(num_s AS DOUBLE) AS num_s FROM t")
def _(spark, d):
    return clean.cast(priced(spark, d), "num_s", "float").select("o_orderkey", "num_s")


@query(
    "c12_cast_datetime",
    f"{O} SELECT o_orderkey, strftime(TRY_CAST(date_s AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS date_s, "
    "strftime(TRY_CAST(num_s AS TIMESTAMP), '%Y') AS num_s FROM t",
)
def _(spark, d):
    t = priced(spark, d).withColumn("num_s", F.concat(F.lit("x"), "num_s"))
    t = clean.cast(clean.cast(t, "date_s", "datetime"), "num_s", "datetime")
    return t.select("o_orderkey", F.date_format("date_s", "yyyy-MM-dd HH:mm:ss").alias("date_s"), F.date_format("num_s", "yyyy").alias("num_s"))


@query("c12_cast_string", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders")
def _(spark, d):
    return clean.cast(read_table(spark, d, "orders"), "o_custkey", "string").select("o_orderkey", "o_custkey")


@query(
    "c13_one_hot",
    f"{T} SELECT l_orderkey, l_linenumber, CASE WHEN flag_n = 'N' THEN 1 ELSE 0 END AS \"flag_n_N\", CASE WHEN flag_n = 'R' THEN 1 ELSE 0 END AS \"flag_n_R\" FROM t",
)
def _(spark, d):
    return clean.one_hot(dirty(spark, d).select(*KEYS, "flag_n"), "flag_n")


@query(
    "c14_label_encode",
    f"{T}, c AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT coalesce(flag_n, 'nan') AS v FROM t)), "
    "k AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT CAST(l_linenumber AS VARCHAR) AS v FROM t)) "
    "SELECT l_orderkey, k.code AS l_linenumber, c.code AS flag_n FROM t JOIN c ON c.v = coalesce(flag_n, 'nan') JOIN k ON k.v = CAST(l_linenumber AS VARCHAR)",
)
def _(spark, d):
    t = clean.label_encode(dirty(spark, d).select(*KEYS, "flag_n"), "flag_n")
    return clean.label_encode(t, "l_linenumber")


@query(
    "c14_label_encode_many_classes",
    "WITH c AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS v FROM orders)) "
    "SELECT o_orderkey, c.code AS o_custkey FROM orders JOIN c ON c.v = CAST(o_custkey AS VARCHAR)",
)
def _(spark, d):
    from lodestat.operators.fitting import attach_codes, fit_codes

    # no broadcast of the classes: a ranked table and a shuffled join
    t = read_table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return attach_codes(t, "o_custkey", fit_codes(t, "o_custkey", broadcast_classes=100), "o_custkey")


@query(
    "c15_clip_outliers",
    f"{O}, {fence('price_o')} SELECT o_orderkey, round(least(greatest(price_o, lo), hi), 4) AS price_o FROM t, f",
)
def _(spark, d):
    return rounded(clean.clip_outliers(priced(spark, d), "price_o").select("o_orderkey", "price_o"), 4, "price_o")


@query(
    "c16_drop_outliers",
    f"{T}, {fence('qty_n', 0.2)} SELECT l_orderkey, l_linenumber, qty_n FROM t, f WHERE qty_n BETWEEN lo AND hi",
)
def _(spark, d):
    return clean.drop_outliers(dirty(spark, d), "qty_n", 0.2).select(*KEYS, "qty_n")


@query(
    "c17_scale_standard",
    f"{T} SELECT l_orderkey, l_linenumber, round((qty_n - (SELECT avg(qty_n) FROM t)) / (SELECT stddev_pop(qty_n) FROM t), 6) + 0.0 AS qty_n, "
    "0.0::DOUBLE AS const_c FROM t",
)
def _(spark, d):
    t = clean.scale(clean.scale(dirty(spark, d), "qty_n", "standard"), "const_c", "standard")
    return rounded(t.select(*KEYS, "qty_n", "const_c"), 6, "qty_n", "const_c")


@query(
    "c18_scale_minmax",
    f"{T}, m AS (SELECT min(qty_n) AS lo, max(qty_n) AS hi FROM t) SELECT l_orderkey, l_linenumber, round((qty_n - lo) / (hi - lo), 6) AS qty_n, 0.0::DOUBLE AS const_c FROM t, m",
)
def _(spark, d):
    t = clean.scale(clean.scale(dirty(spark, d), "qty_n", "minmax"), "const_c", "minmax")
    return rounded(t.select(*KEYS, "qty_n", "const_c"), 6, "qty_n", "const_c")


STEPS = [
    {"op": "fill_na", "column": "qty_n", "method": "median"},
    {"op": "scale", "column": "l_extendedprice", "method": "minmax"},
    {"op": "encode", "column": "flag_n", "method": "one_hot"},
    {"op": "handle_outliers", "column": "l_tax", "method": "clip", "threshold": 0.1},
    {"op": "scale", "column": "qty_n", "method": "standard"},
    {"op": "drop_column", "column": "disc_n"},
    {"op": "drop_na"},
]
KEPT = ["l_orderkey", "l_linenumber", "qty_n", "l_extendedprice", "l_tax", "tax_n"]


@query(
    "c20_recipe",
    f"{T}, {fence('l_tax', 0.1)}, a AS (SELECT *, coalesce(qty_n, (SELECT quantile_cont(qty_n, 0.5) FROM t)) AS q FROM t), "
    "s AS (SELECT min(l_extendedprice) AS mn, max(l_extendedprice) AS mx, avg(q) AS m, stddev_pop(q) AS sd FROM a) "
    "SELECT l_orderkey, l_linenumber, round((q - m) / sd, 6) AS qty_n, round((l_extendedprice - mn) / (mx - mn), 6) AS l_extendedprice, "
    "round(least(greatest(l_tax, lo), hi), 6) AS l_tax, tax_n, CASE WHEN flag_n = 'N' THEN 1 ELSE 0 END AS \"flag_n_N\", "
    "CASE WHEN flag_n = 'R' THEN 1 ELSE 0 END AS \"flag_n_R\" FROM a, s, f WHERE tax_n IS NOT NULL",
)
def _(spark, d):
    t = apply_recipe(dirty(spark, d), STEPS)
    return rounded(t.select(*KEPT, "flag_n_N", "flag_n_R"), 6, "qty_n", "l_extendedprice", "l_tax")


@query(
    "c20_recipe_undo_redo",
    f"{T} SELECT l_orderkey, l_linenumber, coalesce(qty_n, (SELECT quantile_cont(qty_n, 0.5) FROM t)) AS qty_n, l_extendedprice, flag_n FROM t",
)
def _(spark, d):
    recipe = Recipe()
    for step in STEPS[:4]:
        recipe.add(step)
    recipe.undo().undo().undo().undo().redo()
    return recipe.apply(dirty(spark, d)).select(*KEYS, "qty_n", "l_extendedprice", "flag_n")


# numeric columns that a fix may clip; the fill of qty_n and the dropped rows come before the clips
CLIPPED = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "qty_n", "tax_n", "const_c"]


def clipped_sum(c):
    """Sum of a column, clipped to the fences of the rows left if the report finds outliers in it."""
    fence = "(quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)))", "(quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)))"
    low, high = (f.format(c=c) for f in fence)
    flagged = f"(SELECT count(*) > 0 FROM t, (SELECT {low} AS lo, {high} AS hi FROM t) f WHERE {c} < lo OR {c} > hi)"
    return (
        f"round((SELECT sum(CASE WHEN {flagged} THEN least(greatest({c}, lo), hi) ELSE {c} END) FROM d, (SELECT {low} AS lo, {high} AS hi FROM d) f), 2)::DOUBLE AS {c}"
    )


@query(
    "c21_auto_clean",
    f"{T}, d AS (SELECT * REPLACE (coalesce(qty_n, 0) AS qty_n) FROM t WHERE tax_n IS NOT NULL AND disc_n IS NOT NULL AND flag_n IS NOT NULL) "
    "SELECT count(*) AS n, count(*) FILTER (l_returnflag = 'N') AS flag_n, count(*) FILTER (l_linestatus = 'O') AS status_o, "
    "count(*) FILTER (flag_n = 'R') AS flag_r, " + ", ".join(clipped_sum(c) for c in CLIPPED) + " FROM d",
)
def _(spark, d):
    t = dirty(spark, d).drop("l_shipdate")
    report = quality.quality_report(t)
    fixed, _ = auto_clean(t, report.select("kind", "column", F.col("recommendation").alias("strategy")))
    counts = [F.count("*").alias("n"), F.sum("l_returnflag_N").alias("flag_n"), F.sum("l_linestatus_O").alias("status_o"), F.count_if(F.col("flag_n") == "R").alias("flag_r")]
    return rounded(fixed.agg(*counts, *[F.sum(F.col(c).cast("double")).alias(c) for c in CLIPPED]), 2, *CLIPPED)


@query(
    "c22_polynomial",
    "SELECT l_orderkey, l_linenumber, round(pow(l_quantity, 3), 4) AS l_quantity_pow3, round(pow(l_tax, 3), 4) AS l_tax_pow3 FROM lineitem",
)
def _(spark, d):
    t = clean.polynomial(read_table(spark, d, "lineitem"), ["l_quantity", "l_tax"], 3)
    return rounded(t.select(*KEYS, "l_quantity_pow3", "l_tax_pow3"), 4, "l_quantity_pow3", "l_tax_pow3")


@query("c23_log_transform", "SELECT s_suppkey, round(ln(1 + greatest(s_acctbal, 0)), 6) AS s_acctbal_log FROM supplier "
       "UNION ALL SELECT c_custkey, round(ln(1 + greatest(c_acctbal, 0)), 6) FROM customer")
def _(spark, d):
    a = clean.log_transform(read_table(spark, d, "supplier"), ["s_acctbal"]).select("s_suppkey", "s_acctbal_log")
    b = clean.log_transform(read_table(spark, d, "customer"), ["c_acctbal"]).select("c_custkey", "c_acctbal_log")
    return rounded(a.union(b), 6, "s_acctbal_log")


@query("c24_interaction", f"{T} SELECT l_orderkey, l_linenumber, round(qty_n * l_extendedprice, 4) AS \"qty_n_x_l_extendedprice\" FROM t")
def _(spark, d):
    t = clean.interaction(dirty(spark, d), "qty_n", "l_extendedprice")
    return rounded(t.select(*KEYS, "qty_n_x_l_extendedprice"), 4, "qty_n_x_l_extendedprice")


def bin_sql(c, n):
    inner = " + ".join(f"CAST({c} > lo_{c} + {i} * ((hi_{c} - lo_{c}) / {n}) AS INT)" for i in range(1, n))
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN lo_{c} = hi_{c} THEN {(n - 1) // 2} ELSE {inner} END AS {c}_binned"


@query(
    "c25_binning",
    f"{T}, m AS (SELECT " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in ("qty_n", "l_extendedprice", "const_c")) + " FROM t) "
    f"SELECT l_orderkey, l_linenumber, CAST({bin_sql('qty_n', 7).replace(' AS qty_n_binned', '')} AS DOUBLE) AS qty_n_binned, "
    f"{bin_sql('l_extendedprice', 7)}, {bin_sql('const_c', 7)} FROM t, m",
)
def _(spark, d):
    t = clean.bin_equal_width(dirty(spark, d), ["qty_n", "l_extendedprice", "const_c"], 7)
    return t.select(*KEYS, F.col("qty_n_binned").cast("double").alias("qty_n_binned"), "l_extendedprice_binned", "const_c_binned")


@query(
    "c26_dummies",
    "SELECT o_orderkey, o_custkey, o_totalprice, "
    + ", ".join(f"CASE WHEN o_orderstatus = '{v}' THEN 1 ELSE 0 END AS \"o_orderstatus_{v}\"" for v in ("O", "P"))
    + ", "
    + ", ".join(
        f"CASE WHEN o_orderpriority = '{v}' THEN 1 ELSE 0 END AS \"o_orderpriority_{v}\""
        for v in ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    )
    + " FROM orders",
)
def _(spark, d):
    return clean.dummies(read_table(spark, d, "orders").drop("o_orderdate"))


@query(
    "c27_impute_all_mean",
    f"{T} SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"round(coalesce({c}, (SELECT avg({c}) FROM t)), 6) AS {c}" for c in ("qty_n", "tax_n", "disc_n"))
    + " FROM t",
)
def _(spark, d):
    t = clean.impute_all_mean(dirty(spark, d), keep=("l_orderkey", "l_linenumber"))
    return rounded(t.select(*KEYS, "qty_n", "tax_n", "disc_n"), 6, "qty_n", "tax_n", "disc_n")


@query(
    "c28_column_bind",
    "SELECT l_orderkey, l_linenumber, l_quantity, round(l_quantity * l_tax, 4) AS l_quantity_x_l_tax, l_quantity * l_quantity AS l_quantity_pow2 FROM lineitem",
)
def _(spark, d):
    steps = [{"op": "interaction", "columns": ["l_quantity", "l_tax"]}, {"op": "polynomial", "columns": ["l_quantity"]}]
    t = apply_recipe(read_table(spark, d, "lineitem").select(*KEYS, "l_quantity", "l_tax"), steps).drop("l_tax")
    return rounded(t, 4, "l_quantity_x_l_tax")


@query(
    "c29_preview_new_columns",
    "SELECT round(ln(1 + greatest(c_acctbal, 0)), 6) AS c_acctbal_log FROM customer ORDER BY c_custkey LIMIT 5",
)
def _(spark, d):
    t = clean.log_transform(read_table(spark, d, "customer"), ["c_acctbal"])
    return rounded(t.orderBy("c_custkey").select("c_acctbal_log").limit(5), 6, "c_acctbal_log")


# ---------------------------------------------------------------- outliers

OUT = ["price_o", "o_totalprice", "o_custkey"]
OUT_FENCES = ", ".join(
    f"q{i} AS (SELECT quantile_cont({c}, 0.25) - {{k}} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo{i}, "
    f"quantile_cont({c}, 0.75) + {{k}} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi{i} FROM t)"
    for i, c in enumerate(OUT)
)


def flagged(k):
    tests = ", ".join(f"coalesce({c} < lo{i} OR {c} > hi{i}, false) AS f{i}" for i, c in enumerate(OUT))
    return f"{O}, {OUT_FENCES.format(k=k)}, f AS (SELECT t.*, {tests} FROM t, q0, q1, q2)"


@query(
    "d01_detect_outliers_iqr",
    flagged(0.4)
    + " "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (f{i}) AS outlier_count, round_even(count(*) FILTER (f{i}) * 100.0E0 / count({c}), 2) AS percentage, "
        "count(*) FILTER (f0 OR f1 OR f2) AS total_outlier_rows FROM f"
        for i, c in enumerate(OUT)
    ),
)
def _(spark, d):
    return outliers.detect_outliers(priced(spark, d), OUT, "iqr", 0.4).drop("sample_values")


@query(
    "d01_outlier_samples",
    flagged(0.4)
    + ", o AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM f WHERE f{i}" for i, c in enumerate(OUT))
    + '), r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY value) AS place FROM o) SELECT "column", value FROM r WHERE place <= 5',
)
def _(spark, d):
    found = outliers.detect_outliers(priced(spark, d), OUT, "iqr", 0.4)
    return found.select("column", F.explode("sample_values").alias("value"))


@query(
    "d02_detect_outliers_zscore",
    f"{O}, s AS (SELECT " + ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(OUT)) + " FROM t), "
    "f AS (SELECT t.*, " + ", ".join(f"abs({c} - m{i}) / s{i} > 1.7 AS f{i}" for i, c in enumerate(OUT)) + " FROM t, s) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (f{i}) AS outlier_count, round_even(count(*) FILTER (f{i}) * 100.0E0 / count({c}), 2) AS percentage, "
        "count(*) FILTER (f0 OR f1 OR f2) AS total_outlier_rows FROM f"
        for i, c in enumerate(OUT)
    ),
)
def _(spark, d):
    return outliers.detect_outliers(priced(spark, d), OUT, "zscore", 1.7).drop("sample_values")


@query("d03_remove_outliers", flagged(0.4) + " SELECT o_orderkey, round(price_o, 4) AS price_o FROM f WHERE NOT (f0 OR f1 OR f2)")
def _(spark, d):
    kept = outliers.remove_outliers(priced(spark, d), OUT, "iqr", 0.4)
    return rounded(kept.select("o_orderkey", "price_o"), 4, "price_o")


@query("d04_total_outlier_rows", flagged(0.4) + " SELECT count(*) FILTER (f0 OR f1 OR f2) AS total FROM f")
def _(spark, d):
    total = outliers.total_outlier_rows(priced(spark, d), OUT, "iqr", 0.4)
    return spark.createDataFrame([(total,)], "total bigint")


# ---------------------------------------------------------------- quality

MISSING = ["qty_n", "tax_n", "disc_n", "flag_n"]
MISSING_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS \"count\", round_even((count(*) - count({c})) * 100.0E0 / count(*), 2) AS percentage, "
    f"'{'string' if c == 'flag_n' else 'double'}' AS dtype FROM t"
    for c in MISSING
)
ADVICE = "CASE WHEN percentage > 50 THEN 'drop_column' WHEN percentage < 5 THEN 'drop_rows' ELSE 'impute' END AS recommendation"


@query("d05_missing_report", f"{T} SELECT *, {ADVICE} FROM ({MISSING_SQL})")
def _(spark, d):
    return quality.missing_report(dirty(spark, d))


@query(
    "d06_encoding_report",
    'SELECT "column", cardinality, CASE WHEN cardinality < 10 THEN \'one_hot\' ELSE \'label\' END AS recommendation FROM ('
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS cardinality FROM part" for c in ("p_name", "p_brand", "p_type"))
    + f" UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag) FROM lineitem UNION ALL SELECT 'l_linestatus', count(DISTINCT l_linestatus) FROM lineitem)",
)
def _(spark, d):
    items = dirty(spark, d).select("l_returnflag", "l_linestatus", "flag_n")
    return quality.encoding_report(read_table(spark, d, "part")).unionByName(quality.encoding_report(items))


@query(
    "d07_outlier_report",
    f"{O}, {OUT_FENCES.format(k=1.5)}, k AS (SELECT quantile_cont(o_orderkey, 0.25) AS a, quantile_cont(o_orderkey, 0.75) AS b FROM t), r AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} < lo{i} OR {c} > hi{i}) AS \"count\", count(*) AS n FROM t, q{i}" for i, c in enumerate(OUT))
    + " UNION ALL SELECT 'o_orderkey', count(*) FILTER (o_orderkey < a - 1.5 * (b - a) OR o_orderkey > b + 1.5 * (b - a)), count(*) FROM t, k) "
    'SELECT "column", "count", round_even("count" * 100.0E0 / n, 2) AS percentage, \'clip\' AS recommendation FROM r WHERE "count" > 0',
)
def _(spark, d):
    return outliers.outlier_report(priced(spark, d))


@query(
    "d08_merge_recommendations",
    f"{T}, r AS (SELECT *, {ADVICE} FROM ({MISSING_SQL})) SELECT \"column\", recommendation, "
    "CASE WHEN \"column\" = 'qty_n' THEN 'median' ELSE recommendation END AS strategy, "
    "CASE WHEN \"column\" = 'qty_n' THEN 'skewed' ELSE 'Heuristic suggestion (AI unavailable)' END AS reasoning FROM r",
)
def _(spark, d):
    report = quality.missing_report(dirty(spark, d)).select("column", "recommendation")
    given = spark.createDataFrame([("qty_n", "median", "skewed"), ("absent", "mean", "x")], "column string, strategy string, reasoning string")
    return quality.merge_recommendations(report, given)


SCORED = "l_orderkey, l_linenumber, qty_n, tax_n, disc_n, flag_n, const_c, l_linestatus"
S = f"{T}, s AS (SELECT {SCORED} FROM t), u AS (SELECT DISTINCT * FROM s), m AS (SELECT (SELECT count(*) FROM s) AS n, " + ", ".join(
    f"(SELECT count(*) - count({c}) FROM s) AS {c}" for c in MISSING
) + ", (SELECT count(*) FROM s) - (SELECT count(*) FROM u) AS dups), p AS (SELECT *, (qty_n + tax_n + disc_n + flag_n) * 100.0E0 / (n * 8) AS pct FROM m)"
# dashboard: about 11 % of all cells missing is moderate, const_c is constant
DASH = (
    "CASE WHEN pct > 20 THEN 30 WHEN pct > 5 THEN 15 WHEN pct > 0 THEN 5 ELSE 0 END + "
    "CASE WHEN dups * 100.0E0 / n > 10 THEN 20 WHEN dups > 0 THEN 10 ELSE 0 END + 5"
)


def scored(spark, d):
    return dirty(spark, d).select(*SCORED.split(", "))


@query(
    "d09_quality_score",
    f"{S} SELECT CAST(greatest(0, 100 - ({DASH})) AS BIGINT) AS quality_score, dups AS duplicate_rows, round_even(100 - pct, 2) AS completeness, "
    "CAST(CASE WHEN pct > 0 THEN 1 ELSE 0 END + CASE WHEN dups > 0 THEN 1 ELSE 0 END + 1 AS BIGINT) AS issues FROM p",
)
def _(spark, d):
    return longs(quality.quality_score(scored(spark, d)), "quality_score", "issues")


@query(
    "d09_quality_issues",
    f"{S} SELECT 1 AS position, CASE WHEN pct > 20 THEN 'High' WHEN pct > 5 THEN 'Moderate' ELSE 'Low' END || "
    "printf(' missing values: %.1f%% of data is missing', pct) AS issue FROM p "
    "UNION ALL SELECT 2, printf('%d duplicate rows found (%.1f%%)', dups, dups * 100.0E0 / n) FROM p WHERE dups > 0 "
    "UNION ALL SELECT CASE WHEN dups > 0 THEN 3 ELSE 2 END, 'Column ''const_c'' has only one unique value' FROM p",
)
def _(spark, d):
    return quality.quality_issues(scored(spark, d))


@query(
    "d10_quality_score_engine",
    f"{S} SELECT CAST(greatest(0, 100 - 10 * (1 + 1 + CASE WHEN dups > 0 THEN 1 ELSE 0 END)) AS BIGINT) AS quality_score, 'documents' AS other, "
    "(SELECT CAST(100 - 10 * (CASE WHEN count(DISTINCT doc_id) < 0 THEN 1 ELSE 0 END + CASE WHEN count(DISTINCT text) > 0.9 * count(*) THEN 1 ELSE 0 END "
    "+ CASE WHEN count(DISTINCT source) > 0.9 * count(*) THEN 1 ELSE 0 END + CASE WHEN count(DISTINCT lang) > 0.9 * count(*) THEN 1 ELSE 0 END) AS BIGINT) "
    "FROM documents) AS other_score FROM p",
)
def _(spark, d):
    own = quality.quality_score(scored(spark, d), "engine").first()["quality_score"]
    other = quality.quality_score(read_table(spark, d, "documents"), "engine").first()["quality_score"]
    return spark.createDataFrame([(own, "documents", other)], "quality_score bigint, other string, other_score bigint")


@query(
    "d11_recommendations",
    "WITH c AS (SELECT count(*) AS n, count(DISTINCT p_name) AS names, count(DISTINCT p_size) AS sizes, count(DISTINCT p_brand) AS brands, "
    "count(DISTINCT p_partkey) AS keys, count(DISTINCT p_retailprice) AS prices FROM part), "
    "o AS (SELECT count(*) AS n, count(DISTINCT o_orderstatus) AS s FROM orders), "
    "r AS (SELECT 1 AS k, 'part' AS source, 'Encode categorical variables before training ML models' AS recommendation, true AS hit FROM c "
    "UNION ALL SELECT 2, 'part', concat('Column ''p_name'' has high cardinality (', names, ' unique values) - consider binning'), names > 50 FROM c "
    "UNION ALL SELECT 2, 'part', concat('Column ''p_brand'' has high cardinality (', brands, ' unique values) - consider binning'), names <= 50 AND brands > 50 FROM c "
    "UNION ALL SELECT 3, 'part', 'Column ''p_size'' appears suitable for classification (low cardinality)', sizes <= 10 AND sizes / n < 0.05 FROM c "
    "UNION ALL SELECT 1, 'labels', 'Column ''quality'' appears suitable for classification (low cardinality)', true FROM c) "
    "SELECT row_number() OVER (PARTITION BY source ORDER BY k) AS position, source, recommendation FROM r WHERE hit",
)
def _(spark, d):
    parts = [quality.recommendations(read_table(spark, d, t)).withColumn("source", F.lit(t)) for t in ("part", "labels")]
    return longs(parts[0].unionByName(parts[1]), "position")


@query(
    "d12_recommendations_engine",
    f"{T} SELECT 1 AS position, 'Consider handling missing values before training models' AS recommendation FROM t HAVING count(*) - count(disc_n) > 0.05 * count(*) "
    "UNION ALL SELECT 2, 'Consider feature scaling due to different value ranges' FROM t HAVING max(l_extendedprice) - min(l_extendedprice) > 100 * (max(l_tax) - min(l_tax)) "
    "UNION ALL SELECT 3, 'Categorical variables will need encoding for ML models'",
)
def _(spark, d):
    return quality.recommendations(dirty(spark, d).drop("const_c"), "engine")


@query(
    "d13_insights",
    f"{T}, f AS (SELECT count(*) AS n, 3 * count(*) - count(qty_n) - count(disc_n) - count(flag_n) AS miss, count(DISTINCT l_linenumber) AS ln, "
    "count(DISTINCT disc_n) AS dn, count(DISTINCT qty_n) AS qn, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber, disc_n, qty_n, flag_n, l_shipdate FROM t)) AS u FROM t), "
    "r AS (SELECT 1 AS k, 'Dataset contains ' || format('{:,}', n) || ' rows and 6 columns' AS insight, true AS hit FROM f "
    "UNION ALL SELECT 2, 'Found ' || format('{:,}', miss) || printf(' missing values (%.1f%% of total data)', miss * 100.0E0 / (n * 6)), true FROM f "
    "UNION ALL SELECT 3, 'Found 4 numeric columns suitable for modeling', true FROM f "
    "UNION ALL SELECT 4, 'Found 1 categorical columns that may need encoding', true FROM f "
    "UNION ALL SELECT 5, 'Column ''l_linenumber'' might be a good classification target (low cardinality)', ln < 20 AND ln / n < 0.1 FROM f "
    "UNION ALL SELECT 6, 'Column ''disc_n'' might be a good classification target (low cardinality)', dn < 20 AND dn / n < 0.1 FROM f "
    "UNION ALL SELECT 7, 'Column ''qty_n'' might be a good classification target (low cardinality)', qn < 20 AND qn / n < 0.1 FROM f "
    "UNION ALL SELECT 8, printf('Warning: Found %d duplicate rows', n - u), n > u FROM f) "
    "SELECT row_number() OVER (ORDER BY k) AS position, insight FROM r WHERE hit",
)
def _(spark, d):
    t = dirty(spark, d).select("l_orderkey", "l_linenumber", "disc_n", "qty_n", "flag_n", "l_shipdate")
    return longs(quality.insights(t), "position")
