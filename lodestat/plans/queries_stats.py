"""Queries: schema, column statistics, charts and time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestat.functions.columns import correlation_band, json_safe, score_band
from lodestat.operators import charts, schema, series, stats
from lodestat.plans.inputs import EVENTS, LINEITEM, ORDERS, as_sql, derived
from lodestat.plans.registry import longs, query, rounded
from lodestat.sources.readers import read_table

DIRTY = as_sql("lineitem", LINEITEM)
NUM = ["l_quantity", "l_extendedprice", "l_discount", "qty_n", "const_c"]
ALL_DIRTY = [
    ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
    ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
    ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz"),
    ("qty_n", "double"), ("tax_n", "double"), ("disc_n", "double"), ("flag_n", "string"), ("const_c", "double"),
]
COLUMNS = [c for c, _ in ALL_DIRTY]


def dirty(spark, d):
    return derived(spark, d, "lineitem", LINEITEM)


def per_column(cols, template, table=DIRTY, order=False):
    """One SELECT per column, joined by UNION ALL, over a common input."""
    body = " UNION ALL ".join("SELECT " + template.format(c=c, i=i) + " FROM t" for i, c in enumerate(cols))
    return f"WITH t AS ({table}) {body}"


# ---------------------------------------------------------------- schema


@query(
    "b01_dataset_info",
    per_column(
        COLUMNS,
        "{i}::BIGINT AS ordinal, '{c}' AS \"column\", count(*) AS rows, 16::BIGINT AS columns, "
        "count({c}) AS non_null, count(*) - count({c}) AS missing",
    ),
)
def _(spark, d):
    return longs(schema.dataset_info(dirty(spark, d)).drop("dtype"), "ordinal", "rows", "columns", "non_null", "missing")


@query(
    "b03_classify_columns",
    "WITH t AS (SELECT column_name, CASE WHEN column_type IN ('BIGINT','INTEGER','DOUBLE') THEN 'numeric' "
    "WHEN column_type = 'VARCHAR' THEN 'categorical' WHEN column_type LIKE 'TIMESTAMP%' THEN 'temporal' ELSE 'other' END AS kind "
    "FROM (DESCRIBE SELECT * FROM events)), n AS (SELECT count(*) AS rows FROM events) "
    'SELECT t.kind, count(*) AS columns, max(n.rows) AS rows FROM t, n GROUP BY t.kind',
)
def _(spark, d):
    events = read_table(spark, d, "events")
    info = schema.dataset_info(events).select("column", "rows")
    return schema.classify_columns(events).join(info, "column").groupBy("kind").agg(F.count("*").alias("columns"), F.max("rows").alias("rows"))


@query(
    "b05_align_features",
    "SELECT l_quantity, l_tax, 'absent_a,absent_b' AS absent FROM lineitem",
)
def _(spark, d):
    kept, absent = schema.align_features(read_table(spark, d, "lineitem"), ["l_quantity", "absent_a", "l_tax", "absent_b"])
    return kept.withColumn("absent", F.lit(",".join(absent)))


@query("b06_split_xy", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def _(spark, d):
    return schema.split_xy(read_table(spark, d, "supplier"), "s_acctbal")[0]


@query("b07_keep_range", f"WITH t AS ({DIRTY}) SELECT l_orderkey, l_linenumber, qty_n FROM t WHERE qty_n BETWEEN 10 AND 40")
def _(spark, d):
    return schema.keep_range(dirty(spark, d), "qty_n", 10, 40).select("l_orderkey", "l_linenumber", "qty_n")


@query(
    "b08_outside_range",
    f"WITH t AS ({DIRTY}) SELECT l_orderkey, l_linenumber FROM t WHERE NOT coalesce(qty_n < 5 OR qty_n > 45, false)",
)
def _(spark, d):
    from lodestat.functions.columns import number, outside

    t = dirty(spark, d)
    return t.where(~outside(number(t, "qty_n"), 5, 45)).select("l_orderkey", "l_linenumber")


@query(
    "b09_drop_missing_pair",
    f"WITH t AS ({DIRTY}) SELECT count(*) AS n, round(sum(qty_n), 2) AS s, round(sum(disc_n), 2) AS e FROM t "
    "WHERE qty_n IS NOT NULL AND disc_n IS NOT NULL",
)
def _(spark, d):
    kept = schema.drop_missing(dirty(spark, d), "qty_n", "disc_n")
    return rounded(kept.agg(F.count("*").alias("n"), F.sum("qty_n").alias("s"), F.sum("disc_n").alias("e")), 2, "s", "e")


@query(
    "b10_columns_over_half_missing",
    "SELECT * FROM (" + per_column(COLUMNS, "'{c}' AS \"column\", count(*) - count({c}) AS missing, count(*) AS rows") + ") WHERE missing > rows * 0.5",
)
def _(spark, d):
    return longs(stats.missing_counts(dirty(spark, d)).where("missing > rows * 0.5").drop("ordinal"), "missing", "rows")


# ---------------------------------------------------------------- statistics


@query(
    "e01_basic_info",
    "SELECT count(*) AS num_rows, 11::BIGINT AS num_columns, 8::BIGINT AS numeric_columns, 2::BIGINT AS categorical_columns FROM lineitem",
)
def _(spark, d):
    return longs(schema.basic_info(read_table(spark, d, "lineitem")), "num_rows", "num_columns", "numeric_columns", "categorical_columns")


@query(
    "e02_missing_values",
    f"WITH t AS ({DIRTY}), m AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, count(*) AS n FROM t" for c in COLUMNS)
    + ') SELECT "column", missing, CAST(sum(missing) OVER () AS BIGINT) AS total_missing, '
    f"round_even(sum(missing) OVER () * 100.0E0 / (n * {len(COLUMNS)}), 2) AS missing_percentage FROM m",
)
def _(spark, d):
    return longs(stats.missing_values(dirty(spark, d)), "missing", "total_missing")


@query(
    "e03_missing_chart",
    f"WITH t AS ({DIRTY}), m AS ("
    + " UNION ALL ".join(f"SELECT {i} AS ordinal, '{c}' AS \"column\", count(*) - count({c}) AS missing, count(*) AS n FROM t" for i, c in enumerate(COLUMNS))
    + ') SELECT row_number() OVER (ORDER BY missing DESC, ordinal) AS position, "column", missing, '
    "round(missing * 100.0E0 / n, 6) AS percentage FROM m WHERE missing > 0",
)
def _(spark, d):
    return longs(rounded(stats.missing_chart(dirty(spark, d), "engine"), 6, "percentage"), "position", "missing")


@query(
    "e03_missing_chart_dashboard",
    f"WITH t AS ({DIRTY}), m AS ("
    + " UNION ALL ".join(f"SELECT {i} AS ordinal, '{c}' AS \"column\", count(*) - count({c}) AS missing, count(*) AS n FROM t" for i, c in enumerate(COLUMNS))
    + ') SELECT row_number() OVER (ORDER BY ordinal) AS position, "column", missing, '
    "round_even(missing * 100.0E0 / n, 2) AS percentage FROM m WHERE missing > 0",
)
def _(spark, d):
    return longs(stats.missing_chart(dirty(spark, d)), "position", "missing")


REPEATED = "SELECT l_returnflag, l_linestatus, l_linenumber, l_quantity FROM lineitem"


@query(
    "e04_duplicate_count",
    f"WITH a AS (SELECT * FROM nation UNION ALL SELECT * FROM nation WHERE n_nationkey < 4), b AS ({REPEATED}) "
    "SELECT 'nation' AS source, (SELECT count(*) FROM a) - (SELECT count(*) FROM (SELECT DISTINCT * FROM a)) AS duplicates "
    "UNION ALL SELECT 'lineitem', (SELECT count(*) FROM b) - (SELECT count(*) FROM (SELECT DISTINCT * FROM b)) "
    "UNION ALL SELECT 'orders', (SELECT count(*) FROM orders) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders))",
)
def _(spark, d):
    nation = read_table(spark, d, "nation")
    items = read_table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity")
    sources = {"nation": nation.unionAll(nation.where("n_nationkey < 4")), "lineitem": items, "orders": read_table(spark, d, "orders")}
    return spark.createDataFrame([(k, stats.duplicate_count(t)) for k, t in sources.items()], "source string, duplicates bigint")


DESCRIBE = (
    "'{c}' AS \"column\", count({c}) AS \"count\", round(avg({c}), 7) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, "
    "round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS max, "
    "CASE WHEN max({c}) = min({c}) THEN 0.0 ELSE round(skewness({c}), 6) END AS skew, "
    "CASE WHEN max({c}) = min({c}) THEN 0.0 ELSE round(kurtosis({c}), 6) END AS kurtosis"
)


@query("e05_describe", per_column(NUM, DESCRIBE))
def _(spark, d):
    out = stats.describe(dirty(spark, d), NUM).drop("zeros")
    return rounded(rounded(out, 7, "mean"), 6, "std", "q25", "q50", "q75", "skew", "kurtosis")


@query(
    "e06_numeric_stats",
    per_column(NUM, DESCRIBE + ", count(DISTINCT {c}) AS \"distinct\", count(*) FILTER ({c} = 0) AS zeros"),
)
def _(spark, d):
    out = longs(stats.numeric_stats(dirty(spark, d), NUM), "distinct", "zeros")
    return rounded(rounded(out, 7, "mean"), 6, "std", "q25", "q50", "q75", "skew", "kurtosis")


@query(
    "e07_skewness",
    per_column(
        ["price_o", "o_totalprice", "o_custkey"], "'{c}' AS \"column\", round(skewness({c}), 6) AS skew", as_sql("orders", ORDERS)
    ),
)
def _(spark, d):
    out = stats.describe(derived(spark, d, "orders", ORDERS), ["price_o", "o_totalprice", "o_custkey"])
    return rounded(out.select("column", "skew"), 6, "skew")


@query(
    "e08_kurtosis",
    per_column(
        ["price_o", "o_totalprice", "o_custkey"], "'{c}' AS \"column\", round(kurtosis({c}), 5) AS kurtosis", as_sql("orders", ORDERS)
    ),
)
def _(spark, d):
    out = stats.describe(derived(spark, d, "orders", ORDERS), ["price_o", "o_totalprice", "o_custkey"])
    return rounded(out.select("column", "kurtosis"), 5, "kurtosis")


@query(
    "e09_quantiles",
    f"WITH t AS ({DIRTY}) " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({p} AS DOUBLE) AS p, round(quantile_cont({c}, {p}), 6) AS q FROM t"
        for c in ("l_extendedprice", "qty_n") for p in (0.01, 0.1, 0.5, 0.9, 0.99)
    ),
)
def _(spark, d):
    from lodestat.operators.quantiles import exact_quantiles

    probs = [0.01, 0.1, 0.5, 0.9, 0.99]
    # small_column below the table size: the sketch, bracket and select passes all run
    found = exact_quantiles(dirty(spark, d), ["l_extendedprice", "qty_n"], probs, small_column=1000)
    rows = [(c, p, q) for c, qs in found.items() for p, q in zip(probs, qs)]
    return rounded(spark.createDataFrame(rows, "column string, p double, q double"), 6, "q")


@query(
    "e10_distinct_counts",
    per_column([c for c in COLUMNS], "'{c}' AS \"column\", count(DISTINCT {c}) AS \"distinct\", count(DISTINCT {c}) = 1 AS constant"),
)
def _(spark, d):
    t = dirty(spark, d)
    constants = stats.constant_columns(t)
    return longs(stats.distinct_counts(t), "distinct").withColumn("constant", F.col("column").isin(constants))


TEXTS = ["o_orderstatus", "o_orderpriority", "date_s"]


@query(
    "e11_top_values",
    f"WITH t AS ({as_sql('orders', ORDERS)}), m AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS \"count\" FROM t WHERE {c} IS NOT NULL GROUP BY {c}" for c in TEXTS)
    + '), r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY "count" DESC, value) AS rank FROM m) SELECT * FROM r WHERE rank <= 10',
)
def _(spark, d):
    return longs(stats.top_values(derived(spark, d, "orders", ORDERS), TEXTS), "rank", "count")


@query(
    "e12_categorical_stats",
    f"WITH t AS ({DIRTY}), m AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM t WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in ("l_returnflag", "l_linestatus", "flag_n")
    )
    + '), r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS k FROM m) '
    'SELECT "column", count(*) AS unique_values, max(CASE WHEN k = 1 THEN value END) AS most_common, max(n) AS most_common_count, '
    "string_agg(CASE WHEN k <= 10 THEN concat(value, '=', n) END, '; ' ORDER BY k) AS top_values FROM r GROUP BY \"column\"",
)
def _(spark, d):
    return longs(stats.categorical_stats(dirty(spark, d)), "unique_values", "most_common_count")


@query(
    "e13_class_balance",
    f"WITH t AS ({DIRTY}), c AS (SELECT flag_n AS class, count(*) AS n FROM t WHERE flag_n IS NOT NULL GROUP BY flag_n) "
    'SELECT class, n AS "count", round(n / sum(n) OVER (), 9) AS share, min(n) OVER () / sum(n) OVER () < 0.1 AS imbalanced FROM c',
)
def _(spark, d):
    return rounded(stats.class_balance(dirty(spark, d), "flag_n"), 9, "share")


# ---------------------------------------------------------------- charts

HIST = ["l_quantity", "l_extendedprice", "qty_n", "const_c"]


@query(
    "e14_histogram",
    f"WITH t AS ({DIRTY}), "
    + ", ".join(
        f"b{i} AS (SELECT CASE WHEN min({c}) = max({c}) THEN min({c}) - 0.5E0 ELSE min({c}) END AS lo, "
        f"CASE WHEN min({c}) = max({c}) THEN max({c}) + 0.5E0 ELSE max({c}) END AS hi, avg({c}) AS mean, quantile_cont({c}, 0.5) AS median FROM t), "
        f"c{i} AS (SELECT CASE WHEN {c} = hi THEN 19 ELSE (SELECT max(k) FROM range(20) r(k) WHERE {c} >= lo + k * ((hi - lo) / 20)) END AS bin, count(*) AS n "
        f"FROM t, b{i} WHERE {c} IS NOT NULL GROUP BY 1)"
        for i, c in enumerate(HIST)
    )
    + " "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(k AS BIGINT) AS bin, round(lo + k * ((hi - lo) / 20), 6) AS left_edge, round(mean, 6) AS mean, "
        f"round(median, 6) AS median, coalesce(n, 0) AS \"count\" FROM range(20) r(k) CROSS JOIN b{i} LEFT JOIN c{i} ON c{i}.bin = k"
        for i, c in enumerate(HIST)
    ),
)
def _(spark, d):
    return longs(rounded(charts.histogram(dirty(spark, d), HIST), 6, "left_edge", "mean", "median"), "bin", "count")


@query(
    "e15_density_curve",
    "WITH s AS (SELECT count(o_totalprice) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, "
    "pow(count(o_totalprice), -0.2E0) * stddev_samp(o_totalprice) AS h FROM orders), "
    "g AS (SELECT k, lo + k * ((hi - lo) / 49) AS x, n, h FROM s, range(50) r(k)) "
    "SELECT CAST(k AS BIGINT) AS point, round(max(x), 4) AS x, "
    "round(sum(exp(-((o_totalprice - x) / h) * ((o_totalprice - x) / h) / 2)) / (max(n) * max(h) * sqrt(2 * pi())) * 1000000, 6) AS density "
    "FROM g, orders GROUP BY k",
)
def _(spark, d):
    out = charts.kde(read_table(spark, d, "orders"), "o_totalprice", 50).withColumn("density", F.col("density") * 1000000)
    return longs(rounded(rounded(out, 4, "x"), 6, "density"), "point")


BOX = ["price_o", "o_totalprice", "o_custkey"]
BOXES = ", ".join(
    f"q{i} AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM t)" for i, c in enumerate(BOX)
)


@query(
    "e16_box_plot",
    per_column(
        BOX,
        "'{c}' AS \"column\", round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS median, "
        "round(quantile_cont({c}, 0.75), 6) AS q3, round(max({c}), 6) AS max",
        as_sql("orders", ORDERS),
    ),
)
def _(spark, d):
    return rounded(charts.box_plot(derived(spark, d, "orders", ORDERS), BOX)[0], 6, "min", "q1", "median", "q3", "max")


@query(
    "e16_box_plot_outliers",
    f"WITH t AS ({as_sql('orders', ORDERS)}), {BOXES}, o AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM t, q{i} WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)"
        for i, c in enumerate(BOX)
    )
    + '), r AS (SELECT "column", row_number() OVER (PARTITION BY "column" ORDER BY value) AS position, round(value, 4) AS value FROM o) '
    "SELECT * FROM r WHERE position <= 50",
)
def _(spark, d):
    out = charts.box_plot(derived(spark, d, "orders", ORDERS), BOX)[1]
    return longs(rounded(out, 4, "value"), "position")


CORR = ["l_quantity", "l_extendedprice", "qty_n", "disc_n", "const_c"]


def corr_sql(a, b):
    both = f"FILTER ({a} IS NOT NULL AND {b} IS NOT NULL)"
    return f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) {both} * stddev_pop({b}) {both}, 0)"


CORR_SQL = f"WITH t AS ({DIRTY}) " + " UNION ALL ".join(
    f"SELECT {i} AS i, {j} AS j, '{a}' AS col1, '{b}' AS col2, {corr_sql(a, b)} AS r FROM t"
    for i, a in enumerate(CORR)
    for j, b in enumerate(CORR)
)


@query("e17_corr_matrix", f"SELECT col1, col2, round(r, 6) + 0.0 AS r FROM ({CORR_SQL})")
def _(spark, d):
    return rounded(stats.corr_matrix(dirty(spark, d), CORR).select("col1", "col2", "r"), 6, "r")


@query("e17_corr_matrix_dashboard", f"SELECT col1, col2, coalesce(round(r, 6) + 0.0, 0.0) AS r FROM ({CORR_SQL})")
def _(spark, d):
    return rounded(stats.corr_matrix(dirty(spark, d), CORR, "dashboard").select("col1", "col2", "r"), 6, "r")


@query("e18_strong_correlations", f"SELECT col1, col2, round(r, 6) AS r FROM ({CORR_SQL}) WHERE i < j AND abs(r) > 0.7")
def _(spark, d):
    return rounded(stats.strong_correlations(dirty(spark, d), 0.7, CORR), 6, "r")


@query(
    "e19_top_correlations",
    f"SELECT col1, col2, round(abs(r), 6) AS abs_r FROM ({CORR_SQL}) WHERE i < j AND r IS NOT NULL ORDER BY abs(r) DESC, col1, col2 LIMIT 5",
)
def _(spark, d):
    return rounded(stats.top_correlations(dirty(spark, d), 5, CORR), 6, "abs_r")


@query(
    "e20_scatter_pairs",
    "SELECT col1 AS x_column, col2 AS y_column, round(r, 6) AS correlation FROM "
    f"({CORR_SQL}) WHERE i < j AND abs(r) > 0.3 ORDER BY i, j LIMIT 6",
)
def _(spark, d):
    return rounded(charts.scatter_pairs(dirty(spark, d), CORR), 6, "correlation")


@query(
    "e20_scatter_points",
    "SELECT o_totalprice AS x, CAST(o_custkey AS DOUBLE) AS y FROM orders ORDER BY md5(concat('42|', o_orderkey)), o_orderkey LIMIT 200",
)
def _(spark, d):
    return charts.scatter_points(read_table(spark, d, "orders"), "o_totalprice", "o_custkey", ["o_orderkey"])


@query(
    "e21_scatter_pairs_engine",
    f"SELECT col1 AS x_column, col2 AS y_column, round(r, 6) + 0.0 AS correlation FROM ({CORR_SQL}) WHERE i < j AND i < 4 AND j < 4",
)
def _(spark, d):
    return rounded(charts.scatter_pairs(dirty(spark, d), CORR[:4], "engine"), 6, "correlation")


@query(
    "e22_json_safe",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS safe FROM orders",
)
def _(spark, d):
    odd = (
        F.when(F.col("o_orderkey") % 3 == 0, F.lit(float("nan")))
        .when(F.col("o_orderkey") % 5 == 0, F.lit(float("-inf")))
        .otherwise(F.col("o_totalprice"))
    )
    return read_table(spark, d, "orders").select("o_orderkey", json_safe(odd).alias("safe"))


@query("e23_value_ranges", per_column(NUM, "'{c}' AS \"column\", round(max({c}) - min({c}), 6) AS range"))
def _(spark, d):
    return rounded(stats.value_ranges(dirty(spark, d), NUM), 6, "range")


@query(
    "e24_sigma_outliers",
    per_column(
        BOX,
        "'{c}' AS \"column\", greatest(max({c}) - avg({c}), avg({c}) - min({c})) > 3 * stddev_samp({c}) AS has_outliers",
        as_sql("orders", ORDERS),
    ),
)
def _(spark, d):
    return stats.sigma_outliers(derived(spark, d, "orders", ORDERS), BOX)


# ---------------------------------------------------------------- time series


@query(
    "f01_detect_datetime",
    "SELECT 'o_orderdate' AS \"column\", count(o_orderdate) AS present FROM orders UNION ALL SELECT 'date_s', count(o_orderdate) FROM orders",
)
def _(spark, d):
    t = derived(spark, d, "orders", ORDERS)
    found = series.detect_datetime(t)
    info = schema.dataset_info(t).where(F.col("column").isin(found))
    return info.select("column", F.col("non_null").cast("bigint").alias("present"))


@query(
    "f02_time_series",
    f"WITH t AS ({as_sql('events', EVENTS)}) SELECT 'value_n' AS series, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t, value_n AS value FROM t WHERE value_n IS NOT NULL "
    "UNION ALL SELECT 'user_id', strftime(ts, '%Y-%m-%d %H:%M:%S'), CAST(user_id AS DOUBLE) FROM t",
)
def _(spark, d):
    out = series.time_series(derived(spark, d, "events", EVENTS), "ts", ["value_n", "user_id"])
    return out.withColumn("t", F.date_format("t", "yyyy-MM-dd HH:mm:ss"))


def sampled(step):
    return (
        "WITH s AS (SELECT 'value' AS series, ts AS t, value FROM events), "
        "n AS (SELECT *, row_number() OVER (ORDER BY t, value) - 1 AS k, count(*) OVER () AS n FROM s) "
        "SELECT series, strftime(t, '%Y-%m-%d') AS date, value, k // step AS position FROM "
        f"(SELECT *, {step} AS step FROM n) WHERE k % step = 0"
    )


@query("f03_downsample", sampled("CASE WHEN n <= 1000 THEN 1 ELSE n // 1000 END"))
def _(spark, d):
    out = series.downsample(series.time_series(read_table(spark, d, "events"), "ts", ["value"]), 1000)
    return out.select("series", series.format_date(F.col("t")).alias("date"), "value", F.col("position").cast("bigint").alias("position"))


@query("f04_downsample_chart", sampled("CASE WHEN n <= 100 THEN 1 ELSE CAST(ceil(n / 100.0) AS BIGINT) END"))
def _(spark, d):
    points = series.time_series(read_table(spark, d, "events"), "ts", ["value"])
    # a low limit on group size: the series is cut into sorted pieces
    out = series.downsample(points, 100, "ceil", max_group_rows=500)
    return out.select("series", series.format_date(F.col("t")).alias("date"), "value", F.col("position").cast("bigint").alias("position"))


@query("f05_format_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders")
def _(spark, d):
    return read_table(spark, d, "orders").select("o_orderkey", series.format_date(F.col("o_orderdate")).alias("date"))


@query(
    "g01_preview",
    "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10",
)
def _(spark, d):
    return schema.preview(read_table(spark, d, "customer"), 10, ["c_acctbal", "c_custkey"])


@query(
    "g05_score_band",
    "SELECT band, count(*) AS n FROM (SELECT CASE WHEN l_discount * 10 > 0.8 THEN 'high' WHEN l_discount * 10 > 0.5 THEN 'medium' ELSE 'low' END AS band "
    "FROM lineitem) GROUP BY band",
)
def _(spark, d):
    items = read_table(spark, d, "lineitem")
    return items.select(score_band(F.col("l_discount") * 10).alias("band")).groupBy("band").agg(F.count("*").alias("n"))


@query(
    "g06_correlation_band",
    f"SELECT col1, col2, CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.4 THEN 'moderate' ELSE 'weak' END AS band FROM ({CORR_SQL})",
)
def _(spark, d):
    return stats.corr_matrix(dirty(spark, d), CORR).select("col1", "col2", correlation_band(F.col("r")).alias("band"))
