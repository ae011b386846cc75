"""Inputs derived from the given tables, written once for Spark SQL and ANSI SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestat.sources.readers import read_table

LINEITEM = [
    "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS qty_n",
    "CASE WHEN l_orderkey % 31 = 0 THEN NULL ELSE l_tax END AS tax_n",
    "CASE WHEN l_orderkey % 10 < 6 THEN NULL ELSE l_discount END AS disc_n",
    "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_returnflag END AS flag_n",
    "CAST(3 AS DOUBLE) AS const_c",
]
ORDERS = [
    "CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice * 50 ELSE o_totalprice END AS price_o",
    "CASE WHEN o_orderkey % 5 = 0 THEN 'bad' ELSE concat(CAST(o_orderkey AS VARCHAR(20)), '.7') END AS num_s",
    "CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)) AS date_s",
]
EVENTS = ["CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value_n"]
PREDICTIONS = [
    "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label",
    "CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS prediction",
    "l_extendedprice AS score",
]
MULTICLASS = [
    "l_returnflag AS label",
    "CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS prediction",
]
REGRESSION = ["l_extendedprice AS label", "l_quantity * 1500 AS prediction"]
COMMANDS = [
    "concat(CASE CAST(conv_id % 4 AS INT) WHEN 0 THEN 'please analyze and show statistics ' "
    "WHEN 1 THEN 'train a random forest to predict \"c_acctbal\" ' "
    "WHEN 2 THEN 'why, explain feature importance ' ELSE '' END, text) AS cmd",
]
# results of one rule per supplier and line status, standing for a table of model runs
RESULTS = """
SELECT l_linestatus AS target, concat('supplier_', CAST(l_suppkey AS VARCHAR(20))) AS model_name,
  CASE WHEN l_suppkey % 2 = 0 THEN 'classification' ELSE 'regression' END AS problem_type,
  round(avg(CASE WHEN (l_discount >= 0.05) = (l_returnflag = 'R') THEN 1.0E0 ELSE 0.0E0 END), 9) AS test_score,
  round(avg(CASE WHEN (l_tax >= 0.04) = (l_returnflag = 'R') THEN 1.0E0 ELSE 0.0E0 END), 9) AS cv_score,
  CASE WHEN l_suppkey % 5 = 0 THEN NULL
       ELSE round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0E0 ELSE 0.0E0 END) * 1.7E0, 9) END AS "precision",
  round(avg(CASE WHEN l_quantity > 20 THEN 1.0E0 ELSE 0.0E0 END), 9) AS "recall",
  round(avg(CASE WHEN l_linenumber = 1 THEN 1.0E0 ELSE 0.0E0 END) * 0.8E0, 9) AS rarest_share,
  max(l_extendedprice) > 100000 AS has_outliers
FROM lineitem GROUP BY l_linestatus, l_suppkey
"""


def derived(spark: SparkSession, folder: str, table: str, exprs: list[str], keep: str = "*") -> DataFrame:
    return read_table(spark, folder, table).selectExpr(*keep.split(", "), *exprs)


def as_sql(table: str, exprs: list[str], keep: str = "*") -> str:
    return f"SELECT {', '.join([keep, *exprs] if keep else exprs)} FROM {table}"


def results(spark: SparkSession, folder: str) -> DataFrame:
    text = RESULTS.replace('"precision"', "`precision`").replace('"recall"', "`recall`").replace("FROM lineitem", "FROM {lineitem}")
    return spark.sql(text, lineitem=read_table(spark, folder, "lineitem"))
