"""Queries: files, profile, models, scoring, tuning and sampled explanations."""

from __future__ import annotations

import math
import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lodestat.ml import explain, shap, train
from lodestat.operators import quality
from lodestat.operators.neighbors import mean_label, nearest, vote
from lodestat.plans.inputs import LINEITEM, RESULTS, as_sql, derived, results
from lodestat.plans.profile import column_profile, profile
from lodestat.plans.queries_stats import per_column
from lodestat.plans.registry import longs, query, rounded
from lodestat.session import shared_folder
from lodestat.sources import readers, sinks
from lodestat.sources.readers import read_table


def scratch(spark, name):
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- files


@query("a01_csv_round_trip", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, d):
    path = scratch(spark, "customer-csv")
    sinks.write_csv(read_table(spark, d, "customer"), path)
    return readers.read_csv(spark, path)


CSV_DOCUMENTS = "SELECT doc_id, text, lang, source, n_chars::BIGINT AS n_chars FROM documents"


@query("a01_csv_line_breaks", CSV_DOCUMENTS)
def _(spark, d):
    path = scratch(spark, "documents-csv")
    sinks.write_csv(read_table(spark, d, "documents"), path)
    return readers.read_csv(spark, path)


TOKENS = [
    "CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN 'NA' WHEN 1 THEN 'n/a' WHEN 2 THEN '' WHEN 3 THEN 'null' WHEN 4 THEN ' NaN ' "
    "ELSE CAST(o_custkey AS VARCHAR(20)) END AS custkey_s",
    "CASE WHEN o_orderkey % 4 = 0 THEN 'None' ELSE o_orderpriority END AS priority_s",
]


@query(
    "a02_normalize_na",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <= 4 THEN NULL ELSE o_custkey::DOUBLE END AS custkey_s, "
    "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS priority_s FROM orders",
)
def _(spark, d):
    t = derived(spark, d, "orders", TOKENS, "o_orderkey")
    t = readers.infer_types(readers.normalize_na(t))
    return t.withColumn("custkey_s", F.col("custkey_s").cast("double"))


@query("a03_json_round_trip", "SELECT p_partkey, p_name, p_brand, p_type, p_size::BIGINT AS p_size, p_retailprice FROM part")
def _(spark, d):
    path = scratch(spark, "part-json")
    read_table(spark, d, "part").write.json(path)
    return readers.read_json(spark, path, multi_line=False)


#: Keys of one array: more rows make more arrays, none of them longer.
ARRAY_KEYS = 10_000


@query("a03_json_array", "SELECT p_partkey, p_name, p_brand, p_type, p_size::BIGINT AS p_size, p_retailprice FROM part")
def _(spark, d):
    path = scratch(spark, "part-json-array")
    rows = read_table(spark, d, "part")
    arrays = rows.groupBy(F.floor(F.col("p_partkey") / ARRAY_KEYS).alias("file")).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_json(spark, path)


@query(
    "a05_score_file",
    # a three-class Gaussian naive Bayes on one standardised feature, applied to rows read from a CSV file
    "WITH f AS (SELECT o_orderstatus AS class, o_totalprice AS x FROM orders WHERE concat('0x', substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT % 100 >= 20), "
    "m AS (SELECT avg(x) AS m, stddev_pop(x) AS s, count(*) AS n FROM f), "
    "c AS (SELECT class, count(*) / max(n) AS prior, avg((x - m) / s) AS mean, var_pop((x - m) / s) AS var FROM f, m GROUP BY class), "
    "l AS (SELECT o_orderkey, class, ln(prior) - 0.5 * ln(2 * pi() * var) - pow((o_totalprice - m) / s - mean, 2) / (2 * var) AS l FROM orders, m, c), "
    "p AS (SELECT *, exp(l - max(l) OVER (PARTITION BY o_orderkey)) AS e FROM l), q AS (SELECT *, e / sum(e) OVER (PARTITION BY o_orderkey) AS p FROM p) "
    "SELECT o_orderkey, arg_max(class, p) AS prediction, round(max(p), 5) AS prediction_confidence, "
    "round(max(p) FILTER (class = 'F'), 5) AS p_f, round(max(p) FILTER (class = 'O'), 5) AS p_o, round(max(p) FILTER (class = 'P'), 5) AS p_p FROM q GROUP BY o_orderkey",
)
def _(spark, d):
    t = read_table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    model, _ = train.fit(t, "o_orderstatus", ["o_orderkey"], "naive_bayes")
    path = scratch(spark, "orders-csv")
    sinks.write_csv(t.drop("o_orderstatus"), path)
    scored = train.score(model, readers.read_csv(spark, path), ["o_orderkey"])
    each = [F.get("probabilities", F.lit(i)).alias(f"p_{c.lower()}") for i, c in enumerate(model.classes)]
    return rounded(scored.select("o_orderkey", "prediction", "prediction_confidence", *each), 5, "prediction_confidence", "p_f", "p_o", "p_p")


BEST = (
    f"WITH t AS ({RESULTS}), r AS (SELECT *, row_number() OVER (PARTITION BY target, problem_type ORDER BY test_score DESC, model_name) AS k, "
    "count(*) OVER (PARTITION BY target, problem_type) AS n FROM t) "
)


@query(
    "a08_experiment_log",
    BEST
    + "SELECT concat('job-', target, '-', problem_type) AS job_id, concat('2024-01-0', CASE WHEN problem_type = 'regression' THEN 2 ELSE 1 END) AS timestamp, "
    "target AS target_column, problem_type, model_name AS best_model, test_score AS score, 'accuracy' AS metric, n AS models_trained FROM r WHERE k = 1",
)
def _(spark, d):
    from lodestat.operators.ranking import leaderboard

    runs = results(spark, d)
    sizes = runs.groupBy("target", "problem_type").agg(F.count("*").cast("int").alias("models_trained"))
    best = leaderboard(runs, ["target", "problem_type"]).where("rank = 1").join(sizes, ["target", "problem_type"])
    rows = best.select(
        F.concat_ws("-", F.lit("job"), "target", "problem_type").alias("job_id"),
        F.when(F.col("problem_type") == "regression", "2024-01-02").otherwise("2024-01-01").alias("timestamp"),
        F.col("target").alias("target_column"),
        "problem_type",
        F.col("model_name").alias("best_model"),
        F.col("test_score").alias("score"),
        F.lit("accuracy").alias("metric"),
        "models_trained",
    )
    path = scratch(spark, "experiments")
    sinks.log_experiment(rows.where("problem_type = 'regression'"), path)
    sinks.log_experiment(rows.where("problem_type = 'classification'"), path)
    return longs(sinks.read_experiments(spark, path), "models_trained")


# ---------------------------------------------------------------- profile

PROFILED = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
OTHERS = ["l_returnflag", "l_linestatus", "l_shipdate"]
NUMBERS = (
    "'{c}' AS \"column\", count(*) - count({c}) AS missing, count({c}) AS \"count\", round(avg({c}), 7) AS mean, round(stddev_samp({c}), 6) AS std, "
    "CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, "
    "round(quantile_cont({c}, 0.75), 6) AS q75, CAST(max({c}) AS DOUBLE) AS max, round(skewness({c}), 5) AS skew, round(kurtosis({c}), 5) AS kurtosis"
)


@query(
    "e25_profile_columns",
    per_column(PROFILED, NUMBERS, "SELECT * FROM lineitem")
    + "".join(
        f" UNION ALL SELECT '{c}', count(*) - count({c}), count({c}), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM lineitem" for c in OTHERS
    ),
)
def _(spark, d):
    out = column_profile(read_table(spark, d, "lineitem"))
    return rounded(rounded(rounded(out, 7, "mean"), 6, "std", "q25", "q50", "q75"), 5, "skew", "kurtosis")


def whole_profile(rules):
    def run(spark, d):
        t = derived(spark, d, "orders", ["CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price_n"])
        parts = [
            table.select(F.lit(name).alias("part"), F.to_json(F.struct(*table.columns)).alias("row")) for name, table in profile(t, rules).items()
        ]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.union(part)
        return whole

    return run


query("e25_full_profile_dashboard")(whole_profile("dashboard"))
query("e25_full_profile_engine")(whole_profile("engine"))


# ---------------------------------------------------------------- nearest neighbours

SPLIT = "concat('0x', substr(md5(CAST(vec_id AS VARCHAR)), 1, 8))::BIGINT % 100 < 20"
KNN = (
    f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x, label, {SPLIT} AS test FROM embeddings), "
    "p AS (SELECT a.vec_id AS test_key, b.vec_id AS train_key, b.label, list_distance(a.x, b.x) AS dist FROM e a, e b WHERE a.test AND NOT b.test), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY test_key ORDER BY dist, train_key) AS rank FROM p QUALIFY rank <= 5) "
)


def neighbors(spark, d, k=5, **sizes):
    from lodestat.ml.prepare import split

    rows = read_table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("double").alias("label"))
    near, far = split(rows, 0.2, ["vec_id"])
    return nearest(far.select(F.col("vec_id").alias("test_key"), "x"), near.select(F.col("vec_id").alias("train_key"), "x", "label"), k, **sizes)


@query("h13_nearest_neighbors", KNN + "SELECT test_key, train_key, round(dist, 6) AS distance, rank FROM n")
def _(spark, d):
    found = neighbors(spark, d, pivots=16, block_rows=100).drop("label")
    return longs(rounded(found, 6, "distance"), "rank")


@query(
    "h13_knn_classify",
    KNN
    + ", v AS (SELECT test_key, label, count(*) AS w FROM n GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY test_key ORDER BY w DESC, label) AS k, "
    "sum(w) OVER (PARTITION BY test_key) AS t FROM v) SELECT test_key, label AS prediction, round(w / t, 6) AS confidence FROM r WHERE k = 1",
)
def _(spark, d):
    return longs(rounded(vote(neighbors(spark, d)), 6, "confidence"), "prediction")


@query(
    "h13_knn_regress_distance",
    KNN + "SELECT test_key, round(sum(label / dist) / sum(1 / dist), 5) AS prediction FROM n GROUP BY test_key",
)
def _(spark, d):
    return rounded(mean_label(neighbors(spark, d), "distance"), 5, "prediction")


# ---------------------------------------------------------------- linear models with a closed form

LINE = "SELECT p_partkey AS k, p_size AS x, p_retailprice + 0.5E0 * p_size AS y FROM part"
TRAIN = "concat('0x', substr(md5(CAST(k AS VARCHAR)), 1, 8))::BIGINT % 100 >= 20"
# one standardised feature: z = (x - m) / s with the population deviation; c is the mean product of z and y
MOMENTS = (
    f"WITH t AS ({LINE}), f AS (SELECT * FROM t WHERE {TRAIN}), m AS (SELECT avg(x) AS m, stddev_pop(x) AS s, count(*) AS n, avg(y) AS b FROM f), "
    "z AS (SELECT n, m, s, b, avg((x - m) / s * (y - b)) AS c, avg((x - m) / s * (x - m) / s) AS v FROM f, m GROUP BY ALL) "
)


def line(spark, d):
    return read_table(spark, d, "part").select(
        F.col("p_partkey").alias("k"), F.col("p_size").alias("x"), (F.col("p_retailprice") + 0.5 * F.col("p_size")).alias("y")
    )


def coefficients(spark, d, name, digits=4):
    model, _ = train.fit(line(spark, d), "y", ["k"], name, problem="regression")
    row = [(float(model.model.coefficients[0]), float(model.model.intercept))]
    return rounded(spark.createDataFrame(row, "slope double, intercept double"), digits, "slope", "intercept")


@query("h07_linear_regression", MOMENTS + "SELECT round(c / v, 4) AS slope, round(b, 4) AS intercept FROM z")
def _(spark, d):
    return coefficients(spark, d, "linear")


@query("h08_ridge", MOMENTS + "SELECT round(c / (v + 1.0E0 / n), 4) AS slope, round(b, 4) AS intercept FROM z")
def _(spark, d):
    return coefficients(spark, d, "ridge")


@query("h09_lasso", MOMENTS + "SELECT round(sign(c) * greatest(abs(c) - 1, 0) / v, 4) AS slope, round(b, 4) AS intercept FROM z")
def _(spark, d):
    return coefficients(spark, d, "lasso")


@query("h10_elasticnet", MOMENTS + "SELECT round(sign(c) * greatest(abs(c) - 0.5, 0) / (v + 0.5), 4) AS slope, round(b, 4) AS intercept FROM z")
def _(spark, d):
    return coefficients(spark, d, "elasticnet")


@query(
    "h24_batch_score",
    MOMENTS
    + "SELECT k, CASE WHEN k % 9 = 0 THEN NULL ELSE x END::DOUBLE AS x, round(b + c / v * (CASE WHEN k % 9 = 0 THEN m ELSE x END - m) / s, 4) AS prediction FROM t, z",
)
def _(spark, d):
    model, _ = train.fit(line(spark, d), "y", ["k"], "linear", problem="regression")
    holes = line(spark, d).select("k", F.when(F.col("k") % 9 != 0, F.col("x")).cast("double").alias("x"))
    return rounded(train.score(model, holes, ["k"]), 4, "prediction")


@query("a09_saved_model", MOMENTS + "SELECT k, round(b + c / v * (x - m) / s, 4) AS prediction FROM t, z")
def _(spark, d):
    model, _ = train.fit(line(spark, d), "y", ["k"], "linear", problem="regression")
    path = scratch(spark, "model")
    sinks.save_trained(model, path)
    scored = train.score(sinks.load_trained(path), line(spark, d).select("k", "x"), ["k"])
    return rounded(scored.select("k", "prediction"), 4, "prediction")


@query("h23_importances", MOMENTS + "SELECT 'x' AS feature, round(abs(c / v), 4) AS importance FROM z")
def _(spark, d):
    model, _ = train.fit(line(spark, d), "y", ["k"], "linear", problem="regression")
    return rounded(spark.createDataFrame(train.importances(model), "feature string, importance double"), 4, "importance")


@query(
    "h14_naive_bayes",
    "WITH f AS (SELECT o_orderstatus AS class, o_totalprice AS x FROM orders WHERE concat('0x', substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT % 100 >= 20), "
    "m AS (SELECT avg(x) AS m, stddev_pop(x) AS s, count(*) AS n FROM f) "
    "SELECT class, round(count(*) / max(n), 6) AS prior, round(avg((x - m) / s), 6) + 0.0 AS mean, round(var_pop((x - m) / s), 6) AS variance FROM f, m GROUP BY class",
)
def _(spark, d):
    t = read_table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    found, _ = train.fit(t, "o_orderstatus", ["o_orderkey"], "naive_bayes")
    nb = found.model
    rows = []
    for i, label in enumerate(found.classes):
        rows.append((label, math.exp(nb.pi[i]), float(nb.theta.toArray()[i][0]), float(nb.sigma.toArray()[i][0])))
    return rounded(spark.createDataFrame(rows, "class string, prior double, mean double, variance double"), 6, "prior", "mean", "variance")


# ---------------------------------------------------------------- models on targets that one feature decides

TEST = "concat('0x', substr(md5(CAST(p_partkey AS VARCHAR)), 1, 8))::BIGINT % 100 < 20"
DECIDED = f"SELECT p_partkey AS row_key, (p_size % 8 >= 4)::INT::DOUBLE AS label, (p_size % 8 >= 4)::INT::DOUBLE AS prediction FROM part WHERE {TEST}"
STEPPED = f"SELECT p_partkey AS row_key, (p_size % 8 * 10)::DOUBLE AS label, (p_size % 8 * 10)::DOUBLE AS prediction FROM part WHERE {TEST}"


def sizes(spark, d, price=False):
    """Parts with a feature of eight values, and the price as one that does not matter."""
    f = F.col("p_size") % 8
    other = ["p_retailprice"] if price else []
    return read_table(spark, d, "part").select("p_partkey", f.alias("f"), *other, (f >= 4).cast("int").alias("above"), (f * 10.0).alias("steps"))


def predictions(found):
    """Label and prediction of the test rows."""
    model, ready = found
    return model.predict(ready.test).select("row_key", "label", F.col("prediction").cast("double").alias("prediction"))


def classified(name, price=False):
    return lambda spark, d: predictions(train.fit(sizes(spark, d, price).drop("steps"), "above", ["p_partkey"], name))


def regressed(name, price=False, step=1e-4):
    """Predictions to the nearest multiple of ``step``."""

    def run(spark, d):
        found = predictions(train.fit(sizes(spark, d, price).drop("above"), "steps", ["p_partkey"], name, problem="regression"))
        return found.withColumn("prediction", F.round(F.round(F.col("prediction") / step) * step, 4) + 0.0)

    return run


for key, name, price in [
    ("h06_logistic", "logistic", False),
    ("h11_svc_rbf", "svc", False),
    ("h13_knn_model_classes", "knn", False),
    ("h15_decision_tree", "decision_tree", True),
    ("h16_random_forest", "random_forest", True),
    ("h17_gradient_boosting", "gradient_boosting", False),
    ("h18_xgboost_classes", "xgboost", False),
    ("h18_lightgbm_classes", "lightgbm", False),
    ("h18_catboost_classes", "catboost", False),
]:
    query(key, DECIDED)(classified(name, price))
for key, name, price, step in [
    ("h12_svr_rbf", "svr", False, 10),
    ("h13_knn_model", "knn", False, 1e-4),
    ("h15_decision_tree_regression", "decision_tree", True, 1e-4),
    ("h16_random_forest_regression", "random_forest", True, 1e-4),
    ("h17_gradient_boosting_regression", "gradient_boosting", False, 1e-4),
]:
    query(key, STEPPED)(regressed(name, price, step))


# A feature of four values parts the rows at once, so each round moves every value's prediction by the same share of its distance to the
# mean: rate x rows / (rows + ridge). After 100 rounds (1 - share)^100 of the distance is left.
FOUR = "p_size % 4 AS f, CASE p_size % 4 WHEN 0 THEN 10.0 WHEN 1 THEN -30.0 WHEN 2 THEN 50.0 ELSE 0.0 END AS y"


def boosted_sql(ridge: float) -> str:
    return (
        f"WITH t AS (SELECT p_partkey, {FOUR}, NOT ({TEST}) AS used FROM part), m AS (SELECT avg(y) AS base FROM t WHERE used), "
        "g AS (SELECT f, count(*) AS n FROM t WHERE used GROUP BY f) SELECT p_partkey AS row_key, y::DOUBLE AS label, "
        f"round(y - (y - base) * pow(1 - 0.1 * n / (n + {ridge}), 100), 4)::DOUBLE AS prediction FROM t JOIN g USING (f), m WHERE NOT used"
    )


def boosted(name: str):
    def run(spark, d):
        t = read_table(spark, d, "part").selectExpr("p_partkey", *[f"CAST({c} AS {k}) AS {n}" for c, k, n in FOUR_COLUMNS])
        found = predictions(train.fit(t, "y", ["p_partkey"], name, problem="regression"))
        return found.withColumn("prediction", F.round("prediction", 4) + 0.0)

    return run


FOUR_COLUMNS = [(part.rsplit(" AS ", 1)[0], kind, part.rsplit(" AS ", 1)[1]) for part, kind in zip(FOUR.split(", "), ["int", "double"], strict=True)]
for key, name, ridge in [("h18_xgboost_preset", "xgboost", 1.0), ("h18_lightgbm_preset", "lightgbm", 0.0), ("h18_catboost_preset", "catboost", 3.0)]:
    query(key, boosted_sql(ridge))(boosted(name))


DUMMIES = ["o_orderstatus = 'O'", "o_orderstatus = 'P'"] + [f"o_orderpriority = '{p}'" for p in ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]


@query(
    "h04_prepare_quick",
    "SELECT o_orderkey, (o_totalprice + o_custkey * 20 > 260000)::INT::DOUBLE AS label, o_custkey::DOUBLE AS x0, o_totalprice AS x1, "
    + ", ".join(f"({c})::INT::DOUBLE AS x{i}" for i, c in enumerate(DUMMIES, 2))
    + " FROM orders WHERE concat('0x', substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT % 100 >= 20",
)
def _(spark, d):
    target = (F.col("o_totalprice") + F.col("o_custkey") * 20 > 260000).cast("int").alias("target")
    t = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", target)
    ready = train.prepare_rows(t, "target", ["o_orderkey"], rules="quick")
    x = ready.train.select("o_orderkey", "label", vector_to_array("features").alias("x"))
    return x.select("o_orderkey", "label", *[F.get("x", F.lit(i)).alias(f"x{i}") for i in range(2 + len(DUMMIES))])


# ---------------------------------------------------------------- cross-validation and search in closed form

FOLDED = (
    f"WITH t AS ({LINE}), f AS (SELECT *, concat('0x', substr(md5(concat('folds|', k)), 1, 8))::BIGINT % 5 AS fold FROM t WHERE {TRAIN}), "
    "m AS (SELECT avg(x) AS m, stddev_pop(x) AS s FROM f), e AS (SELECT fold, (x - m) / s AS z, y FROM f, m), "
    "g AS (SELECT r.range AS fold, avg(z) AS mz, avg(y) AS my, covar_pop(z, y) AS c, var_pop(z) AS v, count(*)::DOUBLE AS n FROM range(5) r, e WHERE e.fold <> r.range GROUP BY 1), "
)
SCORED = (
    "p AS (SELECT name, e.fold, 1 - avg(pow(y - my - w * (z - mz), 2)) / var_pop(y) AS r2 FROM e JOIN w USING (fold) GROUP BY ALL), "
    "cv AS (SELECT name, avg(r2) AS cv_score, stddev_pop(r2) AS cv_std FROM p GROUP BY name) "
)


@query(
    "h19_cross_validation",
    FOLDED
    + "w AS (SELECT fold, mz, my, unnest(['linear', 'ridge', 'lasso', 'elasticnet']) AS name, unnest([c / v, c / (v + 1 / n), "
    "sign(c) * greatest(abs(c) - 1, 0) / v, sign(c) * greatest(abs(c) - 0.5, 0) / (v + 0.5)]) AS w FROM g), "
    + SCORED
    + "SELECT name, round(cv_score, 5) AS cv_score, round(cv_std, 5) AS cv_std FROM cv",
)
def _(spark, d):
    run = train.train_all(line(spark, d), "y", ["k"], ["linear", "ridge", "lasso", "elasticnet"])
    return rounded(run.table(spark).select("name", "cv_score", "cv_std"), 5, "cv_score", "cv_std")


TRIED = train.search_settings("elasticnet")


@query(
    "h20_random_search",
    FOLDED
    + "s AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{s['alpha']}/{s['l1_ratio']}', {s['alpha']}::DOUBLE, {s['l1_ratio']}::DOUBLE)" for s in TRIED)
    + ") v(name, alpha, l1)), w AS (SELECT fold, mz, my, name, sign(c) * greatest(abs(c) - alpha * l1, 0) / (v + alpha * (1 - l1)) AS w FROM g, s), "
    + SCORED
    + "SELECT alpha, l1 AS l1_ratio, round(cv_score, 5) AS cv_score, round(cv_std, 5) AS cv_std FROM cv JOIN s USING (name) ORDER BY cv.cv_score DESC LIMIT 1",
)
def _(spark, d):
    from lodestat.ml.prepare import with_folds

    ready = train.prepare_rows(line(spark, d), "y", ["k"], problem="regression")
    folded = with_folds(ready.train, 5, ["row_key"], seed="folds").persist()
    try:
        best, mean, std = train.tune("elasticnet", folded, "regression")
    finally:
        folded.unpersist()
    row = [(float(best["alpha"]), float(best["l1_ratio"]), mean, std)]
    return rounded(spark.createDataFrame(row, "alpha double, l1_ratio double, cv_score double, cv_std double"), 5, "cv_score", "cv_std")


@query(
    "h21_train_all_and_rank",
    "SELECT unnest(["
    + ", ".join(f"'{n}'" for n in train.CLASSIFIERS)
    + f"]) AS name, round(avg((label = prediction)::INT), 6) AS test_score, round(avg((label = prediction)::INT), 6) AS cv_score FROM ({DECIDED})",
)
def _(spark, d):
    run = train.train_all(sizes(spark, d).drop("steps"), "above", ["p_partkey"])
    return rounded(run.table(spark).select("name", "test_score", "cv_score"), 6, "test_score", "cv_score")


# ---------------------------------------------------------------- sampled explanations

# on a linear model the sampled attribution is slope * (z - mean z of the 50 background rows)
PHI = (
    MOMENTS
    + f", d AS (SELECT avg((x - m) / s) AS dz FROM (SELECT x FROM t WHERE {TRAIN} ORDER BY md5(concat('42|', k)), k LIMIT 50), z), "
    f"r AS (SELECT k AS row_key, (x - m) / s AS value, c / v * ((x - m) / s - dz) AS phi FROM (SELECT * FROM t WHERE {TRAIN} ORDER BY md5(concat('rows|', k)), k LIMIT 100), z, d) "
)


def explained(spark, d):
    model, ready = train.fit(line(spark, d), "y", ["k"], "linear", problem="regression")
    rows = explain.background(ready.train, 100, ["row_key"], seed="rows")
    sample = explain.background(ready.train, 50, ["row_key"])
    return explain.sampled_shap(rows, sample, lambda t: model.predict(t).withColumn("output", F.col("prediction")), model.feature_names, ["row_key"])


@query("i01_sampled_importance", PHI + "SELECT 'x' AS feature, round(avg(abs(phi)), 4) AS importance FROM r")
def _(spark, d):
    return rounded(explain.shap_importance(explained(spark, d)), 4, "importance")


@query(
    "i02_sampled_explanation",
    PHI + "SELECT row_key, 'x' AS feature, round(value, 5) AS value, round(phi, 4) AS phi, CASE WHEN phi > 0 THEN 'positive' ELSE 'negative' END AS contribution FROM r",
)
def _(spark, d):
    found = explain.explain_rows(explained(spark, d), ["row_key"]).select("row_key", "feature", "value", "phi", "contribution")
    return rounded(rounded(found, 5, "value"), 4, "phi")


STUMP = "p_partkey, p_size % 8 AS f, p_retailprice, CASE WHEN p_size % 8 < 4 THEN 'a' WHEN p_partkey % 3 = 0 THEN 'c' ELSE 'b' END AS y"


@query(
    "i04_multiclass_explanation",
    # a tree of one split on f: the class predicted in a leaf is explained by f alone, by its share there less its share in all training rows
    f"WITH t AS (SELECT {STUMP}, NOT ({TEST}) AS used FROM part), s AS (SELECT y, f < 4 AS low, count(*) AS n FROM t WHERE used GROUP BY ALL), "
    "w AS (SELECT y, low, n / sum(n) OVER (PARTITION BY low) AS share, sum(n) OVER (PARTITION BY y) / sum(n) OVER () AS base FROM s), "
    "c AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY low ORDER BY share DESC) = 1) "
    "SELECT p_partkey AS row_key, c.y AS predicted_class, unnest(['f', 'p_retailprice']) AS feature, unnest([round(share - base, 6), 0.0])::DOUBLE AS phi, "
    "round(base, 6)::DOUBLE AS base_value FROM t JOIN c ON (t.f < 4) = c.low WHERE NOT used",
)
def _(spark, d):
    t = read_table(spark, d, "part").selectExpr("p_partkey", "p_size % 8 AS f", "p_retailprice", STUMP.split(", ", 3)[3])
    model, ready = train.fit(t, "y", ["p_partkey"], "decision_tree", max_depth=1)
    found = shap.tree_shap(ready.test, model.model, model.feature_names, ["row_key"], "largest")
    name = F.get(F.array(*[F.lit(c) for c in model.classes]), F.col("output")).alias("predicted_class")
    return rounded(found.select("row_key", name, "feature", "phi", "base_value"), 6, "phi", "base_value")


@query(
    "i02_tree_explanation",
    # one feature: it explains all that parts a prediction from the mean prediction of the training rows
    boosted_sql(1.0).replace(" FROM t JOIN g USING (f), m WHERE NOT used", ", f, used FROM t JOIN g USING (f), m").replace("round(y - (y - base)", "(y - (y - base)").replace("100), 4)", "100))").replace("WITH t", "WITH p AS (WITH t")
    + "), b AS (SELECT avg(prediction) AS base FROM p WHERE used) SELECT row_key, 'f' AS feature, round(prediction - base, 4)::DOUBLE AS phi, round(base, 4)::DOUBLE AS base_value FROM p, b WHERE NOT used",
)
def _(spark, d):
    t = read_table(spark, d, "part").selectExpr("p_partkey", *[f"CAST({c} AS {k}) AS {n}" for c, k, n in FOUR_COLUMNS])
    model, ready = train.fit(t, "y", ["p_partkey"], "xgboost", problem="regression")
    found = explain.attributions(model, ready.test, ready.train, ["row_key"]).select("row_key", "feature", "phi", "base_value")
    return rounded(found, 4, "phi", "base_value")


@query(
    "i05_importance_fallback",
    # the forest splits on f alone: f explains all of the target's variance
    "WITH t AS (SELECT p_size % 8 AS f, p_size % 8 * 10 AS y FROM part), g AS (SELECT f, var_pop(y) AS v, count(*) AS n FROM t GROUP BY f), "
    "w AS (SELECT sum(v * n) / sum(n) AS inside FROM g), a AS (SELECT var_pop(y) AS v FROM t) "
    "SELECT unnest(['f', 'p_retailprice']) AS feature, unnest([round(1 - inside / v, 6), round(inside / v, 6)]) AS importance, true AS fallback FROM w, a",
)
def _(spark, d):
    t = sizes(spark, d, price=True).drop("above")
    found, ready = train.fit(t, "steps", ["p_partkey"], "random_forest", problem="regression")

    def attributions():
        # attributions by coefficients: a forest has none
        return explain.linear_shap(t, dict(zip(found.feature_names, found.model.coefficients)), ["p_partkey"])

    return rounded(explain.importance_or_fallback(spark, found, attributions).drop("error"), 6, "importance")


MEASURED = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "qty_n", "tax_n", "disc_n", "const_c"]
FENCED = "SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM t"


@query(
    "d08_merge_all_reports",
    f"WITH t AS ({as_sql('lineitem', LINEITEM)}), r AS (SELECT 'missing' AS kind, 'qty_n' AS \"column\", 'impute' AS strategy FROM t HAVING count(*) > count(qty_n) "
    "UNION ALL SELECT 'missing', 'tax_n', 'drop_rows' FROM t HAVING count(*) > count(tax_n) UNION ALL SELECT 'missing', 'disc_n', 'drop_column' FROM t HAVING count(*) > 2 * count(disc_n) "
    "UNION ALL SELECT 'missing', 'flag_n', 'impute' FROM t HAVING count(*) > count(flag_n) UNION ALL SELECT 'encoding', 'l_returnflag', 'one_hot' FROM t HAVING count(DISTINCT l_returnflag) < 10 "
    "UNION ALL SELECT 'encoding', 'l_linestatus', 'one_hot' FROM t HAVING count(DISTINCT l_linestatus) < 10 "
    + "".join(
        f"UNION ALL SELECT 'outlier', '{c}', 'clip' FROM t, ({FENCED.format(c=c)}) HAVING count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) > 0 "
        for c in MEASURED
    )
    + ") SELECT kind, \"column\", CASE WHEN \"column\" = 'qty_n' THEN 'median' ELSE strategy END AS strategy FROM r",
)
def _(spark, d):
    report = quality.quality_report(derived(spark, d, "lineitem", LINEITEM))
    given = spark.createDataFrame([("qty_n", "median", "skewed")], "column string, strategy string, reasoning string")
    return quality.merge_recommendations(report, given).select("kind", "column", "strategy")
