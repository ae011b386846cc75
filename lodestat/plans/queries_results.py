"""Queries: evaluation, ranking, text commands, splits, folds and exact attributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestat.ml import explain, prepare
from lodestat.ml import suggest as advice
from lodestat.ml.suggest import suggest
from lodestat.operators import charts, evaluate, ranking, text
from lodestat.plans.inputs import COMMANDS, MULTICLASS, PREDICTIONS, REGRESSION, RESULTS, as_sql, derived, results
from lodestat.plans.registry import longs, query, rounded
from lodestat.sources.readers import read_table

P = f"WITH t AS ({as_sql('lineitem', PREDICTIONS, '')})"
M = f"WITH t AS ({as_sql('lineitem', MULTICLASS, '')})"
R = f"WITH t AS ({as_sql('lineitem', REGRESSION, '')})"
RES = f"WITH t AS ({RESULTS})"
C = f"WITH t AS ({as_sql('conversations', COMMANDS, 'conv_id, turn')})"


def predictions(spark, d, exprs=PREDICTIONS):
    return read_table(spark, d, "lineitem").selectExpr(*exprs)


def commands(spark, d):
    return derived(spark, d, "conversations", COMMANDS, "conv_id, turn")


# ---------------------------------------------------------------- evaluation


@query("h30_accuracy", f"{P} SELECT round(avg(CASE WHEN label = prediction THEN 1.0E0 ELSE 0 END), 9) AS accuracy FROM t")
def _(spark, d):
    return rounded(evaluate.accuracy(predictions(spark, d)), 9, "accuracy")


@query(
    "h31_precision_recall_f1_binary",
    f"{P}, s AS (SELECT count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 1) AS pos, count(*) FILTER (prediction = 1) AS pred FROM t) "
    'SELECT round(tp / pred, 9) AS "precision", round(tp / pos, 9) AS "recall", round(2.0E0 * tp / (pos + pred), 9) AS f1 FROM s',
)
def _(spark, d):
    return rounded(evaluate.prf(predictions(spark, d)), 9, "precision", "recall", "f1")


WEIGHTED = (
    ", c AS (SELECT DISTINCT label AS k FROM t), s AS (SELECT k, count(*) FILTER (label = k AND prediction = k) AS tp, "
    "count(*) FILTER (label = k) AS pos, count(*) FILTER (prediction = k) AS pred FROM c, t GROUP BY k) "
    'SELECT round(sum(pos * coalesce(tp / nullif(pred, 0), 0)) / sum(pos), 9) AS "precision", round(sum(tp) / sum(pos), 9) AS "recall", '
    "round(sum(pos * 2.0E0 * tp / (pos + pred)) / sum(pos), 9) AS f1 FROM s"
)


@query("h31_precision_recall_f1_weighted", M + WEIGHTED)
def _(spark, d):
    return rounded(evaluate.prf(predictions(spark, d, MULTICLASS)), 9, "precision", "recall", "f1")


@query("h31_precision_recall_f1_quick", P + WEIGHTED)
def _(spark, d):
    return rounded(evaluate.prf(predictions(spark, d), "weighted"), 9, "precision", "recall", "f1")


@query(
    "h32_confusion_matrix",
    f"{M}, c AS (SELECT DISTINCT label AS k FROM t) SELECT k AS \"Actual\", "
    + ", ".join(f"count(*) FILTER (label = k AND prediction = '{v}') AS \"{v}\"" for v in "ANR")
    + " FROM c, t GROUP BY k",
)
def _(spark, d):
    return evaluate.confusion_matrix(predictions(spark, d, MULTICLASS), ["A", "N", "R"])


ROC = (
    f"{P}, g AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM t GROUP BY score), "
    "w AS (SELECT *, sum(p) OVER o AS tp, sum(n) OVER o AS fp, lead(p) OVER o AS np, lead(n) OVER o AS nn, row_number() OVER o AS rn, "
    "sum(p) OVER () AS tot_p, sum(n) OVER () AS tot_n FROM g WINDOW o AS (ORDER BY score DESC)), "
    "k AS (SELECT row_number() OVER (ORDER BY rn) AS i, tp, fp, tot_p, tot_n FROM w WHERE rn = 1 OR np IS NULL OR p <> np OR n <> nn "
    "UNION ALL SELECT 0, 0, 0, max(tot_p), max(tot_n) FROM w), l AS (SELECT max(i) AS last FROM k), "
)


def roc_sql(step):
    return (
        ROC
        + f"r AS (SELECT max(fp) FILTER (i % {step} = 0) AS reach FROM k) SELECT round(fp / tot_n, 9) AS fpr, round(tp / tot_p, 9) AS tpr "
        f"FROM k, l, r WHERE i % {step} = 0 OR (i = last AND reach < tot_n)"
    )


@query("h33_roc_curve", roc_sql(5))
def _(spark, d):
    return rounded(evaluate.roc_curve(predictions(spark, d), 5), 9, "fpr", "tpr")


@query("h33_roc_curve_quick", roc_sql(10))
def _(spark, d):
    # a low limit on group size: the curve is built from sorted pieces
    return rounded(evaluate.roc_curve(predictions(spark, d), 10, max_group_rows=5000), 9, "fpr", "tpr")


@query(
    "h34_auc",
    f"{P}, g AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM t GROUP BY score), "
    "w AS (SELECT p, n, sum(p) OVER (ORDER BY score DESC) AS tp FROM g) "
    "SELECT round(sum(n * (tp - p / 2)) / (sum(p) * sum(n)), 9) AS auc FROM w",
)
def _(spark, d):
    return rounded(evaluate.auc(predictions(spark, d)), 9, "auc")


@query(
    "h35_regression_metrics",
    f"{R} SELECT round(1 - sum((label - prediction) * (label - prediction)) / sum((label - m) * (label - m)), 8) AS r2, "
    "round(avg((label - prediction) * (label - prediction)), 1) AS mse, round(sqrt(avg((label - prediction) * (label - prediction))), 5) AS rmse, "
    "round(avg(abs(label - prediction)), 7) AS mae FROM t, (SELECT avg(label) AS m FROM t)",
)
def _(spark, d):
    out = evaluate.regression_metrics(predictions(spark, d, REGRESSION))
    return rounded(rounded(rounded(rounded(out, 8, "r2"), 1, "mse"), 5, "rmse"), 7, "mae")


@query(
    "g08_normalize_confusion",
    f"{M}, c AS (SELECT label, prediction, count(*) AS \"count\" FROM t GROUP BY ALL) "
    'SELECT label, prediction, "count", round("count" / max("count") OVER (), 9) AS share FROM c',
)
def _(spark, d):
    return rounded(charts.normalize_confusion(evaluate.confusion_cells(predictions(spark, d, MULTICLASS))), 9, "share")


# ---------------------------------------------------------------- results tables


@query(
    "g02_leaderboard",
    f"{RES} SELECT target, model_name, test_score, row_number() OVER (PARTITION BY target ORDER BY test_score DESC, model_name) AS rank FROM t",
)
def _(spark, d):
    return ranking.leaderboard(results(spark, d), ["target"]).select("target", "model_name", "test_score", "rank")


@query(
    "g03_sort_models",
    f'{RES} SELECT target, model_name, "precision" FROM t',
)
def _(spark, d):
    return ranking.sort_models(results(spark, d).select("target", "model_name", "precision"), "precision")


@query(
    "g04_top_features",
    "WITH i AS (SELECT c.* FROM (SELECT abs(corr(l_quantity, l_extendedprice)) AS a, abs(corr(l_discount, l_extendedprice)) AS b, "
    "abs(corr(l_tax, l_extendedprice)) AS c, abs(corr(l_linenumber, l_extendedprice)) AS d FROM lineitem) s, "
    "LATERAL (VALUES ('l_quantity', a), ('l_discount', b), ('l_tax', c), ('l_linenumber', d)) c(feature, importance)) "
    "SELECT feature, round(importance, 9) AS importance, round(importance / max(importance) OVER (), 6) AS relative FROM i ORDER BY importance DESC LIMIT 10",
)
def _(spark, d):
    from lodestat.operators.stats import corr_matrix

    cols = ["l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_linenumber"]
    pairs = corr_matrix(read_table(spark, d, "lineitem"), cols).where("i = 0 AND j > 0")
    top = charts.top_features(pairs.select(F.col("col2").alias("feature"), F.abs("r").alias("importance")))
    return rounded(rounded(top, 9, "importance"), 6, "relative")


@query("g07_overfit_gap", f"{RES} SELECT model_name, cv_score, test_score, round(cv_score - test_score, 9) + 0.0 AS gap FROM t")
def _(spark, d):
    return rounded(ranking.overfit_gap(results(spark, d)), 9, "gap")


ADVICE = [
    ("problem_type = 'classification' AND test_score < 0.7", advice.LOW_ACCURACY),
    ("problem_type = 'classification' AND \"precision\" < 0.6", advice.LOW_PRECISION),
    ("problem_type = 'classification' AND \"recall\" < 0.6", advice.LOW_RECALL),
]
IMBALANCED = ("problem_type = 'classification' AND rarest_share < 0.1", advice.IMBALANCE)
LOW_R2 = ("problem_type = 'regression' AND test_score < 0.5", advice.LOW_R2)
FAR = ("problem_type = 'regression' AND has_outliers", advice.OUTLIERS)
TRAINER, QUICK = ([("true", text) for text in advice.GENERAL[k]] for k in ("trainer", "quick"))


def suggest_sql(rules):
    parts = " UNION ALL ".join(f"SELECT target, model_name, {i} AS k, '{t}' AS suggestion FROM t WHERE {c}" for i, (c, t) in enumerate(rules))
    return (
        f"{RES}, s AS ({parts}) SELECT target, model_name, suggestion, "
        "row_number() OVER (PARTITION BY target, model_name ORDER BY k) AS position FROM s"
    )


@query("h22_suggestions", suggest_sql([*ADVICE, LOW_R2, *TRAINER]))
def _(spark, d):
    return longs(suggest(results(spark, d), ["target", "model_name"]), "position")


@query("h22_suggestions_quick", suggest_sql([*ADVICE, IMBALANCED, LOW_R2, FAR, *QUICK]))
def _(spark, d):
    return longs(suggest(results(spark, d), ["target", "model_name"], "quick"), "position")


# ---------------------------------------------------------------- preparation


@query(
    "h01_problem_type",
    "SELECT 'l_returnflag' AS target, 'classification' AS trainer, 'classification' AS quick, count(*) AS n FROM lineitem UNION ALL "
    "SELECT 'l_linenumber', CASE WHEN count(DISTINCT l_linenumber) < 10 THEN 'classification' ELSE 'regression' END, "
    "CASE WHEN count(DISTINCT l_linenumber) < 20 THEN 'classification' ELSE 'regression' END, count(*) FROM lineitem UNION ALL "
    "SELECT 'l_tax', CASE WHEN count(DISTINCT l_tax) < 10 THEN 'classification' ELSE 'regression' END, 'regression', count(*) FROM lineitem UNION ALL "
    "SELECT 'l_discount', CASE WHEN count(DISTINCT l_discount) < 10 THEN 'classification' ELSE 'regression' END, 'regression', count(*) FROM lineitem UNION ALL "
    "SELECT 'l_suppkey', CASE WHEN count(DISTINCT l_suppkey) < 10 THEN 'classification' ELSE 'regression' END, "
    "CASE WHEN count(DISTINCT l_suppkey) < 20 THEN 'classification' ELSE 'regression' END, count(*) FROM lineitem",
)
def _(spark, d):
    t = read_table(spark, d, "lineitem")
    n = t.count()
    targets = ["l_returnflag", "l_linenumber", "l_tax", "l_discount", "l_suppkey"]
    rows = [(c, prepare.problem_type(t, c), prepare.problem_type(t, c, "quick"), n) for c in targets]
    return spark.createDataFrame(rows, "target string, trainer string, quick string, n bigint")


@query(
    "h03_prepare_standardized",
    "WITH c AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT o_orderpriority AS v FROM orders)), "
    "e AS (SELECT o_orderkey, o_totalprice AS p, c.code FROM orders JOIN c ON c.v = o_orderpriority) "
    "SELECT o_orderkey, round((p - (SELECT avg(p) FROM e)) / (SELECT stddev_pop(p) FROM e), 6) + 0.0 AS o_totalprice, "
    "round((code - (SELECT avg(code) FROM e)) / (SELECT stddev_pop(code) FROM e), 6) + 0.0 AS o_orderpriority FROM e",
)
def _(spark, d):
    from lodestat.plans.recipe import apply_recipe

    steps = [{"op": "encode", "column": "o_orderpriority", "method": "label"}]
    steps += [{"op": "scale", "column": c, "method": "standard"} for c in ("o_totalprice", "o_orderpriority")]
    t = apply_recipe(read_table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), steps)
    return rounded(t, 6, "o_totalprice", "o_orderpriority")


HASH = "concat('0x', substr(md5(CAST({k} AS VARCHAR)), 1, 8))::BIGINT"


@query(
    "h05_split",
    f"SELECT o_orderkey, CASE WHEN {HASH.format(k='o_orderkey')} % 100 < 20 THEN 'test' ELSE 'train' END AS part FROM orders",
)
def _(spark, d):
    train, test = prepare.split(read_table(spark, d, "orders"), 0.2, ["o_orderkey"])
    parts = [t.select("o_orderkey", F.lit(name).alias("part")) for name, t in (("train", train), ("test", test))]
    return parts[0].unionByName(parts[1])


@query("h19_folds", f"SELECT o_orderkey, {HASH.format(k='o_orderkey')} % 5 AS fold FROM orders")
def _(spark, d):
    return longs(prepare.with_folds(read_table(spark, d, "orders"), 5, ["o_orderkey"]).select("o_orderkey", "fold"), "fold")


@query(
    "h19_folds_stratified",
    "SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1) % 5 AS fold FROM orders",
)
def _(spark, d):
    # a low limit on group size: classes are ranked in sorted pieces
    out = prepare.with_folds(read_table(spark, d, "orders"), 5, ["o_orderkey"], "o_orderstatus", max_group_rows=500)
    return longs(out.select("o_orderkey", "fold"), "fold")


# ---------------------------------------------------------------- exact attributions

WEIGHTS = {"l_quantity": 0.5, "l_discount": -20.0, "l_tax": 12.5}
PHI = (
    "WITH s AS (SELECT avg(l_quantity) AS a, avg(l_discount) AS b, avg(l_tax) AS c FROM lineitem), "
    "p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, f.* FROM lineitem, s, LATERAL (VALUES ('l_quantity', l_quantity, 0.5 * (l_quantity - a)), "
    "('l_discount', l_discount, -20.0 * (l_discount - b)), ('l_tax', l_tax, 12.5 * (l_tax - c))) f(feature, value, phi)) "
)


@query("i01_linear_importance", PHI + "SELECT feature, round(avg(abs(phi)), 6) AS importance FROM p GROUP BY feature")
def _(spark, d):
    phis = explain.linear_shap(read_table(spark, d, "lineitem"), WEIGHTS, ["l_orderkey"])
    return rounded(explain.shap_importance(phis), 6, "importance")


CUSTOMER_PHI = (
    "WITH s AS (SELECT avg(c_acctbal) AS a, avg(c_nationkey) AS b FROM customer), "
    "p AS (SELECT c_custkey, f.* FROM customer, s, LATERAL (VALUES ('c_acctbal', c_acctbal, 0.01 * (c_acctbal - a)), "
    "('c_nationkey', CAST(c_nationkey AS DOUBLE), 3.0 * (c_nationkey - b))) f(feature, value, phi)), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(phi) DESC, feature) AS rank, max(abs(phi)) OVER (PARTITION BY c_custkey) AS m FROM p) "
)


@query(
    "i02_linear_explanation",
    CUSTOMER_PHI
    + "SELECT c_custkey, feature, value, round(phi, 6) + 0.0 AS phi, rank, round(abs(phi) / m, 6) AS relative, "
    "CASE WHEN phi > 0 THEN 'positive' ELSE 'negative' END AS contribution FROM r WHERE rank <= 10",
)
def _(spark, d):
    phis = explain.linear_shap(read_table(spark, d, "customer"), {"c_acctbal": 0.01, "c_nationkey": 3.0}, ["c_custkey"])
    return longs(rounded(explain.explain_rows(phis, ["c_custkey"]), 6, "phi", "relative"), "rank")


@query("i03_background", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(concat('42|', o_orderkey)), o_orderkey LIMIT 50")
def _(spark, d):
    return explain.background(read_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 50, ["o_orderkey"])


# ---------------------------------------------------------------- text


def intent_sql():
    parts, best = [], []
    for intent, words in text.INTENT_KEYWORDS.items():
        hits = " + ".join(f"CAST(contains(lower(cmd), '{w}') AS INT)" for w in words)
        parts.append(f"{hits} AS {intent}")
        best.append(f"CASE WHEN {intent} > 0 THEN least(0.7E0, 0.4E0 + {intent} * 0.1E0) ELSE 0 END")
    top = f"greatest({', '.join(best)})"
    names = " ".join(f"WHEN {b} = confidence THEN '{i}'" for i, b in zip(text.INTENT_KEYWORDS, best))
    return (
        f"{C}, h AS (SELECT *, {', '.join(parts)} FROM t), c AS (SELECT *, CASE WHEN cmd IS NULL OR "
        f"length(regexp_replace(cmd, '^\\s+|\\s+$', '', 'g')) < 2 THEN 0 ELSE {top} END AS confidence FROM h), "
        f"i AS (SELECT conv_id, turn, CASE WHEN confidence = 0 THEN 'UNKNOWN' {names} END AS intent, confidence, confidence < 0.5 AS needs_clarification FROM c) "
    )


@query("j01_classify_intent", intent_sql() + "SELECT conv_id, turn, intent, round(confidence, 6) AS confidence, needs_clarification FROM i")
def _(spark, d):
    return rounded(text.classify_intent(commands(spark, d), "cmd").drop("cmd"), 6, "confidence")


SHORT = ["CASE CAST(turn % 4 AS INT) WHEN 0 THEN NULL WHEN 1 THEN ' x ' WHEN 2 THEN 'fit' ELSE text END AS cmd"]


@query(
    "j02_short_input",
    intent_sql().replace(C, f"WITH t AS ({as_sql('conversations', SHORT, 'conv_id, turn')})")
    + "SELECT conv_id, turn, intent, round(confidence, 6) AS confidence, needs_clarification FROM i",
)
def _(spark, d):
    t = derived(spark, d, "conversations", SHORT, "conv_id, turn")
    return rounded(text.classify_intent(t, "cmd").drop("cmd"), 6, "confidence")


@query(
    "j03_extract_entities",
    f"{C} SELECT conv_id, turn, nullif(regexp_extract(cmd, '[\"'']([^\"'']+)[\"'']', 1), '') AS target_column, CASE "
    + " ".join(f"WHEN contains(lower(cmd), '{m}') THEN '{m}'" for m in text.MODEL_NAMES)
    + " END AS model_type FROM t",
)
def _(spark, d):
    return text.extract_entities(commands(spark, d), "cmd").drop("cmd")


MARKDOWN = [
    "concat('answer ```python', chr(10), 'print(', CAST(conv_id AS VARCHAR(20)), ')', chr(10), '``` then ```python x = ', "
    "CAST(turn AS VARCHAR(20)), ' ``` end') AS md"
]


@query(
    "j04_code_blocks",
    f"WITH t AS ({as_sql('conversations', MARKDOWN, 'conv_id, turn')}) SELECT conv_id, turn, "
    "array_to_string(regexp_extract_all(md, '(?s)```python\\s*(.*?)\\s*```', 1), ' ## ') AS code FROM t",
)
def _(spark, d):
    t = text.extract_code_blocks(derived(spark, d, "conversations", MARKDOWN, "conv_id, turn"), "md")
    return t.select("conv_id", "turn", F.array_join("code_blocks", " ## ").alias("code"))


REPLY = ["CASE WHEN event_id % 10 = 0 THEN 'no json' WHEN event_id % 10 = 1 THEN 'bad {k: }' ELSE concat('Sure: ', props, ' done') END AS reply"]


@query(
    "j05_extract_json",
    f"WITH t AS ({as_sql('events', REPLY, 'event_id')}) SELECT event_id, TRY_CAST(regexp_extract(reply, '\"k\": (\\d+)', 1) AS DOUBLE) AS k FROM t",
)
def _(spark, d):
    t = text.extract_json(derived(spark, d, "events", REPLY, "event_id"), "reply", "k bigint")
    return t.select("event_id", F.col("parsed.k").cast("double").alias("k"))


INTENT_REPLY = [
    "concat('```json', chr(10), '{\"intent\": \"', CASE CAST(conv_id % 3 AS INT) WHEN 0 THEN 'PREDICT' WHEN 1 THEN 'HELP' ELSE 'DANCE' END, "
    "'\", \"entities\": {\"target_column\": ', CASE WHEN conv_id % 2 = 0 THEN '\"price\"' ELSE 'null' END, ', \"model_type\": \"null\"}', "
    "CASE WHEN turn % 3 = 0 THEN ', \"confidence\": 0.9' ELSE '' END, '}', chr(10), '```') AS reply"
]


@query(
    "j05_intent_reply",
    "SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'PREDICT' WHEN 1 THEN 'HELP' ELSE 'UNKNOWN' END AS intent, "
    "CASE WHEN turn % 3 = 0 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS confidence, false AS needs_clarification, CASE WHEN conv_id % 2 = 0 THEN 'price' END AS target_column, "
    "CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END AS entities FROM conversations",
)
def _(spark, d):
    t = text.extract_intent_reply(derived(spark, d, "conversations", INTENT_REPLY, "conv_id, turn"), "reply").drop("reply")
    return t.withColumn("target_column", F.element_at("entities", F.lit("target_column"))).withColumn("entities", F.size("entities"))


@query(
    "j06_intent_report",
    intent_sql()
    + "SELECT intent, count(*) AS messages, round(avg(confidence), 6) AS mean_confidence, round(avg(CAST(needs_clarification AS INT)), 6) AS clarification_share "
    "FROM i GROUP BY intent",
)
def _(spark, d):
    return rounded(text.intent_report(commands(spark, d), "cmd"), 6, "mean_confidence", "clarification_share")


@query(
    "j07_last_turns",
    "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 10",
)
def _(spark, d):
    return text.last_turns(read_table(spark, d, "conversations")).select("conv_id", "turn", "role")
