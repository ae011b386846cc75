"""Evaluation of predictions. Inputs need ``label`` and ``prediction`` (or ``score``) columns.

Everything starts from a grouped count, so each task reduces its rows to one per (label,
prediction) or per score before anything is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.functions.columns import ratio
from lodestat.operators.ordered import MAX_GROUP_ROWS, running
from lodestat.session import checkpointed


def accuracy(df: DataFrame) -> DataFrame:
    return df.agg(F.avg((F.col("label") == F.col("prediction")).cast("int")).alias("accuracy"))


def confusion_cells(df: DataFrame) -> DataFrame:
    """label, prediction, count."""
    return df.groupBy("label", "prediction").agg(F.count("*").alias("count"))


def confusion_matrix(df: DataFrame, classes: list) -> DataFrame:
    """One row per class: ``Actual`` and one count column per predicted class, zeros included."""
    counts = confusion_cells(df).groupBy(F.col("label").cast("string").alias("Actual"))
    wide = counts.pivot("prediction", classes).agg(F.sum("count"))
    names = df.sparkSession.createDataFrame([(str(c),) for c in classes], "Actual string")
    result = names.join(wide, "Actual", "left")
    return result.select("Actual", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("bigint").alias(str(c)) for c in classes])


def class_metrics(df: DataFrame) -> DataFrame:
    """Per class: true positives, support, predicted, precision, recall, F1; 0 where undefined.

    The confusion cells are turned into per-class parts and summed in one more grouped count,
    with no join.
    """
    hit = F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    parts = F.array(
        F.struct(F.col("label").alias("class"), hit.cast("bigint").alias("tp"), F.col("count").alias("support"), zero.alias("predicted")),
        F.struct(F.col("prediction").alias("class"), zero.alias("tp"), zero.alias("support"), F.col("count").alias("predicted")),
    )
    sums = confusion_cells(df).select(F.inline(parts)).groupBy("class")
    sums = sums.agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    zero_ratio = lambda a, b: F.coalesce(ratio(F.col(a), F.col(b)), F.lit(0.0))
    p, r = F.col("precision"), F.col("recall")
    sums = sums.withColumn("precision", zero_ratio("tp", "predicted")).withColumn("recall", zero_ratio("tp", "support"))
    return sums.withColumn("f1", F.coalesce(ratio(2 * p * r, p + r), F.lit(0.0)))


def prf(df: DataFrame, average: str = "auto", positive=1) -> DataFrame:
    """precision, recall, f1: of the positive class if the labels have two classes, else weighted by support.

    ``average`` forces ``binary`` or ``weighted``.
    """
    per_class = class_metrics(df)
    weighted = [ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")) for m in ("precision", "recall", "f1")]
    wanted = F.lit(str(positive)).try_cast(per_class.schema["class"].dataType)
    binary = [F.coalesce(F.max(F.when(F.col("class") == wanted, F.col(m))), F.lit(0.0)) for m in ("precision", "recall", "f1")]
    two = F.count_if(F.col("support") > 0) == 2
    chosen = {
        "binary": binary,
        "weighted": weighted,
        "auto": [F.when(two, b).otherwise(w) for b, w in zip(binary, weighted)],
    }[average]
    return per_class.agg(*[c.alias(m) for c, m in zip(chosen, ("precision", "recall", "f1"))])


@dataclass(frozen=True)
class _Totals:
    positives: int
    negatives: int
    scores: int


def _by_score(df: DataFrame) -> DataFrame:
    positive = F.col("label") == 1
    return df.groupBy("score").agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))


def _totals(groups: DataFrame) -> _Totals:
    row = groups.agg(F.sum("pos"), F.sum("neg"), F.count("*")).first()
    return _Totals(row[0] or 0, row[1] or 0, row[2])


def _corners(groups: DataFrame, totals: _Totals, max_group_rows: int) -> DataFrame:
    """Numbered corners of the curve; a point on the straight line between its neighbours is left out."""
    curve = running(
        groups,
        [],
        [F.col("score").desc()],
        sums={"tp": "pos", "fp": "neg"},
        row_number="at",
        leads={"next_pos": "pos", "next_neg": "neg"},
        max_group_rows=max_group_rows,
        group_rows=totals.scores,
    )
    final = F.col("next_pos").isNull()
    corner = (F.col("at") == 1) | final | (F.col("pos") != F.col("next_pos")) | (F.col("neg") != F.col("next_neg"))
    corners = curve.where(corner).select("at", "tp", "fp", final.alias("final"))
    # there are at most as many corners as scores
    return running(corners, [], [F.col("at")], row_number="point", max_group_rows=max_group_rows, group_rows=totals.scores)


def roc_curve(df: DataFrame, step: int = 5, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """fpr, tpr of the origin and every step-th corner; (1, 1) is added unless a kept point has fpr 1.

    The thinned corners are written out once, so that the check for the end point does not build
    the curve a second time.
    """
    groups = _by_score(df)
    totals = _totals(groups)
    kept = F.col("point") % step == 0
    thinned = checkpointed(_corners(groups, totals, max_group_rows).where(kept | F.col("final")).select("point", "tp", "fp", "final"))
    reached = thinned.where(kept & (F.col("fp") == totals.negatives)).limit(1).count() > 0
    points = thinned.where(kept if reached else (kept | F.col("final"))).select("tp", "fp")
    origin = df.sparkSession.createDataFrame([(0, 0)], "tp bigint, fp bigint")
    return origin.unionByName(points).select(
        ratio(F.col("fp"), F.lit(totals.negatives)).alias("fpr"), ratio(F.col("tp"), F.lit(totals.positives)).alias("tpr")
    )


def auc(df: DataFrame, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Area under the ROC curve by the trapezoid rule; NULL with a single class."""
    groups = _by_score(df)
    totals = _totals(groups)
    order = [F.col("score").desc()]
    curve = running(groups, [], order, sums={"tp": "pos"}, max_group_rows=max_group_rows, group_rows=totals.scores)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return curve.agg(ratio(area, F.lit(float(totals.positives)) * float(totals.negatives)).alias("auc"))


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """r2, mse, rmse, mae in one pass: the variance of the label replaces a second pass around its mean."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    both = y.isNotNull() & p.isNotNull()
    error = F.when(both, y - p)
    row = df.agg(F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), F.var_pop(F.when(both, y)).alias("var"))
    return row.select((1 - ratio(F.col("mse"), F.col("var"))).alias("r2"), "mse", F.sqrt("mse").alias("rmse"), "mae")
