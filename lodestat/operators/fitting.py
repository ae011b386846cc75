"""Statistics that cleaning and feature steps are fitted with.

A step asks for statistics by key, e.g. ``("mean", "price")``. All requests of several steps are
answered together: one aggregate pass for moments and bounds, one quantile call for all ranks.
The answers are scalars (or short class lists) that become literals in the plan, so a fitted step
is a narrow projection that adds no join and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.functions.columns import named, number, present
from lodestat.operators.ordered import running
from lodestat.operators.quantiles import exact_quantiles
from lodestat.operators.stats import modes

SIMPLE = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}
BROADCAST_CLASSES = 50_000
BROADCAST_BYTES = 64 << 20
HOT_SHARE = 200


def fit_statistics(df: DataFrame, keys: list[tuple]) -> dict[tuple, object]:
    keys = list(dict.fromkeys(keys))
    found: dict[tuple, object] = {}
    simple = [k for k in keys if k[0] in SIMPLE]
    if simple:
        row = df.agg(*[SIMPLE[k[0]](number(df, k[1])).alias(f"s{i}") for i, k in enumerate(simple)]).first()
        found.update({k: row[f"s{i}"] for i, k in enumerate(simple)})
    ranks = [k for k in keys if k[0] == "quantile"]
    if ranks:
        cols = list(dict.fromkeys(k[1] for k in ranks))
        probs = sorted({k[2] for k in ranks})
        answers = exact_quantiles(df, cols, probs)
        found.update({k: answers[k[1]][probs.index(k[2])] for k in ranks})
    for k in keys:
        if k[0] == "mode":
            found[k] = modes(df, [k[1]])[k[1]]
        elif k[0] == "classes":
            # one column of the result each; with a limit, limit + 1 at most reach the driver and the caller rejects a longer list
            values = df.select(present(df, k[1]).alias("v")).where("v IS NOT NULL").distinct().orderBy("v")
            found[k] = [r["v"] for r in (values if k[2] is None else values.limit(k[2] + 1)).collect()]
        elif k[0] == "codes":
            found[k] = fit_codes(df, k[1])
    return found


def code_text(df: DataFrame, column: str) -> Column:
    """The class text of a value; a missing value is the class 'nan'."""
    return F.coalesce(present(df, column).cast("string"), F.lit("nan"))


def fit_codes(df: DataFrame, column: str, broadcast_classes: int = BROADCAST_CLASSES) -> dict:
    """Codes of the sorted class texts: a short list, or a ranked table when there are too many.

    The list is fetched only after its length and its bytes have been measured.
    """
    counts = df.select(code_text(df, column).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    size = counts.agg(F.count("*").alias("classes"), F.sum(F.octet_length("value")).alias("bytes"), F.sum("n").alias("rows")).first()
    if size["classes"] <= broadcast_classes and (size["bytes"] or 0) <= BROADCAST_BYTES:
        return {"classes": [r["value"] for r in counts.select("value").orderBy("value").collect()], "size": size["classes"]}
    total = size["rows"]
    # a value holding over 1 / HOT_SHARE of the rows is hot: there are fewer than HOT_SHARE of them
    table = running(counts, [], [F.col("value")], row_number="code", group_rows=size["classes"]).withColumn("code", F.col("code") - 1)
    hot = table.where(F.col("n") * HOT_SHARE > total).select("value", "code").collect()
    return {"table": table.select("value", "code"), "hot": [(r["value"], r["code"]) for r in hot], "size": size["classes"]}


def attach_codes(df: DataFrame, column: str, fitted: dict, output: str) -> DataFrame:
    """Replace or add ``output`` with the code of ``column``; a class not seen at fit time gets NULL."""
    spark = df.sparkSession
    schema = "value string, code bigint"
    keyed = df.withColumn("_value", code_text(df, column))
    others = [c for c in df.columns if c != output]
    order = df.columns if output in df.columns else [*df.columns, output]

    def join(rows: DataFrame, codes: DataFrame) -> DataFrame:
        joined = rows.join(codes, F.col("_value") == F.col("value"), "left")
        result = joined.select(*[named(c) for c in others], F.col("code").alias(output))
        return result.select(*[named(c) for c in order])

    if "classes" in fitted:
        classes = spark.createDataFrame([(v, i) for i, v in enumerate(fitted["classes"])], schema)
        return join(keyed, F.broadcast(classes))
    # too many classes to broadcast: hot values take a bounded broadcast, so that only the others are shuffled
    hot = [v for v, _ in fitted["hot"]]
    if not hot:
        return join(keyed, fitted["table"])
    is_hot = F.col("_value").isin(hot)
    return join(keyed.where(is_hot), F.broadcast(spark.createDataFrame(fitted["hot"], schema))).unionByName(
        join(keyed.where(~is_hot), fitted["table"])
    )
