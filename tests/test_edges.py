"""Edge frames: NULL, NaN, constants, ties, tiny and empty tables, odd names."""

import math

import pytest
from pyspark.sql import functions as F

from lodestat import errors
from lodestat.operators import charts, clean, evaluate, outliers, quality, schema, series, stats, text
from lodestat.plans.profile import column_profile
from lodestat.plans.recipe import Recipe, apply_recipe, fit_recipe
from lodestat.sources import readers


def one(df):
    return df.first().asDict()


def values(df, column):
    return [r[column] for r in df.collect()]


@pytest.fixture(scope="module")
def nan_frame(spark):
    rows = [(1, 1.0, "a"), (2, float("nan"), None), (3, None, "b"), (4, 4.0, "a")]
    return spark.createDataFrame(rows, "k int, x double, s string")


def test_nan_counts_as_missing(nan_frame):
    missing = {r["column"]: r["missing"] for r in stats.missing_counts(nan_frame).collect()}
    assert missing == {"k": 0, "x": 2, "s": 1}
    assert values(clean.fill_na(nan_frame, "x", "mean").orderBy("k"), "x") == [1.0, 2.5, 2.5, 4.0]
    assert clean.drop_na(nan_frame).count() == 2


def test_empty_table(spark):
    empty = spark.createDataFrame([], "x double, s string")
    assert one(stats.describe(empty))["count"] == 0
    assert one(stats.describe(empty))["q50"] is None
    assert one(stats.missing_values(empty))["missing_percentage"] == 0
    assert charts.histogram(empty).count() == 0
    assert stats.duplicate_count(empty) == 0
    assert quality.quality_score(empty).first()["quality_score"] == 100
    assert clean.scale(empty, "x", "standard").count() == 0
    assert outliers.detect_outliers(empty).first()["outlier_count"] == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_small_samples(spark, n):
    row = one(stats.describe(spark.createDataFrame([(float(i * i),) for i in range(n)], "x double")))
    assert (row["std"] is None) == (n < 2)
    assert (row["skew"] is None) == (n < 3)
    assert (row["kurtosis"] is None) == (n < 4)


def test_skew_and_kurtosis_match_pandas(spark):
    import pandas as pd

    data = [1.0, 2.0, 2.5, 7.0, 11.0, 11.5, 30.0]
    row = one(stats.describe(spark.createDataFrame([(x,) for x in data], "x double")))
    assert math.isclose(row["skew"], pd.Series(data).skew(), rel_tol=1e-12)
    assert math.isclose(row["kurtosis"], pd.Series(data).kurtosis(), rel_tol=1e-12)
    assert math.isclose(row["q25"], pd.Series(data).quantile(0.25))


def test_constant_column(spark):
    df = spark.range(5).select(F.lit(3.0).alias("c"), F.col("id").cast("double").alias("x"))
    assert stats.constant_columns(df) == ["c"]
    assert one(stats.describe(df, ["c"]))["skew"] == 0
    assert {r["r"] for r in stats.corr_matrix(df).where("col1 = 'c'").collect()} == {None}
    assert set(values(clean.scale(df, "c", "standard"), "c")) == {0.0}
    assert set(values(clean.scale(df, "c", "minmax"), "c")) == {0.0}
    assert set(values(clean.bin_equal_width(df, ["c"], 5), "c_binned")) == {2}
    hist = charts.histogram(df, ["c"]).where("count > 0").collect()
    assert [(r["bin"], r["count"]) for r in hist] == [(10, 5)]


def test_mode_ties_take_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,)], "s string")
    assert sorted(values(clean.fill_na(df, "s", "mode"), "s")) == ["a", "a", "a", "b", "b"]
    nothing = spark.createDataFrame([(None,)], "s string")
    assert values(clean.fill_na(nothing, "s", "mode"), "s") == ["0"]


def test_bins_match_pandas_cut(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    data = np.concatenate([rng.integers(0, 50, 300).astype(float), rng.normal(size=300) * 9, [0.1 * i for i in range(100)]])
    df = spark.createDataFrame([(float(x),) for x in data], "x double")
    for n in (2, 5, 7, 20):
        got = values(clean.bin_equal_width(df, ["x"], n), "x_binned")
        assert got == list(pd.cut(pd.Series(data), bins=n, labels=False))
    counts = [r["count"] for r in charts.histogram(df, ["x"]).orderBy("bin").collect()]
    assert counts == list(np.histogram(data, bins=20)[0])


def test_casts(spark):
    df = spark.createDataFrame([("2.7",), (" 3 ",), ("bad",), (None,), ("1e2",), ("1d",), ("inf",)], "s string")
    assert values(clean.cast(df, "s", "int"), "s") == [2, 3, 0, 0, 100, 0, 0]
    assert values(clean.cast(df, "s", "float"), "s") == [2.7, 3.0, None, None, 100.0, None, float("inf")]
    numbers = spark.createDataFrame([(2**60 + 1,)], "n bigint")
    assert values(clean.cast(numbers, "n", "int"), "n") == [2**60 + 1]


def test_encodings(spark):
    df = spark.createDataFrame([(10,), (9,), (None,), (10,)], "n int")
    assert values(clean.label_encode(df, "n"), "n") == [0, 1, 2, 0]  # "10" < "9" < "nan"
    assert clean.one_hot(df, "n").columns == ["n_10"]
    assert values(clean.one_hot(df, "n"), "n_10") == [1, 0, 0, 1]
    assert len(clean.one_hot(spark.range(300), "id").columns) == 299
    with pytest.raises(errors.TooManyCategories):
        clean.one_hot(spark.range(300), "id", max_categories=200)


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, "y")], "`a.b c` double, `s``t` string")
    assert stats.describe(df).first()["column"] == "a.b c"
    assert values(clean.fill_na(df, "a.b c", "mean"), "a.b c") == [1.0, 1.0]
    assert clean.one_hot(df, "s`t").columns == ["a.b c", "s`t_y"]


def test_types_outside_the_profile(spark):
    df = spark.sql("SELECT true AS b, CAST(1.5 AS DECIMAL(5,2)) AS d, array(1) AS a, map('k', 1) AS m, DATE'2020-01-01' AS t")
    kinds = {r["column"]: r["kind"] for r in schema.classify_columns(df).collect()}
    assert kinds == {"b": "other", "d": "numeric", "a": "other", "m": "other", "t": "temporal"}
    assert stats.missing_counts(df).count() == 5
    assert stats.duplicate_count(df.union(df)) == 1
    assert one(stats.describe(df))["column"] == "d"


def test_clip_keeps_null_and_drop_removes_it(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 100]] + [(None,)], "x double")
    assert values(clean.clip_outliers(df, "x"), "x")[-2:] == [7.0, None]
    assert values(clean.drop_outliers(df, "x"), "x") == [1.0, 2.0, 3.0, 4.0]
    assert outliers.remove_outliers(df).count() == 5


def test_recipe_undo_redo_and_history(spark):
    recipe = Recipe()
    with pytest.raises(errors.NothingToUndo):
        recipe.undo()
    for i in range(25):
        recipe.add({"op": "polynomial", "columns": ["x"], "degree": i + 2})
    for _ in range(20):
        recipe.undo()
    with pytest.raises(errors.NothingToUndo):
        recipe.undo()
    assert len(recipe.steps) == 5
    recipe.redo()
    assert len(recipe.steps) == 6
    recipe.add({"op": "drop_na"})
    with pytest.raises(errors.NothingToRedo):
        recipe.redo()
    with pytest.raises(errors.UnknownOperation):
        recipe.add({"op": "nonsense"})


def test_recipe_fuses_independent_steps(spark):
    df = spark.createDataFrame([(1.0, 5.0, "a"), (None, 9.0, "b"), (3.0, None, "a")], "x double, y double, s string")
    independent = [{"op": "fill_na", "column": "x", "method": "mean"}, {"op": "fill_na", "column": "y", "method": "median"}]
    assert fit_recipe(df, independent).passes == 1
    dependent = [*independent, {"op": "scale", "column": "x", "method": "standard"}, {"op": "drop_na"}, {"op": "encode", "column": "s", "method": "label"}]
    fitted = fit_recipe(df, dependent)
    assert fitted.passes == 3
    stepwise = df
    for step in dependent:
        stepwise = apply_recipe(stepwise, [step])
    assert fitted.transform(df).collect() == stepwise.collect()


def test_single_class_evaluation(spark):
    df = spark.createDataFrame([(1, 0, 0.3), (1, 1, 0.9)], "label int, prediction int, score double")
    assert evaluate.auc(df).first()["auc"] is None
    row = one(evaluate.prf(df))
    assert row["recall"] == 0.5
    none = spark.createDataFrame([(0, 1), (0, 1)], "label int, prediction int")
    assert one(evaluate.prf(none, "binary")) == {"precision": 0.0, "recall": 0.0, "f1": 0.0}


def test_intents(spark):
    said = ["analyze my data", "train a model to predict sales", "explain the model", "help me get started", "what are the results?", "compare all models", "x", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, cmd string")
    got = {r["i"]: (r["intent"], round(r["confidence"], 2)) for r in text.classify_intent(df, "cmd").collect()}
    assert got == {
        0: ("ANALYZE_DATA", 0.5),
        1: ("TRAIN_MODEL", 0.5),
        2: ("EXPLAIN_MODEL", 0.5),
        3: ("HELP", 0.5),
        4: ("VIEW_RESULTS", 0.5),
        5: ("COMPARE_MODELS", 0.5),
        6: ("UNKNOWN", 0.0),
        7: ("UNKNOWN", 0.0),
    }


def test_unknown_names_raise(spark):
    df = spark.range(3)
    with pytest.raises(errors.UnknownColumn):
        stats.describe(df, ["absent"])
    with pytest.raises(errors.NotNumeric):
        clean.scale(df.select(F.lit("x").alias("s")), "s", "minmax")
    assert clean.drop_column(df, "absent").columns == ["id"]


def test_steps_on_columns_that_one_hot_makes(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", None), ("c", 9.0)], "g string, x double")
    start = {"op": "encode", "column": "g", "method": "one_hot"}
    scaled = apply_recipe(df, [start, {"op": "scale", "column": "g_b", "method": "minmax"}])
    assert values(scaled, "g_b") == [0.0, 1.0, 1.0, 0.0]
    assert values(apply_recipe(df, [start, {"op": "fill_na", "column": "g_b", "method": "mean"}]), "g_b") == [0, 1, 1, 0]
    clipped = apply_recipe(df, [start, {"op": "handle_outliers", "column": "g_b", "method": "clip"}])
    assert clipped.columns == ["x", "g_b", "g_c"]


def test_tables_without_numeric_columns(spark):
    df = spark.createDataFrame([("x", "y"), (None, "z")], "a string, b string")
    assert stats.describe(df).count() == outliers.detect_outliers(df).count() == stats.corr_matrix(df).count() == 0
    assert outliers.detect_outliers(df).columns[-1] == "sample_values"
    assert stats.value_ranges(df).count() == stats.sigma_outliers(df).count() == 0
    assert {r["kind"] for r in quality.quality_report(df).collect()} == {"missing", "encoding"}
    assert column_profile(df).count() == 2


def test_duplicates_are_counted_and_dropped_alike(spark):
    df = spark.sql("SELECT 1 AS k, CAST('NaN' AS DOUBLE) AS x, map('a', 1) AS m UNION ALL SELECT 1, NULL, map('a', 1) UNION ALL SELECT 2, 1.0, NULL UNION ALL SELECT 1, NULL, map('a', 2)")
    assert stats.duplicate_count(df) == 1
    dropped = clean.drop_duplicates(df)
    assert dropped.count() == 3 and dropped.columns == ["k", "x", "m"]


def test_infinite_values_leave_no_spread(spark):
    found = one(stats.describe(spark.createDataFrame([(1.0,), (2.0,), (float("inf"),)], "x double")))
    assert found["std"] is found["skew"] is found["kurtosis"] is None and found["count"] == 3


def test_correlations_of_many_columns_with_holes(spark):
    columns = [F.when(F.rand(i) > 0.2, F.randn(i) + F.col("id") / (1000 * (i + 1))).alias(f"c{i}") for i in range(100)]
    df = spark.range(10_000).select(*columns)
    got = {(r["i"], r["j"]): r["r"] for r in stats.corr_matrix(df).collect()}
    want = df.toPandas().corr().to_numpy()
    assert len(got) == 10_000
    assert max(abs(got[i, j] - want[i, j]) for i in range(100) for j in range(100)) < 1e-9


def test_a_late_text_makes_no_date_column(spark):
    rows = [(f"2024-01-{1 + i % 28:02d}",) for i in range(150)] + [("soon",)] * 50
    assert series.detect_datetime(spark.createDataFrame(rows, "d string")) == []
    assert series.detect_datetime(spark.createDataFrame(rows[:150] + [(None,)], "d string")) == ["d"]


def test_whole_numbers_beyond_bigint_stay_text(spark):
    df = spark.createDataFrame([("9007199254740993123", "99999999999999999999"), ("9007199254740993124", "1")], "a string, b string")
    typed = readers.infer_types(df)
    assert dict(typed.dtypes) == {"a": "bigint", "b": "string"}
    assert values(typed, "a") == [9007199254740993123, 9007199254740993124]


def test_duplicates_compare_maps_at_any_depth(spark):
    rows = [
        (1, {"a": 1, "b": 2}, [{"k": 1}], ({"x": {"y": 1}},)),
        (1, {"b": 2, "a": 1}, [{"k": 1}], ({"x": {"y": 1}},)),
        (1, {"a": 2, "b": 2}, [{"k": 1}], ({"x": {"y": 1}},)),
        (1, {"a": 1, "b": 2}, [{"k": 2}], ({"x": {"y": 1}},)),
        (1, {"a": 1, "b": 2}, [{"k": 1}], ({"x": {"y": 2}},)),
        (1, None, None, None),
        (1, None, None, (None,)),
        (1, None, None, None),
    ]
    df = spark.createDataFrame(rows, "_row int, m map<string,int>, l array<map<string,int>>, s struct<m:map<string,map<string,int>>>")
    assert stats.duplicate_count(df) == 2
    kept = fit_recipe(df, [{"op": "drop_duplicates"}]).transform(df)
    assert kept.count() == 6 and kept.columns == df.columns
    only = df.select("m")
    assert stats.duplicate_count(only) == 8 - 3 and stats.duplicate_count(only.withColumnRenamed("m", "_h")) == 5
