"""Quality reports, scores and rule-based advice.

``table_facts`` reads the table in a few aggregate passes; the rules then work on those numbers,
which are bounded by the number of columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.errors import UnknownOperation
from lodestat.functions.columns import is_missing, named, percent, present
from lodestat.operators.outliers import outlier_report
from lodestat.operators.schema import categorical_columns, numeric_columns
from lodestat.operators.stats import distinct_counts, duplicate_count, missing_counts, value_ranges

# The report texts.
HEURISTIC_REASON = "Heuristic suggestion (AI unavailable)"
ENGINE_MISSING = "Consider handling missing values before training models"
ENGINE_DUPLICATES = "Remove duplicate rows to improve data quality"
ENGINE_SCALING = "Consider feature scaling due to different value ranges"
ENGINE_ENCODING = "Categorical variables will need encoding for ML models"
MISSING_ADVICE = "Consider handling missing values using imputation or removal"
DUPLICATE_ADVICE = "Review and remove duplicate rows if they are not intentional"
ENCODING_ADVICE = "Encode categorical variables before training ML models"
NOTHING_TO_DO = "Dataset looks well-prepared for analysis!"
COMPLETE = "No missing values detected - data is complete!"
HIGH_CARDINALITY = "Column '{}' has high cardinality ({} unique values) - consider binning"
LOW_CARDINALITY = "Column '{}' appears suitable for classification (low cardinality)"
SIZE = "Dataset contains {:,} rows and {} columns"
FOUND_MISSING = "Found {:,} missing values ({:.1f}% of total data)"
FOUND_NUMERIC = "Found {} numeric columns suitable for modeling"
FOUND_CATEGORICAL = "Found {} categorical columns that may need encoding"
GOOD_TARGET = "Column '{}' might be a good classification target (low cardinality)"
FOUND_DUPLICATES = "Warning: Found {} duplicate rows"
SPARSE_COLUMNS = "High missing values in: {}"
DUPLICATE_ROWS = "{} duplicate rows found"
CONSTANT_COLUMNS = "Constant columns: {}"
UNIQUE_TEXT = "High cardinality in {}"
MISSING_SHARE = "{} missing values: {:.1f}% of data is missing"
MANY_DUPLICATES = "High duplicates: {} duplicate rows ({:.1f}%)"
SOME_DUPLICATES = "{} duplicate rows found ({:.1f}%)"
ONE_VALUE = "Column '{}' has only one unique value"


@dataclass(frozen=True)
class Facts:
    rows: int
    columns: list[str]
    missing: dict[str, int]
    duplicates: int
    constants: list[str]
    distinct: dict[str, int]
    numeric: list[str]
    categorical: list[str]

    @property
    def total_missing(self) -> int:
        return sum(self.missing.values())

    @property
    def missing_share(self) -> float:
        cells = self.rows * len(self.columns)
        return self.total_missing / cells * 100 if cells else 0.0


def table_facts(df: DataFrame, distinct: list[str] | None = None) -> Facts:
    """Row count, missing values and constants in one pass, duplicates in two, distinct counts of the asked columns.

    A column has one distinct value exactly if its minimum equals its maximum.
    """
    by_value = [f.name for f in df.schema if f.dataType.typeName() != "map"]
    row = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)],
        *[(F.min(present(df, c)) == F.max(present(df, c))).alias(f"k{i}") for i, c in enumerate(by_value)],
    ).first()
    return Facts(
        rows=row["rows"],
        columns=df.columns,
        missing={c: row[f"m{i}"] for i, c in enumerate(df.columns)},
        duplicates=duplicate_count(df),
        constants=[c for i, c in enumerate(by_value) if row[f"k{i}"]],
        distinct={r["column"]: r["distinct"] for r in distinct_counts(df, distinct).collect()} if distinct else {},
        numeric=numeric_columns(df),
        categorical=categorical_columns(df),
    )


def _lines(df: DataFrame, lines: list[str], name: str) -> DataFrame:
    rows = [(i, text) for i, text in enumerate(lines, 1)]
    return df.sparkSession.createDataFrame(rows, f"position int, {name} string")


# ---------------------------------------------------------------- reports


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with missing values and what to do: drop the column over 50 %, the rows under 5 %, else impute."""
    hit = missing_counts(df).where(F.col("missing") > 0)
    pct = percent(F.col("missing"), F.col("rows"))
    types = F.create_map(*[F.lit(x) for f in df.schema for x in (f.name, f.dataType.simpleString())])
    return hit.select(
        "column",
        F.col("missing").alias("count"),
        pct.alias("percentage"),
        F.element_at(types, F.col("column")).alias("dtype"),
        F.when(pct > 50, "drop_column").when(pct < 5, "drop_rows").otherwise("impute").alias("recommendation"),
    )


def encoding_report(df: DataFrame) -> DataFrame:
    """Categorical columns without missing values: one-hot below 10 distinct values, label from there on."""
    cols = categorical_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, cardinality bigint, recommendation string")
    # one row per column on the broadcast side
    found = missing_counts(df.select(*[named(c) for c in cols])).join(F.broadcast(distinct_counts(df, cols)), "column").withColumnRenamed("distinct", "cardinality")
    advice = F.when(F.col("cardinality") < 10, "one_hot").otherwise("label")
    return found.where("missing = 0").select("column", "cardinality", advice.alias("recommendation"))


def quality_report(df: DataFrame) -> DataFrame:
    """The three reports as one table: kind, column, recommendation."""
    parts = [("missing", missing_report(df)), ("encoding", encoding_report(df)), ("outlier", outlier_report(df))]
    tables = [t.select(F.lit(k).alias("kind"), "column", "recommendation") for k, t in parts]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


def merge_recommendations(report: DataFrame, given: DataFrame) -> DataFrame:
    """Prefer the given (column, strategy, reasoning); fall back to the heuristic with a fixed reason.

    A given row wins even where its strategy or reasoning is NULL.
    """
    # the report has one row per column of the table, so both sides are small; AQE picks the join
    marked = given.select(
        F.col("column").alias("_column"), F.col("strategy").alias("_strategy"), F.col("reasoning").alias("_reasoning")
    )
    joined = report.join(marked, F.col("column") == F.col("_column"), "left")
    found = F.col("_column").isNotNull()
    return joined.select(
        *report.columns,
        F.when(found, F.col("_strategy")).otherwise(F.col("recommendation")).alias("strategy"),
        F.when(found, F.col("_reasoning")).otherwise(F.lit(HEURISTIC_REASON)).alias("reasoning"),
    )


# ---------------------------------------------------------------- scores


def quality_issues(df: DataFrame, rules: str = "dashboard", facts: Facts | None = None) -> DataFrame:
    """One row per issue with its text."""
    return _lines(df, [text for text, _ in _issues(df, rules, facts)], "issue")


def quality_score(df: DataFrame, rules: str = "dashboard", facts: Facts | None = None) -> DataFrame:
    """One row: quality_score, issues, duplicate_rows, completeness."""
    facts = facts or _facts_for(df, rules)
    issues = _issues(df, rules, facts)
    score = max(0, 100 - sum(cost for _, cost in issues))
    row = [(score, len(issues), facts.duplicates, round(100 - facts.missing_share, 2))]
    return df.sparkSession.createDataFrame(row, "quality_score int, issues int, duplicate_rows bigint, completeness double")


def _facts_for(df: DataFrame, rules: str) -> Facts:
    if rules not in ("dashboard", "engine"):
        raise UnknownOperation(f"unknown rule set {rules}")
    return table_facts(df, categorical_columns(df) if rules == "engine" else None)


def _issues(df: DataFrame, rules: str, facts: Facts | None) -> list[tuple[str, int]]:
    """Issue texts with the points each one costs."""
    facts = facts or _facts_for(df, rules)
    found: list[tuple[str, int]] = []
    if rules == "engine":
        sparse = [c for c in facts.columns if facts.rows and facts.missing[c] / facts.rows * 100 > 50]
        if sparse:
            found.append((SPARSE_COLUMNS.format(sparse), 10))
        if facts.duplicates:
            found.append((DUPLICATE_ROWS.format(facts.duplicates), 10))
        if facts.constants:
            found.append((CONSTANT_COLUMNS.format(facts.constants), 10))
        for c in facts.categorical:
            if facts.distinct[c] > 0.9 * facts.rows:
                found.append((UNIQUE_TEXT.format(c), 10))
        return found
    share = facts.missing_share
    levels = [(20, "High", 30), (5, "Moderate", 15), (0, "Low", 5)]
    for limit, word, cost in levels:
        if share > limit:
            found.append((MISSING_SHARE.format(word, share), cost))
            break
    if facts.duplicates:
        part = facts.duplicates / facts.rows * 100
        if part > 10:
            found.append((MANY_DUPLICATES.format(facts.duplicates, part), 20))
        else:
            found.append((SOME_DUPLICATES.format(facts.duplicates, part), 10))
    found += [(ONE_VALUE.format(c), 5) for c in facts.columns if c in facts.constants]
    return found


# ---------------------------------------------------------------- advice


def recommendations(df: DataFrame, rules: str = "dashboard") -> DataFrame:
    """Advice lines under one of the two rule sets."""
    lines = []
    if rules == "engine":
        facts = table_facts(df)
        if facts.rows and max(facts.missing.values()) / facts.rows * 100 > 5:
            lines.append(ENGINE_MISSING)
        if facts.duplicates:
            lines.append(ENGINE_DUPLICATES)
        spread = [r["range"] for r in value_ranges(df).collect() if r["range"] is not None] if facts.numeric else []
        if spread and max(spread) > 100 * min(spread):
            lines.append(ENGINE_SCALING)
        if facts.categorical:
            lines.append(ENGINE_ENCODING)
        return _lines(df, lines, "recommendation")

    facts = table_facts(df, numeric_columns(df) + categorical_columns(df))
    if facts.total_missing:
        lines.append(MISSING_ADVICE)
    if facts.duplicates:
        lines.append(DUPLICATE_ADVICE)
    if facts.categorical:
        lines.append(ENCODING_ADVICE)
    wide = [c for c in facts.categorical if facts.distinct[c] > 50][:1]
    lines += [HIGH_CARDINALITY.format(c, facts.distinct[c]) for c in wide]
    narrow = [c for c in facts.numeric if facts.rows and facts.distinct[c] / facts.rows < 0.05 and facts.distinct[c] <= 10][:1]
    lines += [LOW_CARDINALITY.format(c) for c in narrow]
    return _lines(df, lines or [NOTHING_TO_DO], "recommendation")


def insights(df: DataFrame) -> DataFrame:
    """Plain sentences about size, missing values, column classes, possible targets and duplicates."""
    facts = table_facts(df, numeric_columns(df))
    lines = [SIZE.format(facts.rows, len(facts.columns))]
    if facts.total_missing:
        lines.append(FOUND_MISSING.format(facts.total_missing, facts.missing_share))
    else:
        lines.append(COMPLETE)
    if facts.numeric:
        lines.append(FOUND_NUMERIC.format(len(facts.numeric)))
    if facts.categorical:
        lines.append(FOUND_CATEGORICAL.format(len(facts.categorical)))
    for c in facts.numeric:
        if facts.rows and facts.distinct[c] / facts.rows < 0.1 and facts.distinct[c] < 20:
            lines.append(GOOD_TARGET.format(c))
    if facts.duplicates:
        lines.append(FOUND_DUPLICATES.format(facts.duplicates))
    return _lines(df, lines, "insight")
