"""Operators on message tables: intents, entities, code blocks and embedded JSON. No Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions.columns import named

# The keywords of each intent, in the order in which ties are decided.
INTENT_KEYWORDS = {
    "ANALYZE_DATA": ["analyze", "analysis", "explore", "show", "display", "visualize", "statistics", "stats", "summary"],
    "TRAIN_MODEL": ["train", "build", "create model", "fit", "learn", "develop model"],
    "EXPLAIN_MODEL": ["explain", "why", "how does", "interpret", "feature importance", "what affects"],
    "UPLOAD_DATA": ["upload", "load", "import", "add data", "bring data", "use dataset"],
    "PREDICT": ["predict", "forecast", "estimate", "what will", "prediction"],
    "HELP": ["help", "how to", "what can", "guide", "tutorial", "show me how"],
    "VIEW_RESULTS": ["results", "show results", "what happened", "outcome", "performance"],
    "COMPARE_MODELS": ["compare", "which is better", "best model", "difference between"],
}
# Model names looked for in a message, first match wins.
MODEL_NAMES = ["xgboost", "random forest", "linear regression", "logistic regression", "neural network", "svm"]
UNKNOWN = "UNKNOWN"


def _confidence(hits: Column) -> Column:
    return F.when(hits > 0, F.least(F.lit(0.7), F.lit(0.4) + hits * F.lit(0.1))).otherwise(F.lit(0.0))


def classify_intent(df: DataFrame, text: str) -> DataFrame:
    """Add intent, confidence and needs_clarification from keyword hits in the lower-cased text.

    NULL or under 2 characters is UNKNOWN with confidence 0. On equal confidence the earlier intent wins.
    """
    short = named(text).isNull() | (F.length(F.regexp_replace(named(text), r"^\s+|\s+$", "")) < 2)
    lowered = F.lower(named(text))
    hits = {i: sum((lowered.contains(w).cast("int") for w in words), F.lit(0)) for i, words in INTENT_KEYWORDS.items()}
    scored = df.withColumns({f"_hits_{i}": _confidence(h) for i, h in hits.items()})
    best = F.greatest(*[F.col(f"_hits_{i}") for i in INTENT_KEYWORDS])
    scored = scored.withColumn("confidence", F.when(short, F.lit(0.0)).otherwise(best))
    intent = F.when(F.col("confidence") == 0, F.lit(UNKNOWN))
    for i in INTENT_KEYWORDS:
        intent = intent.when(F.col(f"_hits_{i}") == F.col("confidence"), F.lit(i))
    result = scored.withColumn("intent", intent).withColumn("needs_clarification", F.col("confidence") < 0.5)
    return result.select(*[named(c) for c in df.columns], "intent", "confidence", "needs_clarification")


def extract_entities(df: DataFrame, text: str) -> DataFrame:
    """Add target_column (first quoted string) and model_type (first known name contained)."""
    quoted = F.regexp_extract(named(text), "[\"']([^\"']+)[\"']", 1)
    lowered = F.lower(named(text))
    model = F.lit(None).cast("string")
    for name in reversed(MODEL_NAMES):
        model = F.when(lowered.contains(name), F.lit(name)).otherwise(model)
    return df.withColumns({"target_column": F.nullif(quoted, F.lit("")), "model_type": model})


def extract_code_blocks(df: DataFrame, text: str) -> DataFrame:
    """Add the array of Python code blocks found in a markdown text."""
    blocks = F.regexp_extract_all(named(text), F.lit("(?s)```python\\s*(.*?)\\s*```"), F.lit(1))
    return df.withColumn("code_blocks", blocks)


def json_text(col: Column) -> Column:
    """The JSON part of a reply: without an enclosing code fence, cut to the outermost braces."""
    return F.nullif(F.regexp_extract(col, "(?s)\\{.*\\}", 0), F.lit(""))


def extract_json(df: DataFrame, text: str, schema: str) -> DataFrame:
    """Add ``parsed``: the embedded JSON under ``schema``, NULL where there is none or it is malformed."""
    found = json_text(named(text))
    # from_json alone would return a struct of NULLs for malformed text
    return df.withColumn("parsed", F.when(F.try_parse_json(found).isNotNull(), F.from_json(found, schema)))


def extract_intent_reply(df: DataFrame, text: str) -> DataFrame:
    """Read an intent reply (intent, entities, confidence, needs_clarification) out of free text.

    Unknown intents become UNKNOWN, a missing confidence 0.5, and entities that are null or the
    text 'null' are dropped.
    """
    schema = "intent string, entities map<string,string>, confidence double, needs_clarification boolean"
    parsed = extract_json(df, text, schema)
    intent = F.when(F.col("parsed.intent").isin(list(INTENT_KEYWORDS)), F.col("parsed.intent")).otherwise(F.lit(UNKNOWN))
    no_entities = F.create_map().cast("map<string,string>")
    entities = F.map_filter(F.coalesce("parsed.entities", no_entities), lambda k, v: v.isNotNull() & (v != "null"))
    found = F.col("parsed").isNotNull()
    return parsed.select(
        *[named(c) for c in df.columns],
        F.when(found, intent).alias("intent"),
        F.when(found, F.coalesce("parsed.confidence", F.lit(0.5))).alias("confidence"),
        F.when(found, F.coalesce("parsed.needs_clarification", F.lit(False))).alias("needs_clarification"),
        F.when(found, entities).alias("entities"),
    )


def intent_report(df: DataFrame, text: str) -> DataFrame:
    """Messages, mean confidence and share needing clarification per intent."""
    return classify_intent(df, text).groupBy("intent").agg(
        F.count("*").alias("messages"),
        F.avg("confidence").alias("mean_confidence"),
        F.avg(F.col("needs_clarification").cast("int")).alias("clarification_share"),
    )


def last_turns(df: DataFrame, n: int = 10, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The latest n messages per conversation; every task cuts its part to n per conversation first."""
    newest = Window.partitionBy(named(conversation)).orderBy(named(turn).desc())
    return df.withColumn("_newest", F.row_number().over(newest)).where(F.col("_newest") <= n).drop("_newest")
