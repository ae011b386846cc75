"""From raw documents to packed training sequences, in five stages that each write a Parquet table.

Every stage is a function of (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestat.functions.columns import named
from lodestat.llm import jaccard, packing, quality, repeats, secret_scan
from lodestat.llm.exchange import held_out
from lodestat.session import checkpointed, shared_folder

#: A document of score 0.3 or more is kept: rejecting a good one costs more than keeping a doubtful one.
LEAST_QUALITY = 0.3
#: So many doc_ids with several texts are broadcast, more are joined by a shuffle.
FEW_DOC_IDS = 100_000


def _bare(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id and text, which operators read, and ``own``: all other columns in one struct, so that no name of theirs meets an operator's."""
    own = [named(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*own, F.lit(True).alias("")).alias("own"), *more)


def _like(docs: DataFrame, bare: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of ``docs`` back from ``bare``; where ``text`` differs from the text, n_chars follows it."""
    out = {c: F.col("own").getField(c) for c in docs.columns if c not in ("doc_id", "text")}
    out |= {"doc_id": F.col("doc_id"), "text": F.col("text") if text is None else text}
    if text is not None and "n_chars" in out:
        same = F.col("text").eqNullSafe(text)
        out["n_chars"] = F.when(same, out["n_chars"]).otherwise(F.char_length(text)).cast(docs.schema["n_chars"].dataType)
    return bare.select(*(out[c].alias(c) for c in docs.columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that a model learned from ``labels`` scores below LEAST_QUALITY; null and empty texts are scored too."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, "quality", usable=~held_out(5, 0))
    return _like(docs, quality.score(_bare(docs), model).where(F.col("score") >= LEAST_QUALITY))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 of their five-word shingles the one with the smallest doc_id stays.

    A document is a pair of doc_id and text, so different texts under one doc_id are compared like any others, and where they do not
    link both stay; of linked ones the first by hash of text stays. Of rows equal in both one stays. Rows without doc_id, and documents
    without words, stay.
    """
    # A document's number is its doc_id; only where texts differ under one doc_id it is a hash of both.
    named_ = docs.where("doc_id is not null")
    several = named_.select("doc_id", F.xxhash64("text").alias("h")).groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    several = checkpointed(several.where("low <> high").select(F.struct("doc_id").alias("several")))
    few = several.count() <= FEW_DOC_IDS
    rows = _bare(named_).join(F.broadcast(several) if few else several, F.col("doc_id") == F.col("several.doc_id"), "left")
    rows = rows.withColumn("key", F.when(F.col("several").isNull(), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "text"))).drop("several")
    linked = jaccard.link(rows.select(F.col("key").alias("doc_id"), "text"), k=5, part=80, whole=100)
    linked = linked.select(F.col("doc_id").alias("key"), "component_id").distinct()
    first = rows.select("key", "doc_id").distinct().join(linked, "key").groupBy("component_id").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    kept = rows.join(first.select(F.col("first.key").alias("key")), "key", "left_semi")
    again = Window.partitionBy("key").orderBy(F.xxhash64("own"))
    kept = kept.withColumn("again", F.row_number().over(again)).where("again = 1")
    return _like(docs, kept).union(docs.where("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words covered by 20-word windows that stand earlier; the other words of such a document are joined by one space.

    A document that loses all its words stays, with an empty text.
    """
    cut = repeats.remove_repeats(_bare(docs), window=20)
    return _like(docs, cut, F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of every secret."""
    return _like(docs, secret_scan.redact(_bare(docs), name="shown"), F.col("shown"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return packing.pack(_bare(docs), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: A learned classifier and a tokenizer cannot be expressed in SQL; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the tables between them stand in the cluster's shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES[:-1], 1):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
