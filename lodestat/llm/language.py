"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.llm.exchange import add_columns
from lodestat.llm.words import chunks, mix

#: Documents per language (about) that a model learns from; a language with fewer gives all.
DOCS_PER_LANGUAGE = 4000
LENGTHS = (1, 2, 3)
BUCKETS, MATRIX_BYTES = 1 << 16, 64 << 20
SMOOTHING = 0.5
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(texts: list[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each n-gram, by text; where each text's n-grams begin and end; the text has a letter).

    Texts are lower-cased; whatever is no letter counts as a space, and n-grams of more than one character may hold one space.
    """
    lower = [t.lower() + " " if t else " " for t in texts]
    codes = np.frombuffer("".join(lower).encode("utf-32-le"), "<u4")
    ends = np.cumsum([len(t) for t in lower])
    letter = _letters()[codes]
    chars = np.where(letter, codes, 0x20).astype(np.uint64)
    last = np.zeros(len(codes), bool)
    last[ends - 1] = True
    keep = np.ones(len(codes), bool)
    keep[1:] = letter[1:] | letter[:-1] | last[:-1]  # of several spaces the first
    chars, letter, row_end = chars[keep], letter[keep], np.cumsum(keep)[ends - 1]
    row = np.repeat(np.arange(len(texts)), np.diff(np.concatenate([[0], row_end])))
    mixed = mix(chars)
    parts, rows = [], []
    code = np.zeros(len(chars), np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        size = len(chars) - n + 1
        if size <= 0:
            break
        code = code[:size] * np.uint64(0x9E3779B97F4A7C15) + mixed[n - 1 :]
        if n in LENGTHS:
            use = (row[:size] == row[n - 1 :]) & (letter[:size] | letter[n - 1 :])
            parts.append((mix(code[use] + np.uint64(n)) % np.uint64(buckets)).astype(np.int32))
            rows.append(row[:size][use])
    flat, at = np.concatenate(parts), np.concatenate(rows)
    order = np.argsort(at, kind="stable")
    some = np.bincount(row[letter], minlength=len(texts)) > 0
    return flat[order], np.searchsorted(at[order], np.arange(len(texts) + 1)), some


@dataclass
class LanguageModel:
    languages: list[str]
    prior: np.ndarray  # log
    table: np.ndarray  # (languages, buckets) log-probabilities, float32

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        flat, first, some = ngrams(texts, self.table.shape[1])
        logs = np.empty((len(texts), len(self.languages)))
        for k, own in enumerate(self.table):
            sums = np.add.reduceat(np.append(own[flat], np.float32(0)).astype(np.float64), first[:-1])
            logs[:, k] = self.prior[k] + np.where(np.diff(first) > 0, sums, 0)
        best = logs.argmax(axis=1)
        chance = np.exp(logs - logs.max(axis=1, keepdims=True))
        score = 1 / chance.sum(axis=1)
        return [self.languages[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)], np.where(some, score, 0.0)


def train(docs: DataFrame, usable: Column | None = None, per_language: int = DOCS_PER_LANGUAGE) -> LanguageModel:
    """Learn from the text and lang of ``usable`` rows with a lang.

    Languages are counted over all of them. Of each language a row takes part if a hash of its doc_id falls under
    ``per_language`` / count, so about that many do, and all of a language with fewer. The counts of n-grams are added up in
    Spark; only the (language, bucket) matrix comes to the driver. With many languages the number of buckets is halved until the
    matrix keeps within 64 MB.
    """
    rows = docs.where(F.col("lang").isNotNull() & (usable if usable is not None else F.lit(True))).select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros(0), np.zeros((0, 1), np.float32))
    buckets = BUCKETS
    while buckets > 256 and buckets * len(languages) * 4 > MATRIX_BYTES:
        buckets //= 2
    number = {lang: k for k, lang in enumerate(languages)}
    spark = docs.sparkSession
    share = spark.createDataFrame([(lang, min(1.0, per_language / n)) for lang, n in sizes.items()], "lang string, share double")
    uniform = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    sample = rows.join(F.broadcast(share), "lang").where(uniform < F.col("share")).select("text", "lang").repartition(16)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), buckets), np.int64)
        for batch in chunks(batches):
            flat, first, _ = ngrams(batch.column("text").to_pylist(), buckets)
            own = np.array([number[x] for x in batch.column("lang").to_pylist()])
            total += np.bincount(np.repeat(own, np.diff(first)) * buckets + flat, minlength=total.size).reshape(total.shape)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total.ravel()[at])], ["cell", "n"])

    found = sample.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.full(len(languages) * buckets, SMOOTHING)
    table[found.column("cell").to_numpy()] += found.column("n").to_numpy()
    table = table.reshape(len(languages), buckets)
    prior = np.array([sizes[lang] for lang in languages], np.float64)
    return LanguageModel(languages, np.log(prior / prior.sum()), np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with lang_pred and score (posterior probability). A null text or one without a letter is ``und`` with score 0.

    The log-probability matrix is broadcast (at most 64 MB). Each row is judged by its whole text alone; other columns pass
    through, and columns of the new names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        names, score = shared.value.predict(batch.column("text").to_pylist())
        return [pa.array(names, pa.string()), pa.array(score)]

    return add_columns(docs, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], compute)
