"""Quality classifier: a generalised additive model with pairwise terms, learned by cyclic boosting of shallow trees."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.llm.exchange import add_columns
from lodestat.llm.textstats import stats
from lodestat.llm.words import SLICE_BYTES

#: Bound on the labelled rows a model is fitted on; those with the smallest hash of doc_id are taken.
TRAINING_ROWS = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, RATE = 48, 12, 8, 150, 0.1


def features(texts: pa.Array) -> np.ndarray:
    s = stats(texts)
    words, chars, letters, n_lines = (np.maximum(s[c], 1) for c in ("n_words", "word_chars", "n_letters", "n_lines"))
    return np.stack(
        [
            np.log1p(s["n_words"]),
            s["word_chars"] / words,
            s["n_symbols"] / words,
            s["n_dup_lines"] / n_lines,
            s["n_repeat_words"] / words,
            s["n_upper"] / letters,
            s["n_digits"] / chars,
            s["n_punct"] / words,
            s["n_bangs"] / words,
            s["n_echo"] / words,
            s["n_known"] / words,
            s["n_short"] / words,
            s["n_long"] / words,
            s["n_capital"] / words,
            s["n_letters"] / chars,
            s["n_closed_lines"] / n_lines,
            np.log1p(s["n_words"] / n_lines),
        ],
        axis=1,
    ).astype(np.float32)


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _gain(g, h):
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of a tree of up to four leaves over ordered bins."""
    out = np.empty(len(g))

    def grow(a: int, b: int, depth: int) -> None:
        cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
        if depth and b - a > 1:
            gains = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1])
            gains[(ch[:-1] < 1) | (ch[-1] - ch[:-1] < 1)] = -1
            k = int(np.argmax(gains))
            if gains[k] > _gain(cg[-1], ch[-1]) + 1e-6:
                grow(a, a + k + 1, depth - 1)
                grow(a + k + 1, b, depth - 1)
                return
        out[a:b] = _leaf(cg[-1], ch[-1])

    grow(0, len(g), 2)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values of a tree that cuts the first feature once and then the second on either side; its gain over no cut."""
    best, value = 0.0, np.full(g.shape, _leaf(g.sum(), h.sum()))
    cg, ch = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
    base = _gain(cg[-1, -1], ch[-1, -1])
    for i in range(len(g) - 1):
        gains, cuts = 0.0, []
        for rows_g, rows_h in ((cg[i], ch[i]), (cg[-1] - cg[i], ch[-1] - ch[i])):
            both = _gain(rows_g[:-1], rows_h[:-1]) + _gain(rows_g[-1] - rows_g[:-1], rows_h[-1] - rows_h[:-1])
            j = int(np.argmax(both))
            gains += both[j]
            cuts.append((j, _leaf(rows_g[j], rows_h[j]), _leaf(rows_g[-1] - rows_g[j], rows_h[-1] - rows_h[j])))
        if gains - base > best:
            best = gains - base
            for part, (j, low, high) in zip((value[: i + 1], value[i + 1 :]), cuts, strict=True):
                part[:, : j + 1], part[:, j + 1 :] = low, high
    return value, best


@dataclass
class AdditiveModel:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]  # bin -> bin of the pairwise tables
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], axis=1)

    def logit(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for k, table in enumerate(self.tables):
            out += table[bins[:, k]]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[self.coarse[a][bins[:, a]], self.coarse[b][bins[:, b]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(self.bins(x)), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Boost one feature after the other, round after round; then the pairs whose trees gain most on what is left."""
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(width)]
    sizes = [len(e) + 1 for e in edges]
    coarse = [np.arange(n) * min(n, PAIR_BINS) // n for n in sizes]
    rate = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    model = AdditiveModel(np.log(rate / (1 - rate)), edges, [np.zeros(n) for n in sizes], coarse, [], [])
    if not len(y):
        return model
    bins = model.bins(x)
    f = model.logit(bins)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, np.maximum(p * (1 - p), 1e-4)

    for _ in range(ROUNDS):
        for k in range(width):
            g, h = slopes()
            step = RATE * _tree(np.bincount(bins[:, k], g, sizes[k]), np.bincount(bins[:, k], h, sizes[k]))
            model.tables[k] += step
            f += step[bins[:, k]]
    small = np.stack([coarse[k][bins[:, k]] for k in range(width)], axis=1)
    shape = [int(c[-1]) + 1 for c in coarse]

    def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        at, n = small[:, a] * shape[b] + small[:, b], shape[a] * shape[b]
        return np.bincount(at, g, n).reshape(shape[a], shape[b]), np.bincount(at, h, n).reshape(shape[a], shape[b])

    gains = sorted(((_pair_tree(*grid(a, b))[1], a, b) for a in range(width) for b in range(a + 1, width) if min(shape[a], shape[b]) > 1), reverse=True)
    model.pairs = [(a, b) for _, a, b in gains[:PAIRS]]
    model.pair_tables = [np.zeros((shape[a], shape[b])) for a, b in model.pairs]
    for _ in range(ROUNDS // 3):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            step = RATE * _pair_tree(*grid(a, b))[0]
            table += step
            f += step[small[:, a], small[:, b]]
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", usable: Column | None = None, max_rows: int = TRAINING_ROWS) -> AdditiveModel:
    """Fit on at most ``max_rows`` labelled documents: those whose doc_id has the smallest hash, among ``usable`` rows.

    Only the sample's ids (bounded) are broadcast and only its features come to the driver, at most ``max_rows`` rows of them also where
    many rows of ``docs`` share a doc_id. Rows without label, doc_id or document are left out; a document with several labels counts
    once for each. Without any usable row the model gives 0.5.
    """
    pool = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (usable if usable is not None else F.lit(True)))
    sample = pool.select("doc_id", F.col(label).cast("double").alias("label_")).orderBy(F.xxhash64("doc_id"), "doc_id", "label_").limit(max_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", F.xxhash64("text").alias("hash_"), "label_")
    fields = [T.StructField("features", T.BinaryType())]
    rows = add_columns(found, fields, lambda b: [pa.array([r.tobytes() for r in features(b.column("text"))], pa.binary())], drop=("text",))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "hash_", "label_").limit(max_rows).collect()
    x = np.stack([np.frombuffer(r.features, np.float32) for r in rows]) if rows else np.zeros((0, 17), np.float32)
    order = np.lexsort(x.T) if len(x) else []
    return fit(x[order], np.array([r.label_ for r in rows], np.float64)[order])


def score(docs: DataFrame, model: AdditiveModel, name: str = "score") -> DataFrame:
    """``docs`` with the probability that the text is good. Null and empty texts are scored as texts without words.

    The model is a few kilobytes of tables in the task's closure. Every other column passes through; one of the same name is
    replaced.
    """
    return add_columns(docs, [T.StructField(name, T.DoubleType())], lambda b: [pa.array(model.score(features(b.column("text"))))], limit=SLICE_BYTES)
