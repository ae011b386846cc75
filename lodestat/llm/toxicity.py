"""Toxicity: a linear-chain conditional random field tags toxic words; its marginals give document scores and spans.

Documents carry one label, words none. Words of toxic training documents are labelled by the features that stand almost only in
such documents and in many different contexts there (copies of one document share their contexts). The field is trained on these
labelled words, so that neighbours and transitions count too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.llm.exchange import add_columns
from lodestat.llm.words import _CODE, _LOWER, chunks, mix, powers, split
from lodestat.session import checkpointed

#: Bounds on the labelled documents a model is fitted on, by label: those with the smallest hash of doc_id.
TOXIC_ROWS, OTHER_ROWS = 4000, 8000
#: Bounds on the features kept as marks and on the training segments taken from one document.
MARKS, SEGMENTS = 50_000, 4
#: A mark stands in this share of the toxic sample, in as many contexts (at least LEAST_DOCS), and this sure with balanced labels.
LEAST_SHARE, LEAST_DOCS, PRECISION = 0.004, 5, 0.96
SLOTS, REACH, BLOCK = 1 << 18, 8, 64
OWN = 5  # features of the word itself; the previous and the next word follow
_BASE = 0x9E3779B97F4A7C15
_EDGE = np.zeros(256, bool)
_EDGE[[b for b in range(33, 127) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)]] = True


@dataclass
class Tokens:
    row: np.ndarray
    start: np.ndarray  # bytes, without marks around the word
    end: np.ndarray
    first: np.ndarray  # of each text
    features: np.ndarray  # (tokens, OWN + 2) 64-bit hashes
    heads: np.ndarray  # code points before each byte


def tokenise(texts: pa.Array) -> Tokens:
    """Words with the hashes of the word, its first 4, 5 and 6 bytes, its last 4 bytes, and the words beside it."""
    words = split(texts)
    start, end = words.starts.copy(), words.ends.copy()
    for _ in range(3):
        end -= _EDGE[words.data[end - 1]] & (end - start > 1)
        start += _EDGE[words.data[start]] & (end - start > 1)
    sums = np.zeros(len(words.data) + 1, np.uint64)
    np.cumsum(_CODE[_LOWER][words.data] * powers(_BASE, len(words.data))[:-1], out=sums[1:])
    inverse = powers(pow(_BASE, -1, 2**64), len(words.data))

    def span(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
        return mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64), salt)

    row = np.repeat(np.arange(len(texts)), words.counts)
    whole = span(start, end, 1)
    own = [whole] + [span(start, np.minimum(start + k, end), k) for k in (4, 5, 6)] + [span(np.maximum(end - 4, start), end, 9)]
    before, after = np.full(len(row), 7, np.uint64), np.full(len(row), 7, np.uint64)
    same = row[1:] == row[:-1]
    before[1:][same] = whole[:-1][same]
    after[:-1][same] = whole[1:][same]
    heads = np.zeros(len(words.data) + 1, np.int64)
    np.cumsum((words.data & 0xC0) != 0x80, out=heads[1:])
    features = np.stack([*own, mix(before, 11), mix(after, 13)], axis=1) if len(row) else np.zeros((0, OWN + 2), np.uint64)
    return Tokens(row, start, end, words.first, features, heads)


def _normal(x: np.ndarray) -> np.ndarray:
    return x / x.max(axis=tuple(range(1, x.ndim)), keepdims=True)


@dataclass
class ChainField:
    weights: np.ndarray  # (SLOTS,) of state 1
    bias: float
    moves: np.ndarray  # (2, 2) scores of state i before state j
    calibration: np.ndarray  # of the columns of summaries()

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return np.clip(self.weights[(features >> np.uint64(20)).astype(np.int64) % SLOTS].sum(axis=1) + self.bias, -30, 30)

    def marginals(self, emissions: np.ndarray, first: np.ndarray) -> np.ndarray:
        """P(state 1) of every token given its whole text, by forward-backward in blocks.

        The transfer matrices of all blocks of all texts are made side by side; a text's blocks are then chained, and the messages
        inside the blocks are made side by side again. The result is that of one pass over each text.
        """
        counts = np.diff(first)
        blocks = -(-counts // BLOCK)
        begin = np.cumsum(blocks) - blocks
        row = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(emissions)) - first[row]
        at = (begin[row] + place // BLOCK, place % BLOCK)
        n = int(blocks.sum())
        if not n:
            return np.zeros(0)
        step = np.tile(np.eye(2), (n, BLOCK, 1, 1))
        odds = np.exp(emissions)
        step[at] = np.exp(self.moves)[None] * np.stack([np.ones(len(odds)), odds], axis=1)[:, None, :]
        step[at[0][place == 0], 0, 0] = step[at[0][place == 0], 0, 1] = np.stack([np.ones((place == 0).sum()), odds[place == 0]], axis=1)
        whole = step[:, 0]
        for k in range(1, BLOCK):
            whole = _normal(whole @ step[:, k])
        alpha, beta = np.ones((n, 2)), np.ones((n, 2))
        for b in range(1, int(blocks.max())):
            rows = begin[blocks > b] + b
            alpha[rows] = _normal((alpha[rows - 1][:, None, :] @ whole[rows - 1])[:, 0])
        for b in range(int(blocks.max()) - 2, -1, -1):
            rows = begin[blocks > b + 1] + b
            beta[rows] = _normal((whole[rows + 1] @ beta[rows + 1][:, :, None])[:, :, 0])
        forward, backward = np.empty((n, BLOCK, 2)), np.empty((n, BLOCK, 2))
        for k in range(BLOCK):
            alpha = _normal((alpha[:, None, :] @ step[:, k])[:, 0])
            forward[:, k] = alpha
        for k in range(BLOCK - 1, -1, -1):
            backward[:, k] = beta
            beta = _normal((step[:, k] @ beta[:, :, None])[:, :, 0])
        both = forward[at] * backward[at]
        return both[:, 1] / both.sum(axis=1)

    def tag(self, texts: pa.Array) -> tuple[Tokens, np.ndarray]:
        tokens = tokenise(texts)
        return tokens, self.marginals(self.emissions(tokens.features), tokens.first)

    def score(self, summary: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(summary @ self.calibration, -30, 30)))


def summaries(tokens: Tokens, p: np.ndarray) -> np.ndarray:
    """(texts, 4): 1, the two largest marginals, log(1 + expected number of toxic words among those of at least 5 %)."""
    n = len(tokens.first) - 1
    order = np.lexsort((p, tokens.row))
    counts, last = np.diff(tokens.first), tokens.first[1:] - 1
    largest, second = np.zeros(n), np.zeros(n)
    largest[counts > 0] = p[order[last[counts > 0]]]
    second[counts > 1] = p[order[last[counts > 1] - 1]]
    likely = np.bincount(tokens.row, np.where(p >= 0.05, p, 0), n)
    return np.stack([np.ones(n), largest, second, np.log1p(likely)], axis=1)


def _train_field(features: np.ndarray, labels: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and moves that maximise the likelihood of segments (segments, length) of labelled tokens; full-batch Adagrad."""
    slots = ((features >> np.uint64(20)) % np.uint64(SLOTS)).astype(np.int32)
    s, length, _ = slots.shape
    weights, bias, moves = np.zeros(SLOTS), -3.0, np.array([[0.0, -1.0], [-0.5, 0.0]])
    seen_w, seen_b, seen_m = np.full(SLOTS, 1e-2), 1e-2, np.full((2, 2), 1e-2)
    flat = slots[used].ravel()
    for _ in range(40):
        emission = np.where(used, weights[slots].sum(axis=2) + bias, 0.0)
        e = np.stack([np.zeros_like(emission), np.clip(emission, -30, 30)], axis=2)
        m = np.exp(moves)
        forward, backward = np.empty((s, length, 2)), np.ones((s, length, 2))
        a = _normal(np.exp(e[:, 0]))
        forward[:, 0] = a
        for k in range(1, length):
            new = (a @ m) * np.exp(e[:, k])
            a = np.where(used[:, k, None], _normal(new), a)
            forward[:, k] = a
        b = np.ones((s, 2))
        for k in range(length - 1, 0, -1):
            new = _normal((np.exp(e[:, k]) * b) @ m.T)
            b = np.where(used[:, k, None], new, b)
            backward[:, k - 1] = b
        both = forward * backward
        p = both[:, :, 1] / both.sum(axis=2)
        error = np.where(used, labels - p, 0.0)
        pair = forward[:, :-1, :, None] * m[None, None] * (np.exp(e[:, 1:]) * backward[:, 1:])[:, :, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        here = used[:, 1:] & used[:, :-1]
        truth = np.stack([1 - labels, labels], axis=2)
        real = truth[:, :-1, :, None] * truth[:, 1:, None, :]
        g_m = ((real - pair) * here[:, :, None, None]).sum(axis=(0, 1))
        g_w = np.bincount(flat, np.repeat(error[used], slots.shape[2]), SLOTS) - 0.01 * weights
        g_b = error.sum()
        seen_w += g_w**2
        seen_b += g_b**2
        seen_m += g_m**2
        weights += 1.0 * g_w / np.sqrt(seen_w)
        bias += 0.5 * g_b / np.sqrt(seen_b)
        moves = moves + 0.3 * g_m / np.sqrt(seen_m)
    return weights, float(bias), moves


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - 0.05 * w)
    return w


def _collect(df: DataFrame, *names: str) -> list[np.ndarray]:
    table = df.toArrow()
    return [table.column(n).to_numpy(zero_copy_only=False) for n in names]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", usable: Column | None = None) -> ChainField:
    """Fit on at most TOXIC_ROWS documents with label 1 and OTHER_ROWS with label 0 among the ``usable`` label rows.

    Only the sample's ids are broadcast; the sample's texts stay in Spark, written once. To the driver come the marks (at most
    MARKS hashes), segments of 17 tokens around words to learn from (at most SEGMENTS for each document) and four numbers for
    each document. Where many texts share a doc_id, those with the smallest hash fill the same bounds. Without toxic documents the
    model finds nothing.
    """
    pool = labels.where(F.col("doc_id").isNotNull() & (usable if usable is not None else F.lit(True)))
    pool = pool.select("doc_id", F.col(label).cast("int").alias("y"))
    sample = [pool.where(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for v, n in ((1, TOXIC_ROWS), (0, OTHER_ROWS))]
    found = docs.select("doc_id", "text").join(F.broadcast(sample[0].union(sample[1])), "doc_id").withColumn("h", F.xxhash64("text"))
    found = checkpointed(found.repartition(24, "doc_id", "h").dropDuplicates(["doc_id", "h", "y"]))
    names = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("h")]
    kept = [found.where(F.col("y") == v).select("doc_id", "h", "y").orderBy(*names).limit(n) for v, n in ((1, TOXIC_ROWS), (0, OTHER_ROWS))]
    chosen = checkpointed(found.join(F.broadcast(kept[0].union(kept[1])), ["doc_id", "h", "y"], "left_semi").select("text", "y").repartition(24))

    def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            tokens, y = tokenise(batch.column("text")), batch.column("y").to_numpy()
            keys = np.stack([np.tile(tokens.row, OWN).astype(np.uint64), tokens.features[:, :OWN].T.ravel()], axis=1)
            order = np.lexsort((keys[:, 0], keys[:, 1]))
            keys = keys[order][np.concatenate([[True], (np.diff(keys[order], axis=0) != 0).any(axis=1)])] if len(keys) else keys
            toxic = y[keys[:, 0].astype(np.int64)]
            names, at = np.unique(keys[:, 1], return_inverse=True)
            n1, n0 = np.bincount(at, toxic, len(names)), np.bincount(at, 1 - toxic, len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n1.astype(np.int64)), pa.array(n0.astype(np.int64))], ["f", "n1", "n0"])

    counts = chosen.mapInArrow(document_counts, "f long, n1 long, n0 long").groupBy("f").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    sizes = {r.y: r.n for r in chosen.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    ratio = max(sizes.get(1, 0), 1) / max(sizes.get(0, 0), 1)  # as if both labels were as frequent
    least = max(LEAST_DOCS, LEAST_SHARE * sizes.get(1, 0))
    sure = (F.col("n1") >= least) & (F.col("n1") >= PRECISION * (F.col("n1") + ratio * F.col("n0")))
    candidates = np.sort(_collect(counts.where(sure).orderBy(F.desc("n1"), "f").limit(MARKS), "f")[0].view(np.uint64))

    def member(names: np.ndarray, features: np.ndarray) -> np.ndarray:
        if not len(names):
            return np.zeros(features.shape, bool)
        return names[np.minimum(np.searchsorted(names, features), len(names) - 1)] == features

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One context, the neighbours with the smallest hash, of each mark in each document: copies give the same one."""
        for batch in chunks(batches):
            tokens = tokenise(batch.column("text"))
            at, which = np.nonzero(member(candidates, tokens.features[:, :OWN]))
            around = mix(tokens.features[at, OWN] + mix(tokens.features[at, OWN + 1]))
            name, row = tokens.features[at, which], tokens.row[at]
            order = np.lexsort((around, row, name))
            name, row, around = name[order], row[order], around[order]
            first = np.concatenate([[True], (name[1:] != name[:-1]) | (row[1:] != row[:-1])]) if len(at) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(name[first].view(np.int64)), pa.array(around[first].view(np.int64))], ["f", "c"])

    seen = chosen.where("y = 1").mapInArrow(contexts, "f long, c long").distinct().groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    marks = np.sort(_collect(seen.where(F.col("n") >= least), "f")[0].view(np.uint64))

    width = 2 * REACH + 1

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            tokens, y = tokenise(batch.column("text")), batch.column("y").to_numpy()
            hit = member(marks, tokens.features[:, :OWN]).any(axis=1)
            dice = mix(tokens.features[:, 0] + np.arange(len(hit), dtype=np.uint64))
            order = np.lexsort((dice, ~hit, tokens.row))
            rank = np.arange(len(order)) - tokens.first[tokens.row[order]]
            centre = np.sort(order[rank < SEGMENTS])
            at = centre[:, None] + np.arange(-REACH, REACH + 1)
            used = (at >= tokens.first[tokens.row[centre]][:, None]) & (at < tokens.first[tokens.row[centre] + 1][:, None])
            at = np.clip(at, 0, max(len(hit) - 1, 0))
            rows = [tokens.features[at].reshape(len(centre), -1), (hit[at] & (y[tokens.row[centre]] == 1)[:, None]).astype(np.uint8), used.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()) for x in rows], ["x", "y", "used"])

    x, y, used = _collect(chosen.mapInArrow(segments, "x binary, y binary, used binary"), "x", "y", "used")
    field = ChainField(np.zeros(SLOTS), -10.0, np.zeros((2, 2)), np.array([-6.0, 0.0, 0.0, 0.0]))
    if not len(x) or not len(marks):
        return field
    order = np.argsort(x)
    features = np.frombuffer(b"".join(x[order]), np.uint64).reshape(-1, width, OWN + 2)
    target = np.frombuffer(b"".join(y[order]), np.uint8).reshape(-1, width).astype(np.float64)
    field.weights, field.bias, field.moves = _train_field(features, target, np.frombuffer(b"".join(used[order]), np.uint8).reshape(-1, width).astype(bool))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            s = summaries(*field.tag(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*(pa.array(s[:, k]) for k in (1, 2, 3)), batch.column("y")], ["a", "b", "c", "y"])

    a, b, c, y = _collect(chosen.mapInArrow(summarise, "a double, b double, c double, y int"), "a", "b", "c", "y")
    order = np.lexsort((y, c, b, a))
    field.calibration = _logistic(np.stack([np.ones(len(a)), a, b, c], axis=1)[order], y[order].astype(np.float64))
    return field


def score(docs: DataFrame, model: ChainField, spans: bool = True) -> DataFrame:
    """``docs`` with score (probability that the text is toxic) and, if asked for, toxic_spans: (start, end) in code points, end
    exclusive, of the words that are rather toxic than not; neighbouring words make one span.

    Whole texts are tagged, each by itself. Null and empty texts get the score of a text without toxic words and no spans. The
    model (2 MB of weights) is broadcast. Other columns pass through; columns of the new names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    fields = [T.StructField("score", T.DoubleType())] + [T.StructField("toxic_spans", T.ArrayType(span))] * spans

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        tokens, p = shared.value.tag(batch.column("text"))
        out = [pa.array(shared.value.score(summaries(tokens, p)))]
        if spans:
            at = np.flatnonzero(p >= 0.5)
            row = tokens.row[at]
            new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(row) != 0)]) if len(at) else np.zeros(0, bool)
            head = np.flatnonzero(new)
            tail = np.concatenate([head[1:] - 1, [len(at) - 1]])[: len(head)]
            texts = split(batch.column("text"))
            base = tokens.heads[texts.offsets[row[head]]]
            values = pa.StructArray.from_arrays(
                [pa.array(tokens.heads[tokens.start[at[head]]] - base), pa.array(tokens.heads[tokens.end[at[tail]]] - base)], ["start", "end"]
            )
            offsets = np.searchsorted(row[head], np.arange(batch.num_rows + 1)).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(offsets), values))
        return out

    return add_columns(docs, fields, compute)
