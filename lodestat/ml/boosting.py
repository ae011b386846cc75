"""Second-order gradient boosting and single trees on Spark: rows stay binned in blocks, histograms are summed by the executors.

Every level of a tree is one job: tasks bring their rows' margins up to date, find the rows' nodes and send one row per (node, feature,
bin) with sums, which Spark adds up. The driver sees these sums, at most nodes x features x bins, and picks splits. Rows whose features
fall into the same bins stand in the same leaf of every tree, so they are kept as one row with a count. Where all of these fit
one block, the task that holds it grows the round's trees by the same code, so that a round is one job.
"""

from __future__ import annotations

import json
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.errors import LodestatError
from lodestat.ml.trees import MAX_BINS, Grower, Growth, Sketch, Tree, histograms, to_bins
from lodestat.session import checkpointed

#: Prefixes of the rows that ordered boosting keeps a model for; the shortest holds a share of 2^-PREFIXES of the rows.
PREFIXES = 16
#: Rows of one block, points of one feature's sketch, groups in which sketches are merged before the last merge, rounds between two writes of
#: the margins.
BLOCK_ROWS, SKETCH_SIZE, SKETCH_GROUPS, KEEP_ROUNDS = 1 << 16, 4096, 64, 20
#: Styles that grow a tree for each output.
_MANY_TREES = ("newton", "gradient")
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Boosting:
    """Settings of one training run. ``style``: newton (depth- or leaf-wise trees), ordered (oblivious trees, ordered boosting), gradient
    (first-order trees, as MLlib's), single (one tree whose leaves hold means or class shares)."""

    style: str = "newton"
    rounds: int = 100
    rate: float = 0.1
    growth: Growth = Growth()
    bins: int = MAX_BINS
    top_rate: float | None = None  # gradient-based one-side sampling: this share of the largest gradients,
    other_rate: float = 0.1  # and this share of all rows from the others, scaled up
    seed: int = 42


def gradients(margin: np.ndarray, y: np.ndarray, loss: str) -> tuple[np.ndarray, np.ndarray]:
    """(first, second) derivatives of the loss by each margin, (rows, outputs)."""
    if loss == "squared":
        return margin - y[:, None], np.ones_like(margin)
    if loss == "rest":  # each class against the rest
        p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
        return p - (y[:, None] == np.arange(margin.shape[1])), np.ones_like(margin)
    if loss == "shares":  # one output for each class; a leaf's value becomes the share of each class
        return margin - (y[:, None] == np.arange(margin.shape[1])), np.ones_like(margin)
    p = probabilities(margin)
    if loss == "logistic":
        p = p[:, 1:]
        return p - y[:, None], np.maximum(p * (1 - p), 1e-16)
    return p - (y[:, None] == np.arange(margin.shape[1])), np.maximum(2 * p * (1 - p), 1e-16)


def probabilities(margin: np.ndarray) -> np.ndarray:
    """Class probabilities: the logistic function of one margin, or the softmax of several."""
    if margin.shape[1] == 1:
        p = 1 / (1 + np.exp(-np.clip(margin[:, 0], -500, 500)))
        return np.stack([1 - p, p], axis=1)
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class BoostedModel:
    """Trees by round and output. ``transform`` adds prediction and, for classes, probability; it is a projection, so it scores streams."""

    def __init__(self, loss: str, base: list[float], rounds: list[list[Tree]], width: int):
        self.loss, self.base, self.rounds, self.width = loss, base, rounds, width

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(np.array(self.base), (len(x), 1))
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                out[:, slice(None) if tree.value.shape[1] > 1 else slice(k, k + 1)] += tree.value[tree.apply(x)]
        return out

    def outputs(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities, or predictions in one column."""
        margin = self.margins(x)
        if self.loss == "rest":  # logistic values of half the margins, made to sum to 1
            each = 1 / (1 + np.exp(-np.clip(margin / 2, -500, 500)))
            return each / each.sum(axis=1, keepdims=True)
        return margin if self.loss in ("squared", "shares") else probabilities(margin)

    def transform(self, df: DataFrame) -> DataFrame:
        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def made(x: pd.Series) -> pd.Series:
            return pd.Series(list(self.outputs(np.stack(x.to_numpy())))) if len(x) else pd.Series([], dtype=object)

        found = made(vector_to_array("features"))
        if self.loss == "squared":
            return df.withColumn("prediction", F.get(found, F.lit(0)))
        df = df.withColumn("probability", array_to_vector(found))
        shares = vector_to_array("probability")
        return df.withColumn("prediction", (F.array_position(shares, F.array_max(shares)) - 1).cast("double"))

    @property
    def featureImportances(self):  # noqa: N802, the name MLlib's models have
        """Share of each feature in the gain of all splits."""
        total = np.zeros(self.width)
        for trees in self.rounds:
            for t in trees:
                np.add.at(total, t.feature[t.feature >= 0], t.gain[t.feature >= 0])
        return Vectors.dense(total / total.sum() if total.sum() else total)

    def to_json(self) -> str:
        trees = [[t.to_dict() for t in trees] for trees in self.rounds]
        return json.dumps({"loss": self.loss, "base": self.base, "width": self.width, "rounds": trees})

    @staticmethod
    def from_json(text: str) -> BoostedModel:
        d = json.loads(text)
        return BoostedModel(d["loss"], d["base"], [[Tree.from_dict(t) for t in trees] for trees in d["rounds"]], d["width"])


# ---------------------------------------------------------------- blocks of rows


def feature_cuts(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Cut points of every feature, from one pass of mergeable sketches; a feature's sketches meet in two steps.

    A feature with up to SKETCH_SIZE distinct values is known exactly; else ranks are off by at most 3 / SKETCH_SIZE of the rows.
    """

    def pack(f: int, group: int, s: Sketch) -> tuple:
        return f, group, s.values.tobytes(), s.weights.tobytes()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Sketch() for _ in range(width)]
        group = 0
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            group = int(batch.column("row_key").to_numpy(zero_copy_only=False)[0]) % SKETCH_GROUPS if batch.num_rows else group
            held = [s.merge(Sketch.of(x[:, f], np.ones(len(x)))).shrink(SKETCH_SIZE) for f, s in enumerate(held)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*(pack(f, group, s) for f, s in enumerate(held)), strict=True), _SKETCH_KINDS, strict=True)], ["f", "g", "v", "w"])

    def merged(table: pa.Table) -> pa.Table:
        out = Sketch()
        for v, w in zip(table["v"].to_pylist(), table["w"].to_pylist(), strict=True):
            out = out.merge(Sketch(np.frombuffer(v), np.frombuffer(w)))
        f, group = table["f"][0].as_py(), table["g"][0].as_py()
        return pa.Table.from_arrays([pa.array([c], k) for c, k in zip(pack(f, group, out.shrink(SKETCH_SIZE)), _SKETCH_KINDS, strict=True)], ["f", "g", "v", "w"])

    schema = "f int, g int, v binary, w binary"
    made = rows.select("x", "row_key").mapInArrow(sketch, schema)
    made = made.groupBy("f", "g").applyInArrow(merged, schema).withColumn("g", F.lit(0)).groupBy("f").applyInArrow(merged, schema)
    found = {r.f: Sketch(np.frombuffer(r.v), np.frombuffer(r.w)) for r in made.collect()}
    return [found[f].cuts(bins) if f in found else np.zeros(0) for f in range(width)]


_SKETCH_KINDS = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _blocks(rows: DataFrame, cuts: list[np.ndarray], task: _Task) -> tuple[DataFrame, int]:
    """(bins, y, key, n, margin): up to BLOCK_ROWS rows each, in order of their key; and the number of rows in all blocks.

    Rows of the same bins, model and label (squared loss: its mean, as gradients are linear in it) are one row that counts n times.
    One-side sampling draws single rows, so there every row stays.
    """
    width = task.width

    def bin_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, _ = to_bins(_matrix(batch.column("x"), width), cuts)
            cells = pa.Array.from_buffers(pa.binary(width * bins.itemsize), len(bins), [None, pa.py_buffer(bins.tobytes())]).cast(pa.binary())
            key = batch.column("row_key").fill_null(np.iinfo(np.int64).min)
            own = task.own_model(_Block(None, None, key.to_numpy(), None)) if task.settings.style == "ordered" else np.zeros(len(bins), np.int64)
            yield pa.RecordBatch.from_arrays([cells, batch.column("label"), key, pa.array(own.astype(np.int64))], ["bins", "label", "row_key", "own"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches) or [pa.RecordBatch.from_pylist([], _BINNED)])
        for a in range(0, table.num_rows, BLOCK_ROWS):
            part = table.slice(a, BLOCK_ROWS)
            cells = [b"".join(part["bins"].to_pylist()), *(part[c].to_numpy().astype(k).tobytes() for c, k in (("label", np.float64), ("row_key", np.int64), ("n", np.float64)))]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], ["bins", "y", "key", "n"])

    binned = rows.mapInArrow(bin_rows, "bins binary, label double, row_key bigint, own bigint")
    count = task.rows
    if task.settings.top_rate is None:
        same = ["bins", "own"] if task.loss == "squared" else ["bins", "own", "label"]
        label = [F.avg("label").alias("label")] if task.loss == "squared" else []
        # rows of one model have keys of that model, so the smallest key stands for all
        binned = checkpointed(binned.groupBy(*same).agg(*label, F.min("row_key").alias("row_key"), F.count("*").alias("n")))
        count = binned.count()
    else:
        binned = binned.withColumn("n", F.lit(1).cast("bigint"))
    parts = max(1, math.ceil(count / BLOCK_ROWS))
    dealt = binned.select("bins", "label", "row_key", "n").repartition(parts, "row_key").sortWithinPartitions("row_key", "label")
    return checkpointed(dealt.mapInArrow(gather, "bins binary, y binary, key binary, n binary").withColumn("margin", F.lit(b""))), count


_BINNED = pa.schema([("bins", pa.binary()), ("label", pa.float64()), ("row_key", pa.int64()), ("n", pa.int64())])


@dataclass
class _Block:
    bins: np.ndarray
    y: np.ndarray
    key: np.ndarray
    margin: np.ndarray
    n: np.ndarray | float = 1.0  # how often each row counts


@dataclass(frozen=True)
class _Task:
    """What tasks need besides their block."""

    settings: Boosting
    loss: str
    base: tuple[float, ...]
    width: int
    missing: int
    rows: int
    models: int = 1  # margins of each output; ordered boosting keeps one for every prefix of the rows

    def luck(self, block: _Block, salt: int) -> np.ndarray:
        """A number from 0 to 1 for each row, from its key."""
        dice = (block.key.astype(np.uint64) + np.uint64(1 + salt + self.settings.seed)) * _MIX
        dice = (dice ^ (dice >> np.uint64(31))) * _MIX
        dice = (dice ^ (dice >> np.uint64(29))) * _MIX
        return (dice >> np.uint64(11)).astype(np.float64) / 2.0**53

    def threshold(self, counts: np.ndarray) -> float:
        """A gradient size that at least the share top_rate of all rows reaches: the lower edge of a step of ``_size_counts``."""
        if self.settings.top_rate is None:
            return 0.0
        reached = np.cumsum(counts[::-1])[::-1] >= self.settings.top_rate * self.rows
        return 2.0 ** ((int(np.flatnonzero(reached).max(initial=0)) - 1024) / 16)

    def prefixes(self) -> np.ndarray:
        """Model m >= 1 learns from rows whose number is below prefixes[m]; the last one from all. Model 0 never learns."""
        return np.r_[0.0, 0.5 ** np.arange(self.models - 2, -1, -1)]

    def own_model(self, block: _Block) -> np.ndarray:
        """For each row the best model that has not learned from it."""
        return np.searchsorted(self.prefixes(), self.luck(block, 0), "right") - 1

    def leaf_sums(self, block: _Block, tree: Tree) -> np.ndarray:
        """(nodes x outputs x models, 2): gradients and hessians of each model's own rows and margins in each leaf."""
        nodes, outputs = len(tree.feature), len(self.base) // self.models
        leaf, number = tree.apply_bins(block.bins, self.missing), self.luck(block, 0)
        every = block.margin.reshape(len(leaf), outputs, self.models)
        sums = np.zeros((nodes, outputs, self.models, 2))
        often = np.broadcast_to(block.n, len(leaf))
        for m, limit in enumerate(self.prefixes()):
            inside = number < limit
            for c, part in enumerate(gradients(every[inside, :, m], block.y[inside], self.loss)):
                for k in range(outputs):
                    sums[:, k, m, c] = np.bincount(leaf[inside], part[:, k] * often[inside], nodes)
        return sums.reshape(-1, 2)

    def rate(self, number: int) -> float:
        """What a leaf's mean gradient is multiplied by in round ``number``. MLlib's gradients are twice these (half log-odds: four times
        these, and the margin twice the sum of its trees); its first tree is fitted to the labels, or -1 and 1, and counts in full."""
        if self.settings.style == "gradient":
            first, later = (1.0, 2.0) if self.loss == "squared" else (4.0, 8.0)
            return later * self.settings.rate if number else first
        return 1.0 if self.settings.style == "single" else self.settings.rate

    def trees(self, grower: Grower, leaf_sums, number: int) -> list[Tree]:
        """The finished trees of a round; those of ordered boosting hold the leaf values of every model."""
        rate = self.rate(number)
        made = [grower.tree(t, rate) for t in range(grower.count)]
        if self.settings.style != "ordered":
            return made
        sums = leaf_sums(made[0])
        weight = sums[:, 1] + self.settings.growth.ridge
        value = -rate * np.divide(sums[:, 0], weight, out=np.zeros(len(sums)), where=weight > 0)
        return [replace(made[0], value=value.reshape(len(made[0].feature), -1))]

    def open(self, row: dict) -> _Block:
        kind = np.uint8 if self.missing < 256 else np.uint16
        y = np.frombuffer(row["y"])
        margin = np.frombuffer(row["margin"]).reshape(len(y), -1).copy() if row["margin"] else np.tile(np.array(self.base), (len(y), 1))
        return _Block(np.frombuffer(row["bins"], kind).reshape(len(y), self.width), y, np.frombuffer(row["key"], np.int64), margin, np.frombuffer(row["n"]))

    def advance(self, block: _Block, rounds: list[list[Tree]]) -> None:
        """Add the trees that are newer than the block's margins."""
        for trees in rounds:
            for k, tree in enumerate(trees):
                block.margin[:, slice(None) if tree.value.shape[1] > 1 else slice(k, k + 1)] += tree.value[tree.apply_bins(block.bins, self.missing)]

    def channels(self, block: _Block, number: int, threshold: float) -> list[np.ndarray]:
        """For each tree of the round: (rows, outputs + 2) with gradients, hessian and 1, each as often as the row counts; zero for rows that sampling leaves out."""
        often = np.broadcast_to(block.n, len(block.y))[:, None]
        if self.settings.style == "ordered":
            every = block.margin.reshape(len(block.y), -1, self.models)
            g, h = gradients(every[np.arange(len(every)), :, self.own_model(block)], block.y, self.loss)
            return [np.column_stack([g, h.mean(axis=1), np.ones(len(g))]) * often]
        g, h = gradients(block.margin, block.y, self.loss)
        if self.settings.style == "gradient":
            h = np.ones_like(g)
        weight = np.ones(len(g))
        if self.settings.top_rate is not None:
            size = np.abs(g).sum(axis=1)
            luck = self.luck(block, number)
            rest = 1 - self.settings.top_rate
            weight = np.where(size >= threshold, 1.0, np.where(luck < self.settings.other_rate / rest, rest / self.settings.other_rate, 0.0))
        used = (weight > 0).astype(np.float64)
        if self.settings.style == "single":
            return [np.column_stack([g, h[:, :1], used]) * often]
        return [np.column_stack([g[:, k] * weight, h[:, k] * weight, used]) * often for k in range(g.shape[1])]


def _standing(nodes: dict, bins: np.ndarray, missing: int) -> np.ndarray:
    """The deepest known node of every row of a growing tree."""
    at = np.zeros(len(bins), np.int64)
    size = max(nodes) + 1
    feature, cut, to_left, left, right = (np.full(size, -1, np.int64) for _ in range(5))
    for k, node in nodes.items():
        if node.children:
            feature[k], cut[k], to_left[k] = node.split[:3]
            left[k], right[k] = node.children
    rows = np.flatnonzero(feature[at] >= 0)
    while len(rows):
        k = at[rows]
        b = bins[rows, feature[k]]
        at[rows] = np.where(np.where(b == missing, to_left[k] == 1, b <= cut[k]), left[k], right[k])
        rows = rows[feature[at[rows]] >= 0]
    return at


_SIZE_STEPS = 2048


def _size_counts(block: _Block, loss: str) -> np.ndarray:
    """Rows by the logarithm of the size of their gradients."""
    size = np.abs(gradients(block.margin, block.y, loss)[0]).sum(axis=1)
    return np.bincount(np.clip(np.floor(np.log2(np.maximum(size, 1e-300)) * 16) + 1024, 0, _SIZE_STEPS - 1).astype(np.int64), minlength=_SIZE_STEPS)


def idle(trees: list[Tree]) -> bool:
    """Whether these trees change no margin."""
    return all(len(t.feature) == 1 and not t.value.any() for t in trees)


def _local(block: _Block, channels: list[np.ndarray], missing: int):
    def make(nodes: list[dict], wanted: list[tuple[int, int]]) -> list[np.ndarray]:
        out: dict[tuple[int, int], np.ndarray] = {}
        for t in {t for t, _ in wanted}:
            mine = [k for u, k in wanted if u == t]
            code = np.full(max(nodes[t]) + 1, -1)
            code[mine] = np.arange(len(mine))
            found = histograms(block.bins, code[_standing(nodes[t], block.bins, missing)], channels[t], len(mine), missing + 1)
            out |= {(t, k): found[i] for i, k in enumerate(mine)}
        return [out[w] for w in wanted]

    return make


def _bare(nodes: list[dict]) -> list[dict]:
    """Growing trees without their histograms, to be sent to tasks."""
    return [{k: replace(n, histogram=None) for k, n in tree.items()} for tree in nodes]


class _Run:
    """One training run over checkpointed blocks."""

    def __init__(self, blocks: DataFrame, stored: int, task: _Task, cuts: list[np.ndarray], trees: int):
        self.blocks, self.task, self.cuts, self.trees = blocks, task, cuts, trees
        self.single = stored <= BLOCK_ROWS
        self.pending: list[list[Tree]] = []
        self.scanned = 0  # rows added to histograms, over all jobs

    def _map(self, schema: str, handle) -> DataFrame:
        task, pending = self.task, self.pending

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    block = task.open(row)
                    task.advance(block, pending)
                    yield handle(block, row)

        return self.blocks.mapInArrow(run, schema)

    def _threshold(self) -> float:
        task = self.task
        if task.settings.top_rate is None:
            return 0.0

        def handle(block: _Block, row: dict) -> pa.RecordBatch:
            counts = _size_counts(block, task.loss)
            at = np.flatnonzero(counts)
            return pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["step", "n"])

        found = self._map("step long, n long", handle).groupBy("step").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros(_SIZE_STEPS, np.int64)
        for r in found:
            counts[r.step] = r.n
        return task.threshold(counts)

    def _histograms(self, number: int, threshold: float):
        task = self.task
        size, width = task.missing + 1, task.width

        def make(nodes: list[dict], wanted: list[tuple[int, int]]) -> list[np.ndarray]:
            bare = _bare(nodes)

            def handle(block: _Block, row: dict) -> pa.RecordBatch:
                channels = task.channels(block, number, threshold)
                found = np.stack(_local(block, channels, task.missing)(bare, wanted))
                flat = found.reshape(-1, found.shape[-1])
                at = np.flatnonzero(flat.any(axis=1))
                return pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(flat[at, c].copy()) for c in range(flat.shape[1]))], ["slot", *(f"c{c}" for c in range(flat.shape[1]))])

            outputs = len(task.base) // task.models if task.settings.style not in _MANY_TREES else 1
            names = [f"c{c}" for c in range(outputs + 2)]
            sent = self._map("slot long, " + ", ".join(f"{c} double" for c in names), handle)
            table = sent.groupBy("slot").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
            out = np.zeros((len(wanted) * width * size, len(names)))
            out[table["slot"].to_numpy()] = np.stack([table[c].to_numpy() for c in names], axis=1)
            out = out.reshape(len(wanted), width, size, len(names))
            self.scanned += int(out[:, 0, :, -1].sum())
            return list(out)

        return make

    def rounds(self, first: int, count: int) -> list[list[Tree]]:
        """The trees of up to ``count`` rounds from number ``first``; fewer if a round's trees change nothing."""
        task, trees, cuts = self.task, self.trees, self.cuts
        if not self.single:
            grower = Grower(trees, task.settings.growth, cuts)
            grower.grow(self._histograms(first, self._threshold()))
            return [task.trees(grower, self._leaf_sums, first)]

        def handle(block: _Block, row: dict) -> pa.RecordBatch:
            made = []
            for number in range(first, first + count):
                own = Grower(trees, task.settings.growth, cuts)
                own.grow(_local(block, task.channels(block, number, task.threshold(_size_counts(block, task.loss))), task.missing))
                made.append(task.trees(own, lambda tree: task.leaf_sums(block, tree), number))
                if idle(made[-1]):
                    break
                task.advance(block, made[-1:])
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], ["trees"])

        return pickle.loads(self._map("trees binary", handle).collect()[0]["trees"])

    def _leaf_sums(self, tree: Tree) -> np.ndarray:
        task = self.task

        def handle(block: _Block, row: dict) -> pa.RecordBatch:
            flat = task.leaf_sums(block, tree)
            at = np.flatnonzero(flat.any(axis=1))
            return pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at, 0].copy()), pa.array(flat[at, 1].copy())], ["slot", "g", "h"])

        table = self._map("slot long, g double, h double", handle).groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
        sums = np.zeros((len(tree.feature) * len(task.base), 2))
        sums[table["slot"].to_numpy()] = np.stack([table["g"].to_numpy(), table["h"].to_numpy()], axis=1)
        return sums

    def keep(self, made: list[list[Tree]]) -> None:
        """Take these rounds into the margins; they are written once there are KEEP_ROUNDS of them."""
        self.pending += made
        if len(self.pending) >= KEEP_ROUNDS:

            def handle(block: _Block, row: dict) -> pa.RecordBatch:
                cells = [row["bins"], row["y"], row["key"], row["n"], block.margin.tobytes()]
                return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], ["bins", "y", "key", "n", "margin"])

            self.blocks = checkpointed(self._map("bins binary, y binary, key binary, n binary, margin binary", handle))
            self.pending = []


def start(rows: DataFrame, classes: int, settings: Boosting) -> tuple[list[float], str]:
    """(first margin of each output, loss)."""
    if not classes:
        mean = rows.agg(F.avg("label")).first()[0] or 0.0
        return [0.0 if settings.style in ("single", "gradient") else float(mean)], "squared"
    if settings.style == "single":
        return [0.0] * classes, "shares"
    return ([0.0], "logistic") if classes <= 2 else ([0.0] * classes, "rest" if settings.style == "gradient" else "softmax")


class Booster:
    """Estimator with MLlib's ``fit``: reads ``features`` (missing values as NaN), ``label`` and an integer ``row_key``."""

    def __init__(self, problem: str, classes: int, settings: Boosting, key: str = "row_key"):
        self.problem, self.classes, self.settings, self.key = problem, classes if problem == "classification" else 0, settings, key

    def fit(self, train: DataFrame) -> BoostedModel:
        """A model of all rows with a label; an empty table is an error."""
        rows = train.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"), F.col(self.key).cast("bigint").alias("row_key"))
        rows = rows.where(F.col("label").isNotNull())
        about = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("w")).first()
        if not about.n:
            raise LodestatError("no rows to train on")
        base, loss = start(rows, self.classes, self.settings)
        models = 2 + min(PREFIXES, max(about.n, 1).bit_length() - 1) if self.settings.style == "ordered" else 1
        cuts = feature_cuts(rows, about.w, self.settings.bins)
        missing = to_bins(np.zeros((0, about.w)), cuts)[1]
        task = _Task(self.settings, loss, tuple(np.repeat(base, models).tolist()), about.w, missing, about.n, models)
        run = _Run(*_blocks(rows, cuts, task), task, cuts, len(base) if self.settings.style in _MANY_TREES else 1)
        rounds, wanted = [], 1 if self.settings.style == "single" else self.settings.rounds
        while len(rounds) < wanted:
            made = run.rounds(len(rounds), min(KEEP_ROUNDS, wanted - len(rounds)))
            rounds += made
            if idle(made[-1]):
                break
            run.keep(made)
        if self.settings.style == "ordered":  # the last model learned from all rows
            rounds = [[replace(t, value=t.value.reshape(len(t.value), -1, models)[:, :, -1].copy()) for t in trees] for trees in rounds]
        self.scanned = run.scanned
        return BoostedModel(loss, base, rounds, about.w)
