"""Histogram trees: cut points from mergeable sketches, second-order gains, depth-wise, leaf-wise and oblivious growth."""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np

#: Values of a feature fall into at most so many bins; one more bin holds missing values.
MAX_BINS = 254


@dataclass
class Tree:
    """Nodes as arrays; node 0 is the root, children follow their parent. A row goes left if x <= threshold; missing as ``missing_left``."""

    feature: np.ndarray  # -1 for a leaf
    threshold: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray  # (nodes, outputs)
    cover: np.ndarray  # training rows of each node
    gain: np.ndarray

    def leaves_of(self, go_left: Callable[[np.ndarray, np.ndarray], np.ndarray], n: int) -> np.ndarray:
        """The leaf of each of n rows; ``go_left(rows, nodes)`` decides for rows standing at inner nodes."""
        at = np.zeros(n, np.int32)
        rows = np.flatnonzero(self.feature[at] >= 0)
        while len(rows):
            nodes = at[rows]
            at[rows] = np.where(go_left(rows, nodes), self.left[nodes], self.right[nodes])
            rows = rows[self.feature[at[rows]] >= 0]
        return at

    def apply(self, x: np.ndarray) -> np.ndarray:
        def go_left(rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
            v = x[rows, self.feature[nodes]]
            return np.where(np.isnan(v), self.missing_left[nodes], v <= self.threshold[nodes])

        return self.leaves_of(go_left, len(x))

    def apply_bins(self, bins: np.ndarray, missing: int) -> np.ndarray:
        def go_left(rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
            b = bins[rows, self.feature[nodes]]
            return np.where(b == missing, self.missing_left[nodes], b <= self.bin[nodes])

        return self.leaves_of(go_left, len(bins))

    def to_dict(self) -> dict:
        return {k: v.tolist() for k, v in asdict(self).items()}

    @staticmethod
    def from_dict(d: dict) -> Tree:
        kinds = {"feature": np.int32, "bin": np.int32, "left": np.int32, "right": np.int32, "missing_left": bool}
        return Tree(**{k: np.array(v, kinds.get(k, np.float64)) for k, v in d.items()})


@dataclass(frozen=True)
class Growth:
    """When and how nodes are split; the gain is half of score(left) + score(right) - score(node), score being |G|^2 / (H + ridge)."""

    depth: int | None = 6
    leaves: int | None = None  # best-first growth stops at so many
    ridge: float = 1.0
    least_gain: float = 0.0
    least_weight: float = 0.0  # of the hessian sum of a child
    least_rows: int = 1  # of a child
    least_split: int = 2  # rows of a node that is split
    oblivious: bool = False  # one split for a whole level


@dataclass
class _Node:
    depth: int
    sums: np.ndarray  # (outputs + 2,): gradients, hessian, rows
    histogram: np.ndarray | None = None  # (features, bins, outputs + 2)
    split: tuple[int, int, bool, float, np.ndarray] | None = None  # feature, bin, missing left, gain, sums of the left child
    children: tuple[int, int] | None = None


def histograms(bins: np.ndarray, node: np.ndarray, channels: np.ndarray, nodes: int, size: int) -> np.ndarray:
    """(nodes, features, size, channels): sums of each channel of the rows with 0 <= node < nodes."""
    inside = node >= 0
    bins, node, channels = bins[inside], node[inside], channels[inside]
    out = np.zeros((nodes, bins.shape[1], size, channels.shape[1]))
    base = node.astype(np.int64) * size
    for f in range(bins.shape[1]):
        key = base + bins[:, f]
        for c in range(channels.shape[1]):
            out[:, f, :, c] = np.bincount(key, channels[:, c], nodes * size).reshape(nodes, size)
    return out


def score(sums: np.ndarray, ridge: float) -> np.ndarray:
    weight = sums[..., -2] + ridge
    return np.divide((sums[..., :-2] ** 2).sum(axis=-1), weight, out=np.zeros_like(weight), where=weight > 0)


def gains(histogram: np.ndarray, sums: np.ndarray, growth: Growth) -> tuple[np.ndarray, np.ndarray]:
    """(gain, sums of the left child) of every split (feature, bin, missing values left) of one node; impossible ones have -inf."""
    below = np.cumsum(histogram[:, :-1], axis=1)[:, :-1]
    left = np.stack([below, below + histogram[:, -1:, :]], axis=2)
    right = sums - left
    gain = (score(left, growth.ridge) + score(right, growth.ridge) - score(sums, growth.ridge)) / 2 - growth.least_gain
    fine = (left[..., -1] >= growth.least_rows) & (right[..., -1] >= growth.least_rows)
    fine &= (left[..., -2] >= growth.least_weight) & (right[..., -2] >= growth.least_weight)
    return np.where(fine, gain, -np.inf), left


def best_split(node: _Node, growth: Growth) -> tuple[int, int, bool, float, np.ndarray] | None:
    """The split of the largest gain; of equal ones that of the first feature and bin, missing values right."""
    if (growth.depth is not None and node.depth >= growth.depth) or node.sums[-1] < growth.least_split or node.histogram.shape[1] < 3:
        return None
    gain, left = gains(node.histogram, node.sums, growth)
    # sums of the same rows in another order differ by rounding errors of this size: such gains are equal, or 0
    noise = 1e-12 * max(1.0, abs(score(node.sums, growth.ridge)))
    at = np.unravel_index(np.argmax(gain >= gain.max() - noise), gain.shape)
    return (int(at[0]), int(at[1]), bool(at[2]), float(gain[at]), left[at]) if gain[at] > noise else None


HistogramsOf = Callable[[list[dict[int, _Node]], list[tuple[int, int]]], list[np.ndarray]]


class Grower:
    """Grows ``count`` trees side by side from histograms that a callable makes of requested nodes.

    Of two children only the one with fewer rows is requested; the other's histogram is its parent's minus that one.
    """

    def __init__(self, count: int, growth: Growth, cuts: list[np.ndarray]):
        self.count, self.growth, self.cuts = count, growth, cuts
        self.nodes: list[dict[int, _Node]] = [{} for _ in range(count)]

    def _ask(self, make: HistogramsOf, wanted: list[tuple[int, int]]) -> None:
        for (t, k), found in zip(wanted, make(self.nodes, wanted), strict=True):
            node = self.nodes[t][k]
            node.histogram = found
            if k == 0:
                node.sums = found[0].sum(axis=0)

    def _divide(self, t: int, k: int, split: tuple) -> tuple[int, int, int]:
        """Give node k its children; returns (tree, smaller child, larger child)."""
        node, nodes = self.nodes[t][k], self.nodes[t]
        a, b = len(nodes), len(nodes) + 1
        nodes[a], nodes[b] = _Node(node.depth + 1, split[4]), _Node(node.depth + 1, node.sums - split[4])
        node.split, node.children = split, (a, b)
        return (t, a, b) if nodes[a].sums[-1] <= nodes[b].sums[-1] else (t, b, a)

    def _derive(self, t: int, parent: int, small: int, large: int) -> None:
        nodes = self.nodes[t]
        nodes[large].histogram = nodes[parent].histogram - nodes[small].histogram
        nodes[parent].histogram = None

    def _expand(self, make: HistogramsOf, wanted: list[tuple[int, int, tuple]]) -> list[tuple[int, int]]:
        made = [(*self._divide(t, k, split), k) for t, k, split in wanted]
        deepest = self.growth.depth
        open_ones = [m for m in made if deepest is None or self.nodes[m[0]][m[1]].depth < deepest]
        if open_ones:
            self._ask(make, [(t, small) for t, small, _, _ in open_ones])
        for t, small, large, parent in open_ones:
            self._derive(t, parent, small, large)
        return [(t, child) for t, small, large, _ in open_ones for child in (small, large)]

    def grow(self, make: HistogramsOf) -> list[dict[int, _Node]]:
        for t in range(self.count):
            self.nodes[t][0] = _Node(0, np.zeros(0))
        self._ask(make, [(t, 0) for t in range(self.count)])
        if self.growth.oblivious:
            self._oblivious(make)
        else:
            self._free(make)
        return self.nodes

    def _free(self, make: HistogramsOf) -> None:
        """Every node that may be split gets its split, level by level; leaf-wise growth then keeps the best ones (``kept``).

        With a limit on leaves a level's nodes beyond it in gain are not divided before better ones are known to be used up.
        """
        front = [(t, 0) for t in range(self.count)]
        waiting: list[list[tuple[float, int, tuple]]] = [[] for _ in range(self.count)]
        while True:
            for t, k in front:
                split = best_split(self.nodes[t][k], self.growth)
                if split:
                    heapq.heappush(waiting[t], (-split[3], k, split))
                else:
                    self.nodes[t][k].histogram = None
            wanted = []
            for t in range(self.count):
                limit = self.growth.leaves
                # of all candidates only the best (limit - 1 - sure splits) can be reached
                room = len(waiting[t]) if limit is None else limit - 1 - self._sure(t, waiting[t])
                for _ in range(min(max(room, 0), len(waiting[t]))):
                    _, k, split = heapq.heappop(waiting[t])
                    wanted.append((t, k, split))
            if not wanted:
                return
            front = self._expand(make, wanted)

    def _sure(self, t: int, waiting: list) -> int:
        """Splits already made that best-first growth takes before any waiting one."""
        best = -waiting[0][0] if waiting else -np.inf
        taken, heap = 0, [(-self.nodes[t][0].split[3], 0)] if self.nodes[t][0].split else []
        while heap and -heap[0][0] >= best:
            _, k = heapq.heappop(heap)
            taken += 1
            for child in self.nodes[t][k].children:
                if self.nodes[t][child].split:
                    heapq.heappush(heap, (-self.nodes[t][child].split[3], child))
        return taken

    def _oblivious(self, make: HistogramsOf) -> None:
        front = [(t, 0) for t in range(self.count)]
        for _ in range(self.growth.depth):
            wanted = []
            for t in range(self.count):
                level = [k for u, k in front if u == t]
                if not level or self.nodes[t][level[0]].histogram.shape[1] < 3:
                    continue
                free = Growth(ridge=self.growth.ridge, least_rows=0)
                total = sum(np.where(np.isfinite(g := gains(self.nodes[t][k].histogram, self.nodes[t][k].sums, free)[0]), g, 0) for k in level)
                noise = 1e-12 * max(1.0, sum(abs(score(self.nodes[t][k].sums, self.growth.ridge)) for k in level))
                at = np.unravel_index(np.argmax(total >= total.max() - noise), total.shape)
                if total[at] > noise:
                    for k in level:
                        left = gains(self.nodes[t][k].histogram, self.nodes[t][k].sums, free)[1][at]
                        wanted.append((t, k, (int(at[0]), int(at[1]), bool(at[2]), float(total[at]), left)))
            if not wanted:
                return
            front = self._expand(make, wanted)

    def kept(self, t: int) -> set[int]:
        """Inner nodes of the finished tree: all that were split, or the first of them in order of gain if leaves are limited."""
        nodes = self.nodes[t]
        limit = self.growth.leaves
        out: set[int] = set()
        heap = [(-nodes[0].split[3], 0)] if nodes[0].split else []
        while heap and (limit is None or len(out) < limit - 1):
            _, k = heapq.heappop(heap)
            out.add(k)
            for child in nodes[k].children:
                if nodes[child].split:
                    heapq.heappush(heap, (-nodes[child].split[3], child))
        return out

    def tree(self, t: int, rate: float, inner: set[int] | None = None) -> Tree:
        """The tree with leaf values -rate * G / (H + ridge); ``inner`` are its inner nodes, by default ``kept``."""
        inner = self.kept(t) if inner is None else inner
        nodes, order, place = self.nodes[t], [0], {}
        for k in order:
            place[k] = len(place)
            if k in inner:
                order += nodes[k].children
        n = len(order)
        splits = [nodes[k].split if k in inner else None for k in order]
        sums = np.stack([nodes[k].sums for k in order])
        weight = sums[:, -2:-1] + self.growth.ridge
        value = -rate * np.divide(sums[:, :-2], weight, out=np.zeros((n, sums.shape[1] - 2)), where=weight > 0)
        return Tree(
            np.array([s[0] if s else -1 for s in splits], np.int32),
            np.array([self.cuts[s[0]][s[1]] if s and s[1] < len(self.cuts[s[0]]) else np.inf if s else np.nan for s in splits]),
            np.array([s[1] if s else -1 for s in splits], np.int32),
            np.array([s[2] if s else False for s in splits], bool),
            np.array([place[nodes[k].children[0]] if k in inner else -1 for k in order], np.int32),
            np.array([place[nodes[k].children[1]] if k in inner else -1 for k in order], np.int32),
            value,
            sums[:, -1].copy(),
            np.array([s[3] if s else 0.0 for s in splits]),
        )


# ---------------------------------------------------------------- cut points


@dataclass
class Sketch:
    """Distinct values with weights. Merging and shrinking keep every rank within the shrunk weight / size of the truth."""

    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @staticmethod
    def of(values: np.ndarray, weights: np.ndarray) -> Sketch:
        known = ~np.isnan(values)
        names, at = np.unique(values[known], return_inverse=True)
        return Sketch(names, np.bincount(at, weights[known], len(names)))

    def merge(self, other: Sketch) -> Sketch:
        return Sketch.of(np.concatenate([self.values, other.values]), np.concatenate([self.weights, other.weights]))

    def shrink(self, size: int) -> Sketch:
        """At most ``size`` values, the smallest and the largest among them; weights go to the next kept value."""
        if len(self.values) <= size:
            return self
        sums = np.cumsum(self.weights)
        ends = np.searchsorted(sums, sums[-1] * np.arange(1, size) / (size - 1) * (1 - 1e-12))
        ends = np.unique(np.r_[0, ends, len(sums) - 1])
        return Sketch(self.values[ends], np.diff(np.r_[0, sums[ends]]))

    def cuts(self, bins: int = MAX_BINS) -> np.ndarray:
        """At most bins - 1 points between values that divide the weight evenly."""
        kept = self.shrink(bins).values if len(self.values) > bins else self.values
        if len(kept) < 2:
            return np.zeros(0)
        after = self.values[np.searchsorted(self.values, kept[:-1]) + 1]
        middle = kept[:-1] + (after - kept[:-1]) / 2
        return np.where((middle < after) & np.isfinite(middle), middle, kept[:-1])


def to_bins(x: np.ndarray, cuts: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """(bin of every value, the bin of missing values); the same number of bins for every feature."""
    missing = max((len(c) for c in cuts), default=0) + 2  # one empty bin between, so that values can be parted from missing ones
    out = np.empty(x.shape, np.uint8 if missing < 256 else np.uint16)
    for f, c in enumerate(cuts):
        out[:, f] = np.where(np.isnan(x[:, f]), missing, np.searchsorted(c, x[:, f], "left"))
    return out, missing
