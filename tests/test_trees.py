"""Histogram trees and boosting against plain versions that loop over rows."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from lodestat.ml import boosting, trees
from lodestat.ml.boosting import BoostedModel, Booster, Boosting
from lodestat.ml.trees import Growth, Sketch


def data(n=2000, seed=1, classes=0):
    """Noise, two features that act together, missing values that matter; values on a grid, so that cut points are exact."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 1)
    x[rng.random((n, 4)) < 0.1] = np.nan
    y = np.nan_to_num(x[:, 0]) * np.nan_to_num(x[:, 1]) + 2 * np.isnan(x[:, 2]) + rng.normal(size=n) * 0.3
    return x, np.digitize(y, np.quantile(y, np.arange(1, classes) / classes)).astype(float) if classes else y


@pytest.fixture
def frame(spark):
    def make(x, y):
        rows = [(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
        return spark.createDataFrame(rows, "row_key long, f array<double>, label double").select("row_key", "label", array_to_vector("f").alias("features"))

    return make


def losses(margin, y, classes):
    """(g, h) of one row's margins."""
    if not classes:
        return [margin[0] - y], [1.0]
    if classes == 2:
        p = 1 / (1 + np.exp(-margin[0]))
        return [p - y], [max(p * (1 - p), 1e-16)]
    e = np.exp(margin - max(margin))
    p = e / e.sum()
    return [p[k] - (y == k) for k in range(classes)], [max(2 * p[k] * (1 - p[k]), 1e-16) for k in range(classes)]


def plain_splits(x, g, h, rows, depth, growth):
    """Every split (gain, feature, cut, missing left) of some rows, by trying each cut."""
    def score(r):
        return sum(g[r]) ** 2 / (sum(h[r]) + growth.ridge) if len(r) and sum(h[r]) + growth.ridge > 0 else 0.0

    best = None
    if depth == growth.depth or len(rows) < growth.least_split:
        return None
    for f in range(x.shape[1]):
        v = x[rows, f]
        known = np.unique(x[~np.isnan(x[:, f]), f])
        for cut in [*((known[1:] + known[:-1]) / 2), np.inf]:
            for missing_left in (False, True):
                go = np.where(np.isnan(v), missing_left, v <= cut)
                a, b = rows[go], rows[~go]
                if min(len(a), len(b)) < max(growth.least_rows, 1) or min(h[a].sum(), h[b].sum()) < growth.least_weight:
                    continue
                gain = (score(a) + score(b) - score(rows)) / 2 - growth.least_gain
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                    best = (gain, a, b)
    return best


def plain_tree(x, g, h, growth):
    """Value of every row's leaf; best-first if leaves are limited (then only the order of splits differs)."""
    front = [(np.arange(len(x)), 0)]
    found = [plain_splits(x, g, h, front[0][0], 0, growth)]
    while any(found) and (growth.leaves is None or len(front) < growth.leaves):
        k = max((i for i, s in enumerate(found) if s), key=lambda i: found[i][0])
        _, a, b = found[k]
        depth = front[k][1] + 1
        front[k : k + 1] = [(a, depth), (b, depth)]
        found[k : k + 1] = [plain_splits(x, g, h, r, depth, growth) for r in (a, b)]
    out = np.zeros(len(x))
    for rows, _ in front:
        out[rows] = -sum(g[rows]) / (sum(h[rows]) + growth.ridge)
    return out


def plain_boosting(x, y, classes, rounds, rate, growth):
    k = 1 if classes <= 2 else classes
    margin = np.full((len(x), k), 0.0 if classes else y.mean())
    for _ in range(rounds):
        pairs = [losses(m, t, classes) for m, t in zip(margin, y, strict=True)]
        g, h = (np.array([p[c] for p in pairs]) for c in (0, 1))
        margin = margin + rate * np.stack([plain_tree(x, g[:, j], h[:, j], growth) for j in range(k)], axis=1)
    return margin


DEPTH_WISE = Growth(3, ridge=1.0, least_gain=0.05, least_weight=1.0)
LEAF_WISE = Growth(6, 7, 0.0, 0.0, 1e-3, 20)


@pytest.mark.parametrize("growth", [DEPTH_WISE, LEAF_WISE])
@pytest.mark.parametrize("classes", [0, 2, 3])
def test_boosting_equals_a_plain_version(frame, monkeypatch, classes, growth):
    x, y = data(400, classes=classes)
    want = plain_boosting(x, y, classes, 3, 0.3, growth)
    df = frame(x, y)
    problem = "classification" if classes else "regression"
    whole = Booster(problem, classes, Boosting(rounds=3, rate=0.3, growth=growth)).fit(df)
    assert np.abs(whole.margins(x) - want).max() < 1e-9
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 60)
    monkeypatch.setattr(boosting, "KEEP_ROUNDS", 2)
    parts = Booster(problem, classes, Boosting(rounds=3, rate=0.3, growth=growth)).fit(df)
    assert np.abs(parts.margins(x) - want).max() < 1e-9


def test_only_the_smaller_child_is_scanned(frame, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 500)
    x, y = data()
    booster = Booster("regression", 0, Boosting(rounds=1, growth=Growth(4, ridge=0.0)))
    tree = booster.fit(frame(x, y)).rounds[0][0]
    inner = np.flatnonzero(tree.feature >= 0)
    depth = np.zeros(len(tree.feature), int)
    for k in inner:
        depth[[tree.left[k], tree.right[k]]] = depth[k] + 1
    smaller = sum(min(tree.cover[tree.left[k]], tree.cover[tree.right[k]]) for k in inner if depth[k] < 3)
    assert booster.scanned == 2000 + smaller


def test_one_side_sampling_keeps_large_gradients_and_scales_the_rest(frame, monkeypatch):
    x, y = data()
    found = []
    for block in (1 << 16, 300):
        monkeypatch.setattr(boosting, "BLOCK_ROWS", block)
        found.append(Booster("regression", 0, Boosting(rounds=4, growth=LEAF_WISE, top_rate=0.2, other_rate=0.2)).fit(frame(x, y)))
    assert np.allclose(found[0].margins(x), found[1].margins(x), atol=1e-12)
    cover = found[0].rounds[0][0].cover[0]
    assert 0.2 * 2000 + 0.15 * 2000 < cover < 0.24 * 2000 + 0.25 * 2000


def plain_ordered(x, y, number, models, rounds, rate, ridge, depth):
    """Squared loss: oblivious trees, a model for each prefix; returns every row's margins by all models."""
    limits = [0.0, *(0.5**k for k in range(models - 2, -1, -1))]
    own = [max(m for m in range(models) if limits[m] <= u) for u in number]
    margin = np.full((len(x), models), y.mean())
    for _ in range(rounds):
        g = np.array([margin[i, own[i]] - y[i] for i in range(len(x))])
        leaf = np.zeros(len(x), int)
        for _ in range(depth):
            best = None
            for f in range(x.shape[1]):
                known = np.unique(x[~np.isnan(x[:, f]), f])
                for cut in [*((known[1:] + known[:-1]) / 2), np.inf]:
                    for missing_left in (False, True):
                        go = np.where(np.isnan(x[:, f]), missing_left, x[:, f] <= cut)
                        total = 0.0
                        for k in np.unique(leaf):
                            parts = [g[(leaf == k) & go], g[(leaf == k) & ~go], g[leaf == k]]
                            a, b, c = (p.sum() ** 2 / (len(p) + ridge) for p in parts)
                            total += (a + b - c) / 2
                        if best is None or total > best[0] + 1e-12:
                            best = (total, go)
            if best[0] <= 1e-9:
                break
            leaf = 2 * leaf + ~best[1]
        for m in range(models):
            inside = number < limits[m]
            for k in np.unique(leaf):
                rows = inside & (leaf == k)
                margin[leaf == k, m] -= rate * (margin[rows, m] - y[rows]).sum() / (rows.sum() + ridge)
    return margin, own


def test_ordered_boosting_equals_a_plain_version(frame, monkeypatch):
    x, y = data(250)
    settings = Boosting("ordered", 3, 0.3, Growth(2, ridge=3.0, least_rows=0, oblivious=True))
    task = boosting._Task(settings, "squared", (0.0,), 4, 3, 250, 2 + 7)
    block = boosting._Block(None, y, np.arange(250), None)
    number = task.luck(block, 0)
    want, own = plain_ordered(x, y, number, 9, 3, 0.3, 3.0, 2)
    assert own == task.own_model(block).tolist()
    for rows in (1 << 16, 60):
        monkeypatch.setattr(boosting, "BLOCK_ROWS", rows)
        model = Booster("regression", 0, settings).fit(frame(x, y))
        assert np.abs(model.margins(x)[:, 0] - want[:, -1]).max() < 1e-9
    # the gradient that a row takes part with does not depend on its own label in the first round, nor through its own model later
    row = int(np.argmax(number))
    other = y.copy()
    other[row] += 5
    limits = task.prefixes()
    assert all(number[row] >= limits[m] for m in range(own[row] + 1)) and own[row] == 7


def test_ordered_boosting_of_classes(frame):
    x, y = data(600, classes=3)
    model = Booster("classification", 3, Boosting("ordered", 40, 0.3, Growth(4, ridge=3.0, least_rows=0, oblivious=True))).fit(frame(x, y))
    assert (model.outputs(x).argmax(axis=1) == y).mean() > 0.7 and np.allclose(model.outputs(x).sum(axis=1), 1)


def test_single_tree_learns_a_deep_chain_and_respects_the_least_split(frame, monkeypatch):
    x = np.arange(41.0)[:, None]
    y = 2.5 ** np.arange(41)  # the largest value is parted from the rest again and again
    for rows in (1 << 16, 10):
        monkeypatch.setattr(boosting, "BLOCK_ROWS", rows)
        tree = Booster("regression", 0, Boosting("single", growth=Growth(None, ridge=0.0))).fit(frame(x, y)).rounds[0][0]
        depth = np.zeros(len(tree.feature), int)
        for k in np.flatnonzero(tree.feature >= 0):
            depth[[tree.left[k], tree.right[k]]] = depth[k] + 1
        assert depth.max() >= 38 and np.allclose(tree.value[tree.apply(x), 0], y, rtol=1e-3)
    small = frame(np.arange(9.0)[:, None], np.arange(9.0))
    assert len(Booster("regression", 0, Boosting("single", growth=Growth(None, ridge=0.0, least_split=10))).fit(small).rounds[0][0].feature) == 1
    more = frame(np.arange(10.0)[:, None], np.arange(10.0))
    assert len(Booster("regression", 0, Boosting("single", growth=Growth(None, ridge=0.0, least_split=10))).fit(more).rounds[0][0].feature) == 3


def test_class_shares_of_a_single_tree_and_saved_text(frame):
    x, y = data(500, classes=3)
    model = Booster("classification", 3, Boosting("single", growth=Growth(4, ridge=0.0, least_split=10))).fit(frame(x, y))
    leaf = model.rounds[0][0].apply(x)
    for k in np.unique(leaf):
        assert np.allclose(model.outputs(x[leaf == k])[0], [(y[leaf == k] == c).mean() for c in range(3)])
    again = BoostedModel.from_json(model.to_json())
    assert np.array_equal(again.outputs(x), model.outputs(x))
    assert np.isclose(model.featureImportances.toArray().sum(), 1)


def test_edges(frame):
    none = np.full((5, 2), np.nan)
    model = Booster("regression", 0, Boosting(rounds=3)).fit(frame(none, np.arange(5.0)))
    assert np.allclose(model.margins(none), 2.0)
    with pytest.raises(boosting.LodestatError):
        Booster("regression", 0, Boosting()).fit(frame(none, np.arange(5.0)).where("false"))
    one = Booster("classification", 2, Boosting(rounds=3)).fit(frame(np.ones((4, 1)), np.ones(4)))
    assert (one.outputs(np.ones((2, 1)))[:, 1] > 0.5).all()
    missing = np.array([[1.0], [2.0], [np.nan], [np.nan]] * 20)
    parted = Booster("regression", 0, Boosting(rounds=60, rate=0.5)).fit(frame(missing, np.isnan(missing[:, 0]).astype(float)))
    assert np.allclose(parted.margins(missing)[:, 0], np.isnan(missing[:, 0]), atol=1e-3)


def test_sketches_keep_ranks_within_their_error():
    rng = np.random.default_rng(2)
    v = rng.lognormal(size=40_000)
    total = Sketch()
    for part in np.array_split(v, 23):
        total = total.merge(Sketch.of(part, np.ones(len(part)))).shrink(512)
    assert total.weights.sum() == len(v) and len(total.values) <= 512
    cuts = total.cuts(64)
    ranks = np.searchsorted(np.sort(v), cuts) / len(v)
    assert len(cuts) == 63 and np.abs(np.diff(np.r_[0, ranks]) - 1 / 63.5).max() < 24 / 512
    few = Sketch.of(np.array([1.0, 2.0, 2.0, np.nan, 5.0]), np.ones(5))
    assert few.cuts().tolist() == [1.5, 3.5] and Sketch().cuts().tolist() == []
    bins, missing = trees.to_bins(np.array([[1.0], [1.5], [1.6], [9.0], [np.nan]]), [few.cuts()])
    assert bins[:, 0].tolist() == [0, 0, 1, 2, missing] and missing == 4


@pytest.mark.parametrize("style", ["newton", "ordered", "single"])
@pytest.mark.parametrize("classes", [0, 2, 3])
def test_rows_of_the_same_bins_are_kept_once(frame, monkeypatch, style, classes):
    x, y = data(600, classes=classes)
    x = np.round(x[:, :2])  # a few dozen different rows
    growth = Growth(3, ridge=3.0, least_rows=0, oblivious=True) if style == "ordered" else Growth(3, ridge=1.0, least_split=10)
    settings = Boosting(style, 4, 0.3, growth)
    problem = "classification" if classes else "regression"
    stored = []

    class Seen(boosting._Run):
        def __init__(self, blocks, *more):
            stored.append(sum(len(r.y) // 8 for r in blocks.select("y").collect()))
            super().__init__(blocks, *more)

    monkeypatch.setattr(boosting, "_Run", Seen)
    few = Booster(problem, classes, settings).fit(frame(x, y))
    assert stored[0] < 600
    # sampling that takes every row keeps all rows apart
    apart = Booster(problem, classes, replace(settings, top_rate=1 - 1e-9)).fit(frame(x, y))
    assert stored[1] == 600 and np.allclose(apart.margins(x), few.margins(x), atol=1e-9)
    for one, other in zip(few.rounds, apart.rounds, strict=True):
        assert [t.cover.tolist() for t in one] == [t.cover.tolist() for t in other]
