"""Shapley values: path-dependent ones of trees by polynomials over each path, kernel regression for any other model."""

from __future__ import annotations

import itertools
import json
import math
import random
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.errors import LodestatError
from lodestat.functions.columns import named
from lodestat.ml.boosting import BoostedModel
from lodestat.ml.trees import Tree
from lodestat.session import shared_folder


def path_weights(m: int) -> np.ndarray:
    """Shapley weight of a coalition of k of the m - 1 other players."""
    return np.array([1 / (m * math.comb(m - 1, k)) for k in range(m)])


def tree_values(tree: Tree, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(values (rows, features, outputs), base (outputs)) of one tree, absent features being averaged by the nodes' training rows.

    A leaf's part in coalition S is its value times one factor for each feature of its path: whether the row meets the path's conditions
    on it if it is in S, else the share of training rows that do. So the sums over coalitions are coefficients of a product of linear
    polynomials, one for each feature of the path.
    """
    phi = np.zeros((len(x), width, tree.value.shape[1]))
    base = np.zeros(tree.value.shape[1])
    stack: list[tuple[int, dict[int, tuple[np.ndarray, float]]]] = [(0, {})]
    while stack:
        k, path = stack.pop()
        f = int(tree.feature[k])
        if f >= 0:
            v = x[:, f]
            left = np.where(np.isnan(v), tree.missing_left[k], v <= tree.threshold[k])
            for child, meets in ((int(tree.left[k]), left), (int(tree.right[k]), ~left)):
                if tree.cover[child] > 0:
                    before, share = path.get(f, (np.ones(len(x), bool), 1.0))
                    stack.append((child, {**path, f: (before & meets, share * tree.cover[child] / tree.cover[k])}))
            continue
        names, m = list(path), len(path)
        base += tree.value[k] * math.prod(share for _, share in path.values())
        if not m:
            continue
        poly = np.zeros((len(x), m + 1))
        poly[:, 0] = 1.0
        for j, f in enumerate(names):
            meets, share = path[f]
            poly[:, 1 : j + 2] = share * poly[:, 1 : j + 2] + meets[:, None] * poly[:, : j + 1]
            poly[:, 0] *= share
        weights = path_weights(m)
        for f in names:
            meets, share = path[f]
            # the product without f: divided by share + t where the row meets its conditions, else by share
            rest = np.zeros((len(x), m))
            rest[:, m - 1] = poly[:, m]
            for d in range(m - 2, -1, -1):
                rest[:, d] = poly[:, d + 1] - share * rest[:, d + 1]
            rest = np.where(meets[:, None], rest, poly[:, :m] / share)
            phi[:, f] += ((meets - share) * (rest @ weights))[:, None] * tree.value[k]
    return phi, base


def forest_values(trees: list[list[Tree]], start: list[float], x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sum over rounds of trees; a tree of one output adds to the output of its place in the round."""
    base = np.array(start, float)
    phi = np.zeros((len(x), width, len(base)))
    for one in trees:
        for k, tree in enumerate(one):
            part, level = tree_values(tree, x, width)
            at = slice(None) if tree.value.shape[1] > 1 or len(base) == 1 else slice(k, k + 1)
            phi[:, :, at] += part
            base[at] += level
    return phi, base


def trees_of(model) -> tuple[list[list[Tree]], list[float]]:
    """(trees, first margins) of a boosted model, or of an MLlib tree model from the node table that it is saved as.

    Values are class shares for trees and forests of classes, margins for boosted classes, else predictions. Splits on categories are
    not supported.
    """
    if isinstance(model, BoostedModel):
        return model.rounds, model.base
    if not (hasattr(model, "featureImportances") and hasattr(model, "save")):
        raise LodestatError(f"{type(model).__name__} has no trees")
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    folder = f"{shared_folder(spark)}/trees-{uuid.uuid4().hex}"
    PipelineModel(stages=[model]).save(folder)
    stage = f"{folder}/stages/*"
    many = hasattr(model, "treeWeights")
    table = spark.read.parquet(f"{stage}/data")
    rows = table.select("treeID", "nodeData.*") if many else table.withColumn("treeID", F.lit(0))
    found: dict[int, dict[int, object]] = {}
    for r in rows.collect():
        found.setdefault(r.treeID, {})[r.id] = r
    forest = many and hasattr(model, "trees") and type(model).__name__.startswith("RandomForest")
    weights = [1 / len(found)] * len(found) if forest else list(model.treeWeights) if many else [1.0]
    shares = getattr(model, "numClasses", 0) and not type(model).__name__.startswith("GBT")
    doubled = type(model).__name__ == "GBTClassificationModel"  # MLlib's log-odds are twice the sum of its trees
    out = []
    for number, nodes in sorted(found.items()):
        out.append([_from_nodes(nodes, weights[number] * (2 if doubled else 1), shares)])
    return out, [0.0] * (int(model.numClasses) if shares else 1)


def _from_nodes(nodes: dict[int, object], weight: float, shares: bool) -> Tree:
    order = [0]
    place: dict[int, int] = {}
    for k in order:
        place[k] = len(place)
        if nodes[k].leftChild >= 0:
            order += [nodes[k].leftChild, nodes[k].rightChild]
    inner = [nodes[k].leftChild >= 0 for k in order]
    if any(i and nodes[k].split.numCategories > 0 for i, k in zip(inner, order, strict=True)):
        raise LodestatError("splits on categories are not supported")
    values = [np.array(nodes[k].impurityStats) / sum(nodes[k].impurityStats) if shares else np.array([nodes[k].prediction]) for k in order]
    return Tree(
        np.array([nodes[k].split.featureIndex if i else -1 for i, k in zip(inner, order, strict=True)], np.int32),
        np.array([nodes[k].split.leftCategoriesOrThreshold[0] if i else np.nan for i, k in zip(inner, order, strict=True)]),
        np.full(len(order), -1, np.int32),
        np.zeros(len(order), bool),
        np.array([place[nodes[k].leftChild] if i else -1 for i, k in zip(inner, order, strict=True)], np.int32),
        np.array([place[nodes[k].rightChild] if i else -1 for i, k in zip(inner, order, strict=True)], np.int32),
        np.stack(values) * weight,
        np.array([float(nodes[k].rawCount) for k in order]),
        np.array([max(nodes[k].gain, 0.0) if i else 0.0 for i, k in zip(inner, order, strict=True)]),
    )


def tree_shap(rows: DataFrame, model, features: list[str], keys: list[str], output: int | str = 0) -> DataFrame:
    """(keys, feature, value, phi, base_value, output) of every row of ``rows``, which carries the vector ``features``; one Arrow pass.

    ``output`` numbers the class, or "largest" for the one that the trees favour in each row (the predicted class; of the single margin
    of two classes, its class 1). The values of a row and its base sum to the model's output.
    """
    trees, start = trees_of(model)
    schema = T.StructType([rows.schema[k] for k in keys])
    for name, kind in (("feature", T.StringType()), ("value", T.DoubleType()), ("phi", T.DoubleType()), ("base_value", T.DoubleType()), ("output", T.IntegerType())):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                n, width = part.num_rows, len(features)
                x = part.column("x_").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, width)
                phi, base = forest_values(trees, start, x, width)
                total = base + phi.sum(axis=1)
                chosen = total.argmax(axis=1) if output == "largest" else np.full(n, output)
                each = np.repeat(np.arange(n), width)
                cells = [part.column(k).take(pa.array(each)) for k in keys]
                own = phi[np.arange(n), :, chosen]
                cells += [pa.array(features * n), pa.array(x.ravel()), pa.array(own.ravel()), pa.array(base[chosen][each]), pa.array(chosen[each].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cells, schema.names)

    return rows.select(*[named(k) for k in keys], vector_to_array("features").alias("x_")).mapInArrow(run, schema)


def kernel_plan(m: int, samples: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(coalitions (c, m), solution (m, c)): values are solution @ outputs of the coalitions, the first being empty and the last full.

    All coalitions if there are at most ``samples``, else distinct ones drawn by the Shapley kernel, each with its complement. The weighted
    least squares problem keeps the values' sum equal to full minus empty.
    """
    if 2**m - 2 <= samples:
        inner = [c for c in itertools.product((0, 1), repeat=m) if 0 < sum(c) < m]
        weight = [(m - 1) / (math.comb(m, sum(c)) * sum(c) * (m - sum(c))) for c in inner]
    else:
        draw, chance = random.Random(seed), [(m - 1) / (k * (m - k)) for k in range(1, m)]
        drawn: dict[tuple[int, ...], float] = {}
        while len(drawn) < samples:
            inside = set(draw.sample(range(m), draw.choices(range(1, m), chance)[0]))
            for c in (tuple(int(i in inside) for i in range(m)), tuple(int(i not in inside) for i in range(m))):
                drawn[c] = drawn.get(c, 0) + 1
        inner, weight = list(drawn), list(drawn.values())
    z = np.array([*inner], float).reshape(-1, m)
    w = np.array(weight, float)
    b = np.zeros((m, len(z)))
    if m > 1:
        d = z[:, :-1] - z[:, -1:]
        b[:-1] = np.linalg.lstsq((d * w[:, None]).T @ d, (d * w[:, None]).T, rcond=None)[0]
        b[-1] = -b[:-1].sum(axis=0)
    last = b @ z[:, -1]
    full = -last
    full[-1] += 1
    empty = -b.sum(axis=1) + last
    empty[-1] -= 1
    return np.vstack([np.zeros(m), z, np.ones(m)]), np.column_stack([empty, b, full])


def kernel_shap(
    rows: DataFrame, sample: DataFrame, score: Callable[[DataFrame], DataFrame], features: list[str], keys: list[str], samples: int = 100, seed: int = 42
) -> DataFrame:
    """(keys, feature, value, phi, base_value) of any model, by weighted least squares over coalitions (Lundberg and Lee 2017).

    ``rows`` and ``sample`` carry a vector ``features``; ``score`` adds a double ``output`` to such a table. Features outside a coalition
    come from each row of ``sample`` in turn, which is collected and must be small (its size is the caller's choice). The table scored has
    rows x coalitions x sample rows. As the coalitions are the same for all rows, the regression is a fixed weighted sum of their
    outputs, added up by Spark. A row's values sum to its output minus the mean output of the sample.
    """
    m = len(features)
    masks, solution = kernel_plan(m, samples, seed)
    donors = [list(map(float, r["x"])) for r in sample.select(vector_to_array("features").alias("x")).collect()]
    plan = [{"mask": list(map(int, c)), "w": (solution[:, k] / len(donors)).tolist(), "e": (1 if k == 0 else 0) / len(donors), "donor": d} for k, c in enumerate(masks) for d in donors]
    given = F.from_json(F.lit(json.dumps(plan)), "array<struct<mask:array<int>,w:array<double>,e:double,donor:array<double>>>")
    each = rows.select(*[named(k) for k in keys], vector_to_array("features").alias("x")).withColumn("plan", F.explode(given))
    mixed = F.transform(F.arrays_zip(F.col("x").alias("x"), F.col("plan.donor").alias("d"), F.col("plan.mask").alias("m")), lambda t: F.when(t["m"] == 1, t["x"]).otherwise(t["d"]))
    scored = score(each.select(*[named(k) for k in keys], "x", "plan.w", "plan.e", array_to_vector(mixed).alias("features")))
    sums = [F.sum(F.get("w", F.lit(i)) * F.col("output")).alias(f"phi{i}") for i in range(m)]
    found = scored.groupBy(*[named(k) for k in keys], "x").agg(F.sum(F.col("e") * F.col("output")).alias("base_value"), *sums)
    parts = F.array(*[F.struct(F.lit(f).alias("feature"), F.get("x", F.lit(i)).alias("value"), F.col(f"phi{i}").alias("phi")) for i, f in enumerate(features)])
    return found.select(*[named(k) for k in keys], "base_value", F.inline(parts)).select(*[named(k) for k in keys], "feature", "value", "phi", "base_value")
