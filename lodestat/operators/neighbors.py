"""Exact k-nearest-neighbour join and the classifier and regressor built on it.

Pivot-based join after Lu et al., "Efficient Processing of k Nearest Neighbor Joins using
MapReduce" (VLDB 2012). Equal vectors are compared once: of equal train rows only the k smallest
keys can be neighbours, and equal test rows share one search. Train vectors belong to the cell of
their nearest pivot; there are more pivots in a larger table. The distances of a cell's first
vectors to their pivot bound the k-th neighbour distance of a test vector, and neighbouring cells
form groups of bounded size, to which only test vectors go that may find a neighbour in one of the
group's cells (triangle inequality). A task compares one bounded block of test vectors with one
bounded block of train vectors and returns k rows per test vector, never the pairs it looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions.columns import ratio
from lodestat.operators.charts import hash_sample
from lodestat.session import checkpointed

PIVOTS = 32
BLOCK_ROWS = 8192
#: A table is cut into about so many blocks of more than ``block_rows`` rows, as a row is sent once for each block of the other table.
BLOCKS = 16
#: Numbers in the largest block (32 MB), and distances that are held at a time.
BLOCK_CELLS, HELD = 1 << 22, 1 << 21
GROUPS = 1024


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all rows of b."""
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a column as rows; a missing vector, or one of another length, is an error."""
    if column.null_count:
        raise ValueError("a vector is missing")
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("vectors differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _slices(batches: Iterator[pa.RecordBatch], per_row: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batches of which each needs at most HELD numbers, at so many for a row."""
    size = max(1, HELD // max(1, per_row))
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


def _assign(df: DataFrame, pivots: np.ndarray, schema: str) -> DataFrame:
    """Add the nearest pivot (cell) and the distance to it."""

    def run(batches):
        for batch in _slices(batches, len(pivots)):
            found = _distances(_matrix(batch.column("x")), pivots)
            cell = found.argmin(1)
            made = [pa.array(cell.astype("int32")), pa.array(found[np.arange(len(cell)), cell])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "cell", "reach"])

    return df.mapInArrow(run, schema)


def _route(points: DataFrame, pivots: np.ndarray, radius: np.ndarray, first: list[list[float]], group: np.ndarray, k: int) -> DataFrame:
    """One row per test vector and group of cells that may hold one of its k nearest train rows."""
    owner = np.concatenate([np.full(len(f), j) for j, f in enumerate(first)]).astype(int)
    offset = np.concatenate([np.asarray(f, dtype=float) for f in first])
    filled = np.array([len(f) > 0 for f in first])
    kth = min(k, len(offset)) - 1
    groups = int(group.max()) + 1

    def run(batches):
        for batch in _slices(batches, len(offset)):
            found = _distances(_matrix(batch.column("x")), pivots)
            bound = np.partition(found[:, owner] + offset, kth, axis=1)[:, kth]
            # slack for rounding: a cell too many costs time, a cell too few would cost a neighbour
            slack = 1e-6 * (1 + np.abs(bound))
            row, cell = np.nonzero((found - radius <= (bound + slack)[:, None]) & filled)
            wanted = np.zeros((len(found), groups), bool)
            wanted[row, group[cell]] = True
            row, part = np.nonzero(wanted)
            sent = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*sent.columns, pa.array(part.astype("int32"))], ["point", "x", "part"])

    return points.select("point", "x").mapInArrow(run, "point bigint, x array<double>, part int")


def _bound(rough: np.ndarray, kth: int) -> np.ndarray:
    """For each row a number that more than ``kth`` of its values do not exceed: of many values, the one among the least of GROUPS groups."""
    if rough.shape[1] >= 4 * GROUPS > 16 * kth:
        whole = rough[:, : rough.shape[1] // GROUPS * GROUPS]
        rough = whole.reshape(len(rough), -1, GROUPS).min(axis=1)
    return np.partition(rough, kth, axis=1)[:, kth]


def _block_neighbors(k: int):
    def run(test: pa.Table, train: pa.Table) -> pa.Table:
        out = {"point": [], "train_key": [], "label": [], "distance": []}
        if test.num_rows and train.num_rows:
            a, b = (_matrix(t["x"].combine_chunks()) for t in (test, train))
            # keys stay Arrow values, as they may be missing; ties go by key, missing ones first
            keys, labels, tests = (c.combine_chunks() for c in (train["train_key"], train["label"], test["point"]))
            place = np.empty(len(b), np.int64)
            place[pc.sort_indices(keys, null_placement="at_start").to_numpy()] = np.arange(len(b))
            squares = (b * b).sum(1)
            kth = min(k, len(b)) - 1
            size = max(1, HELD // len(b))
            for start in range(0, len(a), size):
                part = a[start : start + size]
                own = (part * part).sum(1)
                rough = part @ b.T  # becomes the square of the distance less that of the test vector
                rough *= -2
                rough += squares
                limit = _bound(rough, kth)
                # the fast formula rounds, so near ties are measured again exactly
                slack = 1e-11 * (1 + own + squares.max()) + 1e-6 * np.maximum(limit + own, 0)
                row, col = np.nonzero(rough <= (limit + slack)[:, None])
                exact = np.sqrt(((part[row] - b[col]) ** 2).sum(1))
                order = np.lexsort((place[col], exact, row))
                row, col, exact = row[order], col[order], exact[order]
                near = np.arange(len(row)) - np.searchsorted(row, row) < k
                out["point"].append(tests.take(pa.array(start + row[near])))
                out["train_key"].append(keys.take(pa.array(col[near])))
                out["label"].append(labels.take(pa.array(col[near])))
                out["distance"].append(pa.array(exact[near]))
        kinds = {"point": pa.int64(), "train_key": pa.int64(), "label": pa.float64(), "distance": pa.float64()}
        return pa.table({c: pa.chunked_array(v, kinds[c]) for c, v in out.items()})

    return run


def _groups(centres: np.ndarray, sizes: np.ndarray, limit: int) -> np.ndarray:
    """A number for every cell: cells in the order of their pivots along the longest axis, cut where ``limit`` rows are reached."""
    spread = centres - centres.mean(axis=0)
    along = spread @ np.linalg.svd(spread, full_matrices=False)[2][0] if spread.any() else np.zeros(len(centres))
    out, group, held = np.zeros(len(centres), int), 0, 0
    for j in np.argsort(along, kind="stable"):
        if held and held + sizes[j] > limit:
            group, held = group + 1, 0
        out[j], held = group, held + sizes[j]
    return out


def nearest(
    test: DataFrame,
    train: DataFrame,
    k: int,
    pivots: int = PIVOTS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """test_key, train_key, label, distance, rank of the k nearest train rows, ties by train_key.

    ``test`` has (test_key bigint, x array<double>), ``train`` (train_key bigint, x, label double).
    ``pivots`` and ``block_rows`` hold for small tables; a larger one has about as many pivots as the root of its distinct rows,
    and BLOCKS blocks as long as they fit BLOCK_CELLS numbers.
    """
    spark = test.sparkSession
    equal = Window.partitionBy("x").orderBy("train_key")
    # a vector that is not finite is at no distance from any other
    finite = train.where(F.col("x").isNull() | F.forall("x", lambda v: F.abs(v) < float("inf")))
    known = checkpointed(finite.withColumn("_again", F.row_number().over(equal)).where(F.col("_again") <= k).drop("_again"))
    about = known.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("w")).first()
    if not about.n:
        return spark.createDataFrame([], "test_key bigint, train_key bigint, label double, distance double, rank int")
    largest = max(1, BLOCK_CELLS // max(1, about.w or 1))

    def block(rows: int) -> int:
        return max(min(block_rows, largest), min(largest, -(-rows // BLOCKS)))

    chosen = hash_sample(known.select("train_key", "x"), max(pivots, isqrt(about.n)), ["train_key"]).collect()
    centres = np.array([r["x"] for r in chosen], dtype=float)
    placed = checkpointed(_assign(known, centres, "train_key bigint, x array<double>, label double, cell int, reach double"))
    points = checkpointed(test.select("x").distinct().withColumn("point", F.monotonically_increasing_id()))
    by_reach = Window.partitionBy("cell").orderBy("reach", "train_key")
    first: list[list[float]] = [[] for _ in centres]
    for r in placed.select("cell", "reach", F.row_number().over(by_reach).alias("r")).where(F.col("r") <= k).collect():
        first[r["cell"]].append(r["reach"])
    counts, radius = np.zeros(len(centres), int), np.zeros(len(centres))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("radius")).collect():
        counts[r["cell"]], radius[r["cell"]] = r["n"], r["radius"]
    group = _groups(centres, counts, block(about.n))
    inside = np.bincount(group, counts).astype(int)
    routed = _route(points, centres, radius, first, group, k)
    visits = {r["part"]: r["n"] for r in routed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    train_blocks = [max(1, -(-int(n) // block(about.n))) for n in inside]
    test_blocks = [max(1, -(-visits.get(g, 0) // block(max(visits.values(), default=0)))) for g in range(len(inside))]

    def lookup(table: list[int]):
        return F.get(F.array(*[F.lit(n) for n in table]), F.col("part"))

    left = routed.select(
        "point",
        "x",
        "part",
        F.pmod(F.xxhash64("point"), lookup(test_blocks)).cast("int").alias("qb"),
        F.explode(F.sequence(F.lit(0), lookup(train_blocks) - 1)).alias("tb"),
    )
    right = placed.withColumn("part", F.get(F.array(*[F.lit(int(g)) for g in group]), F.col("cell"))).select(
        "train_key",
        "x",
        "label",
        "part",
        F.explode(F.sequence(F.lit(0), lookup(test_blocks) - 1)).alias("qb"),
        F.pmod(F.xxhash64("x"), lookup(train_blocks)).cast("int").alias("tb"),
    )
    keys = ["part", "qb", "tb"]
    # comparing takes far longer than its input's size tells, so the blocks are dealt over as many partitions as there are
    tasks = sum(a * b for a, b in zip(train_blocks, test_blocks, strict=True))
    left, right = (t.repartition(max(2, tasks), *keys) for t in (left, right))
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        _block_neighbors(k), "point bigint, train_key bigint, label double, distance double"
    )
    by_point = Window.partitionBy("point").orderBy("distance", "train_key")
    found = found.withColumn("rank", F.row_number().over(by_point)).where(F.col("rank") <= k).drop("rank")
    asked = test.join(points, "x").select("test_key", "point").join(found, "point").drop("point")
    by_distance = Window.partitionBy("test_key").orderBy("distance", "train_key")
    return asked.withColumn("rank", F.row_number().over(by_distance)).where(F.col("rank") <= k)


def _weighted(neighbors: DataFrame, weights: str) -> DataFrame:
    if weights == "uniform":
        return neighbors.withColumn("w", F.lit(1.0))
    # with distance weights an exact match outweighs everything else
    same = F.min("distance").over(Window.partitionBy("test_key")) == 0
    weight = F.when(same, (F.col("distance") == 0).cast("double")).otherwise(1 / F.nullif(F.col("distance"), F.lit(0.0)))
    return neighbors.withColumn("w", weight)


def vote(neighbors: DataFrame, weights: str = "uniform") -> DataFrame:
    """test_key, prediction, confidence: the class with the largest weight, the smallest class on ties."""
    sums = _weighted(neighbors, weights).groupBy("test_key", "label").agg(F.sum("w").alias("w"))
    best = F.max_by("label", F.struct(F.col("w"), -F.col("label")))
    return sums.groupBy("test_key").agg(best.alias("prediction"), ratio(F.max("w"), F.sum("w")).alias("confidence"))


def mean_label(neighbors: DataFrame, weights: str = "uniform") -> DataFrame:
    """test_key, prediction: the weighted mean of the neighbours' labels."""
    found = _weighted(neighbors, weights)
    return found.groupBy("test_key").agg(ratio(F.sum(F.col("w") * F.col("label")), F.sum("w")).alias("prediction"))
