"""Exact top-k inner products by a vector-approximation file.

Every component is quantised to one of 16 cells of its dimension. A scan of the cells bounds each score from both sides; the exact
vectors are then read from the best bounds on until the k-th result is certain. Queries meet candidates block by block, and a
floor for each query's k-th score from a bounded sample keeps blocks without good candidates from sending anything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.session import checkpointed

CELLS, SCALE = 16, 64.0
#: Rows of a block of queries and of candidates, and of the sample that gives the first floor.
QUERY_ROWS, CANDIDATE_ROWS, SAMPLE_ROWS = 4096, 32768, 4096
_BLOCK = "dim int, part long, query boolean, ids binary, hashes binary, kind string, vectors binary, cells binary, floors binary"
_EXACT = 2.0**52


def scaled(column: str = "embedding") -> Column:
    return F.transform(column, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))


def usable(column: str = "embedding") -> Column:
    """Not null, and every scaled component finite."""
    sound = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < float("inf")))
    return F.col("vec_id").isNotNull() & F.coalesce(F.col(column).isNotNull() & sound, F.lit(False))


def _narrow(x: np.ndarray) -> tuple[str, bytes]:
    most = np.abs(x).max(initial=0)
    kind = "i1" if most <= 127 else "<i2" if most <= 32767 else "<f8"
    return kind, x.astype(kind).tobytes()


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise integer inner products; beyond 2^52 in Python integers, held to the range of a long."""
    bound = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(q.shape[1], 1)
    if bound < _EXACT:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    sums = [sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for u, v in zip(q, x, strict=True)]
    return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in sums], np.int64)


class Cells:
    """Cell number c of dimension d holds the integers low[d] + c * width[d] ... + width[d] - 1."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low = low
        self.width = np.floor((high - low) / CELLS) + 1

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((x - self.low) / self.width), 0, CELLS - 1).astype(np.uint8)

    def middles(self, cells: np.ndarray) -> np.ndarray:
        return self.low + cells * self.width + (self.width - 1) / 2

    def slack(self, q: np.ndarray) -> np.ndarray:
        """Farthest that a score can lie from the product with the cells' middles."""
        reach = (self.width - 1) / 2
        size = np.abs(q) @ (np.maximum(np.abs(self.low), np.abs(self.low + CELLS * self.width)))
        return np.abs(q) @ reach + np.where(size < _EXACT, 0.0, size * 1e-9)


def search(grid: Cells, q, q_ids, q_hashes, floors, x, x_ids, x_cells, k: int):
    """(query row, candidate row, score): each query's k best in this block, ties to the smaller id, and none below its floor."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    middles = grid.middles(x_cells)
    small = np.abs(q).max(initial=0) * np.abs(middles).max(initial=0) * max(q.shape[1], 1) < 2.0**22
    kind = np.float32 if small else np.float64
    middles = middles.astype(kind).T
    step = max(1, (4 << 20) // max(len(x_ids), 1))
    for at in range(0, len(q_ids), step):
        own = q[at : at + step]
        about = (own.astype(kind) @ middles).astype(np.float64)
        about[q_ids[at : at + step, None] == x_ids[None, :]] = -np.inf
        slack = grid.slack(own)
        least = floors[at : at + step].astype(np.float64)
        first = min(2 * k, len(x_ids))
        best = np.argpartition(-about, first - 1, axis=1)[:, :first]
        rows = np.repeat(np.arange(len(own)), first)
        read = exact_scores(own[rows], x[best.ravel()]).reshape(best.shape).astype(np.float64)
        read[np.take_along_axis(about, best, 1) == -np.inf] = -np.inf
        if first >= k:  # the k-th best of those read: whatever is bounded below it is out
            least = np.maximum(least, -np.partition(-read, k - 1, axis=1)[:, k - 1])
        r, c = np.nonzero((about + slack[:, None] >= least[:, None]) & (about > -np.inf))
        score = exact_scores(own[r], x[c])
        held = score >= least[r]
        r, c, score = r[held], c[held], score[held]
        order = np.lexsort((x_ids[c], -score.astype(np.float64) if np.abs(score).max(initial=0) < _EXACT else ~score, r))
        r, c, score = r[order], c[order], score[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        out.append((r[rank < k] + at, c[rank < k], score[rank < k]))
    return tuple(np.concatenate([o[j] for o in out]) if out else np.zeros(0, np.int64) for j in range(3))


def _grids(rows: DataFrame) -> dict[int, Cells]:
    """Smallest and largest value of each dimension, over all rows, for every length of vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column("v")).to_numpy()
            for d in np.unique(sizes):
                x = _matrix(batch.column("v").filter(pa.array(sizes == d)))
                low, high = found.setdefault(int(d), [np.full(d, np.inf), np.full(d, -np.inf)])
                np.minimum(low, x.min(axis=0), out=low)
                np.maximum(high, x.max(axis=0), out=high)
        for d, (low, high) in found.items():
            if d:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(low), pa.array(high)], ["d", "k", "low", "high"])

    ends = rows.mapInArrow(run, "d int, k int, low double, high double").groupBy("d", "k").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    table = ends.toArrow().sort_by([("d", "ascending"), ("k", "ascending")])
    d, low, high = (table.column(c).to_numpy() for c in ("d", "low", "high"))
    out = {int(n): Cells(low[d == n], high[d == n]) for n in np.unique(d)}
    return out | {0: Cells(np.zeros(0), np.zeros(0))}


def top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row that meets ``is_query``, against every row but those with its vec_id.

    A component x counts as floor(64 * x). Ties go to the smaller vec_id; a query with fewer than k partners gets all of them.
    Vectors that are null or hold a null or non-finite component take no part, nor do rows without vec_id. Vectors of different
    length are not compared; empty ones score 0 with each other. Exactly repeated rows are one query, and as many candidates as there are
    rows; rows that share a vec_id but not the vector are queries and candidates of their own. Other columns take no part. Scores beyond a long's range are held to it.

    Each group of tasks gets one block of queries and one of candidates, so a task's memory does not grow with the table. The
    broadcast sample has at most SAMPLE_ROWS vectors.
    """
    rows = vectors.where(usable()).select(F.col("vec_id").cast("bigint").alias("vec_id"), scaled().alias("v"), is_query.alias("q"))
    # of n equal rows one asks, and no list of k can hold more than k of them
    rows = rows.groupBy("vec_id", "v").agg(F.max("q").alias("q"), F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")))).withColumn("q", F.col("q") & (F.col("copy") == 1))
    rows = checkpointed(rows.select("vec_id", "v", "q", F.xxhash64("vec_id", "v", "copy").alias("h")))
    total, queries = rows.agg(F.count(F.lit(1)), F.count_if("q")).first()
    grids = _grids(rows)
    groups = max(1, math.ceil(queries / QUERY_ROWS))
    parts = max(12, math.ceil(total / CANDIDATE_ROWS))
    sample = rows.orderBy(F.xxhash64(F.lit("floor"), "h"), "h").limit(SAMPLE_ROWS).select("vec_id", "v").toArrow().combine_chunks()
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    if sample.num_rows:
        lists = sample.column("v").combine_chunks()
        sizes = pa.compute.list_value_length(lists).to_numpy()
        ids = sample.column("vec_id").to_numpy()
        by_size = {int(d): (ids[sizes == d], _matrix(lists.filter(pa.array(sizes == d)))) for d in np.unique(sizes)}
    shared = rows.sparkSession.sparkContext.broadcast((grids, by_size))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids, known = shared.value
        for batch in batches:
            sizes, q = pa.compute.list_value_length(batch.column("v")).to_numpy(), batch.column("q").to_numpy(zero_copy_only=False).astype(bool)
            ids, h = batch.column("vec_id").to_numpy(), batch.column("h").to_numpy()
            spread = h.view(np.uint64) >> np.uint64(7)
            for d in np.unique(sizes):
                for query, n in ((False, parts), (True, groups)):
                    use = np.flatnonzero((sizes == d) & (q if query else True))
                    own = (spread[use] % np.uint64(n)).astype(np.int64)
                    for part in np.unique(own):
                        at = use[own == part]
                        x = _matrix(batch.column("v").take(pa.array(at)))
                        floors = b""
                        if query:
                            r, _, score = search(grids[d], x, ids[at], h[at], np.full(len(at), -np.inf), known[d][1], known[d][0], grids[d].cells(known[d][1]), k) if d in known else (np.zeros(0, int),) * 3
                            counts = np.bincount(r, minlength=len(at))
                            lowest = np.full(len(at), -np.inf)
                            np.minimum.at(low := np.full(len(at), np.inf), r, score.astype(np.float64))
                            lowest[counts == k] = low[counts == k]
                            floors = lowest.tobytes()
                        kind, raw = _narrow(x)
                        cells = b"" if query else grids[d].cells(x).tobytes()
                        row = [int(d), int(part), query, ids[at].tobytes(), h[at].tobytes(), kind, raw, cells, floors]
                        types = [pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], [f.split()[0] for f in _BLOCK.split(", ")])

    blocks = rows.mapInArrow(pack, _BLOCK)
    meet = blocks.withColumn("group", F.explode(F.when(F.col("query"), F.array("part")).otherwise(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>"))))
    meet = meet.withColumn("part", F.explode(F.when(F.col("query"), F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")).otherwise(F.array("part"))))

    def compare(table: pa.Table) -> pa.Table:
        d = table.column("dim")[0].as_py()
        mask = table.column("query").to_numpy()
        none = pa.table({"query_id": pa.array([], pa.int64()), "hash": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if mask.all() or not mask.any():
            return none

        def side(rows: pa.Table) -> tuple[np.ndarray, ...]:
            ids, hashes = (np.concatenate([np.frombuffer(b, np.int64) for b in rows.column(c).to_pylist()]) for c in ("ids", "hashes"))
            kinds, raw = rows.column("kind").to_pylist(), rows.column("vectors").to_pylist()
            x = np.concatenate([np.frombuffer(b, kind).astype(np.float64) for b, kind in zip(raw, kinds, strict=True)]).reshape(len(ids), d)
            return ids, hashes, x

        grids = shared.value[0]
        queries, candidates = table.filter(pa.array(mask)), table.filter(pa.array(~mask))
        q_ids, q_hashes, q = side(queries)
        x_ids, _, x = side(candidates)
        cells = np.concatenate([np.frombuffer(b, np.uint8) for b in candidates.column("cells").to_pylist()]).reshape(len(x_ids), d)
        floors = np.concatenate([np.frombuffer(b, np.float64) for b in queries.column("floors").to_pylist()])
        r, c, score = search(grids[d], q, q_ids, q_hashes, floors, x, x_ids, cells, k)
        return pa.table({"query_id": q_ids[r], "hash": q_hashes[r], "vec_id": x_ids[c], "score": score})

    found = meet.groupBy("dim", "group", "part").applyInArrow(compare, "query_id long, hash long, vec_id long, score long")
    order = Window.partitionBy("query_id", "hash").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
