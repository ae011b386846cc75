"""Kernel machine for two classes: random Fourier features, hinge loss and probabilities from a logistic fit on the margins.

Both fits are Newton steps. A step is one job: tasks make the features of their rows a batch at a time and send sums (loss, gradient,
matrix of second derivatives), which Spark adds up in groups; the driver sees a few matrices of the features' size, however many rows
there are. Up to TASK_ROWS rows take all steps in one task, by the same code. The hinge has no second derivative, so its corner is rounded by a parabola that narrows from step to step (Chapelle,
"Training a Support Vector Machine in the Primal", 2007).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.errors import LodestatError
from lodestat.session import checkpointed

SEED = 42
#: Half widths of the hinge's rounded corner, one after the other (in the first one every row curves the loss at the start), Newton steps of
#: each at most, the relative gain that ends the steps of a corner but the last, and that of the last or the mean loss that ends them.
CORNERS, STEPS, ROUGH_GAIN, LEAST_GAIN = (2.0, 0.5, 0.1, 0.02), 50, 1e-2, 1e-5
#: One task takes all steps for at most so many rows.
TASK_ROWS = 1 << 16
#: Shares of a step that are tried at once, groups in which sums of tasks are added before the driver adds those, rows of one matrix.
SHARES, SUM_GROUPS, SLICE_ROWS = tuple(0.4**k for k in range(14)), 8, 8192
Projection = Callable[[np.ndarray], np.ndarray]
Sums = Callable[[np.ndarray, np.ndarray], np.ndarray]


class RandomFourierFeatures(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Random cosine features whose dot products approximate an RBF kernel (Rahimi and Recht 2007)."""

    width = Param(Params._dummy(), "width", "number of input features", TypeConverters.toInt)
    size = Param(Params._dummy(), "size", "number of random features", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel coefficient", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, inputCol="features", outputCol="rff", width=1, size=256, gamma=1.0, seed=SEED):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="rff", width=1, size=256, gamma=1.0, seed=SEED)
        self._set(**self._input_kwargs)

    def projection(self) -> Projection:
        """The features as a function of a matrix of rows."""
        rng = np.random.default_rng(self.getSeed())
        n, d = self.getOrDefault(self.size), self.getOrDefault(self.width)
        weights = rng.normal(0, np.sqrt(2 * self.getOrDefault(self.gamma)), (d, n))
        shift = rng.uniform(0, 2 * np.pi, n)
        return lambda x: np.sqrt(2 / n) * np.cos(x @ weights + shift)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        made = self.projection()

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def project(x: pd.Series) -> pd.Series:
            if not len(x):
                return x
            return pd.Series(list(made(np.stack(x.to_numpy()))))

        found = array_to_vector(project(vector_to_array(self.getInputCol())))
        return dataset.withColumn(self.getOutputCol(), found)


class MarginModel(Transformer, HasInputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Margin of a linear model, the class by its sign, and the class's probability as a logistic function of the margin."""

    weights = Param(Params._dummy(), "weights", "coefficients", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "intercept", TypeConverters.toFloat)
    slope = Param(Params._dummy(), "slope", "log-odds for one unit of margin", TypeConverters.toFloat)
    offset = Param(Params._dummy(), "offset", "log-odds at margin 0", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, inputCol="features", weights=None, intercept=0.0, slope=1.0, offset=0.0):
        super().__init__()
        self._setDefault(inputCol="features", intercept=0.0, slope=1.0, offset=0.0)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights, intercept = np.array(self.getOrDefault(self.weights)), self.getOrDefault(self.intercept)
        slope, offset = self.getOrDefault(self.slope), self.getOrDefault(self.offset)

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def outputs(x: pd.Series) -> pd.Series:
            if not len(x):
                return x
            margin = np.stack(x.to_numpy()) @ weights + intercept
            p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -500, 500)))
            return pd.Series(list(np.column_stack([-margin, margin, 1 - p, p])))

        made = dataset.withColumn("_outputs", outputs(vector_to_array(self.getInputCol())))
        made = made.withColumns({"rawPrediction": array_to_vector(F.slice("_outputs", 1, 2)), "probability": array_to_vector(F.slice("_outputs", 3, 2))})
        return made.withColumn("prediction", (F.get("_outputs", F.lit(1)) > 0).cast("double")).drop("_outputs")


def hinge(room: np.ndarray, corner: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hinge of the margin's excess ``room`` with its corner rounded over 2 x ``corner``, and its derivatives by the excess."""
    low = np.clip(room + corner, 0, 2 * corner)
    loss = low * low / (4 * corner) + np.maximum(room - corner, 0)
    return loss, low / (2 * corner), ((room > -corner) & (room < corner)) / (2 * corner)


def logistic(room: np.ndarray, _: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log(1 + e^(-margin)) for a margin of 1 - ``room``, and its derivatives by the excess."""
    p = 1 / (1 + np.exp(np.clip(1 - room, -500, 500)))
    return np.logaddexp(0, room - 1), p, p * (1 - p)


Loss = Callable[[np.ndarray, float], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def _added(batches: Iterator[pa.RecordBatch], sums: Sums, size: int, width: int) -> np.ndarray:
    total = np.zeros(size)
    for batch in batches:
        x, y = _matrix(batch, width), batch.column("label").to_numpy(zero_copy_only=False)
        for a in range(0, len(x), SLICE_ROWS):
            total += sums(x[a : a + SLICE_ROWS], y[a : a + SLICE_ROWS])
    return total


@dataclass
class _Rows:
    """Checkpointed rows (x, label) in ``parts`` partitions."""

    table: DataFrame
    n: int
    width: int
    parts: int

    def summed(self, sums: Sums, size: int) -> np.ndarray:
        """The sum over all rows of ``sums`` (x, label), ``size`` numbers; tasks add theirs, then groups of tasks."""
        width = self.width

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group = TaskContext.get().partitionId() % SUM_GROUPS
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([_added(batches, sums, size, width).tobytes()], pa.binary())], ["g", "v"])

        def grouped(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(v) for v in table["v"].to_pylist())
            return pa.table({"g": table["g"].slice(0, 1), "v": pa.array([total.tobytes()], pa.binary())})

        made = self.table.mapInArrow(each, "g int, v binary")
        if self.parts > SUM_GROUPS:
            made = made.groupBy("g").applyInArrow(grouped, "g int, v binary")
        return sum(np.frombuffer(r.v) for r in made.collect())

    def solved(self, solve: Callable[[Callable[[Sums, int], np.ndarray]], np.ndarray]) -> np.ndarray:
        """What ``solve`` makes of a function that sums over all rows: a job each time, or one job where one task has all rows."""
        if self.n > TASK_ROWS:
            return solve(self.summed)
        width = self.width

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = list(batches)
            yield pa.RecordBatch.from_arrays([pa.array([solve(lambda sums, size: _added(iter(held), sums, size, width)).tobytes()], pa.binary())], ["v"])

        return np.frombuffer(self.table.mapInArrow(whole, "v binary").collect()[0].v)


def minimised(summed: Callable[[Sums, int], np.ndarray], n: int, project: Projection, loss: Loss, ridge: float, size: int, corners: tuple[float, ...]) -> np.ndarray:
    """Coefficients and intercept (last) of the least mean loss + ridge / 2 x squared coefficients, by Newton steps."""
    at = np.zeros(size + 1)
    kept = np.r_[np.full(size, ridge), 0.0]

    def measured(start: np.ndarray, step: np.ndarray, corner: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Objective at every share of the step; gradient and second derivatives at its end."""

        def sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            z = np.column_stack([project(x), np.ones(len(x))])
            sign = 2 * y - 1
            here, along = sign * (z @ start), sign * (z @ step)
            tried = [loss(1 - here - s * along, corner)[0].sum() for s in SHARES]
            _, first, second = loss(1 - here - along, corner)
            curved = second > 0
            return np.concatenate([tried, z.T @ (-sign * first), ((z[curved] * second[curved, None]).T @ z[curved]).ravel()])

        found = summed(sums, len(SHARES) + (size + 1) * (size + 2)) / n
        values, slope, curve = np.split(found, [len(SHARES), len(SHARES) + size + 1])
        points = [start + s * step for s in SHARES]
        values = values + [(kept * p * p).sum() / 2 for p in points]
        return values, slope + kept * points[0], curve.reshape(size + 1, -1) + np.diag(kept)

    for corner in corners:
        values, slope, curve = measured(at, np.zeros(size + 1), corner)
        value = values[0]
        for _ in range(STEPS):
            # rows outside the corner curve nothing: the least addition keeps the step finite
            step = -np.linalg.lstsq(curve + 1e-9 * max(1e-3, np.trace(curve) / len(curve)) * np.eye(len(curve)), slope, rcond=None)[0]
            values, new_slope, new_curve = measured(at, step, corner)
            best = int(values.argmin())
            gain = value - values[best]
            if not gain > 0:
                break
            if values[0] <= value + 1e-4 * (slope @ step):
                best = 0
            at, gain, value = at + SHARES[best] * step, value - values[best], values[best]
            if gain <= (LEAST_GAIN if corner == corners[-1] else ROUGH_GAIN) * value or value <= LEAST_GAIN:
                break
            slope, curve = (new_slope, new_curve) if best == 0 else measured(at, np.zeros(size + 1), corner)[1:]
    return at


class MarginMachine:
    """Estimator with MLlib's ``fit``: mean hinge loss + ``ridge`` / 2 x squared coefficients of features brought to deviation 1."""

    def __init__(self, kernel: list[RandomFourierFeatures], ridge: float):
        self.kernel, self.ridge = kernel, ridge

    def fit(self, train: DataFrame) -> PipelineModel:
        values = train.schema["label"].metadata.get("ml_attr", {}).get("vals")
        if values is not None and len(values) != 2:
            raise LodestatError(f"two classes are needed, not {len(values)}")
        table = checkpointed(train.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label")))
        about = table.select(F.spark_partition_id().alias("p"), "x").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("w"), F.count_distinct("p").alias("parts")).first()
        if not about.n:
            raise LodestatError("no rows to train on")
        n, width, kernel, ridge = about.n, about.w, self.kernel, self.ridge
        few = n <= TASK_ROWS
        rows = _Rows(table.coalesce(1) if few else table, n, width, 1 if few else about.parts)
        raw = kernel[0].projection() if kernel else lambda x: x
        size = raw(np.zeros((1, width))).shape[1]

        def solve(summed: Callable[[Sums, int], np.ndarray]) -> np.ndarray:
            found = summed(lambda x, _: np.concatenate([raw(x).sum(axis=0), (raw(x) ** 2).sum(axis=0)]), 2 * size) / n
            mean = found[:size]
            spread = np.sqrt(np.maximum(found[size:] - mean * mean, 0))
            spread = np.where(spread > 1e-9 * np.maximum(1, np.abs(mean)), spread, np.inf)  # a constant feature has no say
            made = minimised(summed, n, lambda x: (raw(x) - mean) / spread, hinge, ridge, size, CORNERS)
            weights = made[:-1] / spread
            return np.r_[weights, made[-1] - mean @ weights]

        *weights, intercept = rows.solved(solve).tolist()

        def margin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch, width)
                m = [raw(x[a : a + SLICE_ROWS]) @ np.array(weights) + intercept for a in range(0, len(x), SLICE_ROWS)]
                cells = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32), np.concatenate([*m, np.zeros(0)]))
                yield pa.RecordBatch.from_arrays([cells, batch.column("label")], ["x", "label"])

        margins = _Rows(checkpointed(rows.table.mapInArrow(margin, "x array<double>, label double")), n, 1, rows.parts)
        slope, offset = margins.solved(lambda summed: minimised(summed, n, lambda m: m, logistic, 0.0, 1, (0.0,)))
        model = MarginModel(inputCol="rff" if self.kernel else "features", weights=weights, intercept=intercept, slope=float(slope), offset=float(offset))
        return PipelineModel(stages=[*self.kernel, model])
