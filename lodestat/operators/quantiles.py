"""Exact quantiles that never gather a whole column in one task.

``percentile`` keeps a value-to-count map of the column in a single buffer. Beyond a checked row
count we instead
  1. sketch a sample of the rows, giving per wanted rank a bracket [lo, hi] that very likely holds
     it and only a small share of the rows,
  2. count exactly how many rows lie below and inside each bracket (one pass of plain sums),
     widen a bracket that missed its rank and narrow one that still holds too many rows,
  3. fetch the one or two values at the wanted ranks from the few rows inside the brackets.
The sample decides how much work is left, never the answer. Only counts, brackets and the answers
themselves reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions.columns import melt, number

ACCURACY = 10_000
SAMPLE_ROWS = 50_000
SAMPLE_SHARE = 0.01
SMALL_COLUMN = 100_000
MAX_ROUNDS = 4
BRACKET_FACTOR = 10


@dataclass
class _Wanted:
    column: str
    prob: float
    rows: int
    low: float
    high: float
    below: int = 0
    inside: int = 0

    def __post_init__(self):
        self.position = self.prob * (self.rows - 1)
        self.rank = math.floor(self.position)
        self.next_rank = math.ceil(self.position)

    def holds(self) -> bool:
        return self.below <= self.rank and self.next_rank < self.below + self.inside


def exact_quantiles(
    df: DataFrame,
    cols: list[str],
    probs: list[float],
    small_column: int = SMALL_COLUMN,
    accuracy: int = ACCURACY,
    bounds: dict[str, tuple] | None = None,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column; None for a column without values.

    ``bounds`` are (count, min, max) per column from a pass the caller has already made.
    """
    if not cols:
        return {}
    values = df.select(*[number(df, c).alias(f"c{i}") for i, c in enumerate(cols)])
    names = {c: f"c{i}" for i, c in enumerate(cols)}
    if bounds is None:
        rows = melt(values, list(names.values())).groupBy("c").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        bounds = {cols[r["c"]]: (r["n"], r["lo"], r["hi"]) for r in rows}
    bounds = {c: bounds.get(c, (0, None, None)) for c in cols}
    answers: dict[tuple[str, float], float | None] = {(c, p): None for c in cols for p in probs}

    small = [c for c in cols if 0 < bounds[c][0] <= small_column]
    if small:
        row = values.agg(*[F.percentile(names[c], F.array(*[F.lit(p) for p in probs])).alias(names[c]) for c in small]).first()
        for c in small:
            answers.update({(c, p): v for p, v in zip(probs, row[names[c]])})
    large = [c for c in cols if bounds[c][0] > small_column]
    wanted = [_Wanted(c, p, *bounds[c]) for c in large for p in probs]
    for w in wanted:
        w.inside = w.rows
    _narrow(values, names, wanted, bounds, small_column, accuracy)
    _select(values, names, wanted, answers)
    return {c: [answers[(c, p)] for p in probs] for c in cols}


def _melted(values: DataFrame, names: dict, wanted: list[_Wanted]) -> tuple[DataFrame, list[list[_Wanted]], list[Column]]:
    """(c, v, lo0, hi0, lo1, ...): each value next to the brackets of its column, and a test per bracket."""
    columns = list(dict.fromkeys(w.column for w in wanted))
    per_column = [[w for w in wanted if w.column == c] for c in columns]
    width = max(len(ws) for ws in per_column)
    extra = {}
    for k in range(width):
        extra[f"lo{k}"] = [ws[k].low if k < len(ws) else math.inf for ws in per_column]
        extra[f"hi{k}"] = [ws[k].high if k < len(ws) else -math.inf for ws in per_column]
    long = melt(values, [names[c] for c in columns], extra=extra)
    v = F.col("v")
    return long, per_column, [(v >= F.col(f"lo{k}")) & (v <= F.col(f"hi{k}")) for k in range(width)]


def _count(values: DataFrame, names: dict, wanted: list[_Wanted]) -> None:
    long, per_column, inside = _melted(values, names, wanted)
    counts = [F.count_if(F.col("v") < F.col(f"lo{k}")).alias(f"b{k}") for k in range(len(inside))]
    counts += [F.count_if(test).alias(f"i{k}") for k, test in enumerate(inside)]
    for row in long.groupBy("c").agg(*counts).collect():
        for k, w in enumerate(per_column[row["c"]]):
            w.below, w.inside = row[f"b{k}"], row[f"i{k}"]


def _narrow(values: DataFrame, names: dict, wanted: list[_Wanted], bounds: dict, small_column: int, accuracy: int) -> None:
    """Tighten brackets by sampled sketches until each holds few rows or a single value."""
    for turn in range(MAX_ROUNDS):
        large = [w for w in wanted if w.low < w.high and w.inside > (small_column if turn == 0 else small_column * BRACKET_FACTOR)]
        if not large:
            return
        most = max(w.inside for w in large)
        share = min(1.0, max(SAMPLE_ROWS, most * SAMPLE_SHARE) / most)
        sample = values.where(F.rand(turn) < share) if share < 1 else values
        asks = []
        for w in large:
            # 5 standard errors of the sample and 3 of the sketch on either side
            margin = 3 / accuracy + (2.5 / math.sqrt(w.inside * share) if share < 1 else 0)
            ranks = [(r - w.below) / w.inside for r in (w.rank, w.next_rank)]
            asks.append([max(ranks[0] - margin, 0.0), min(ranks[1] + margin, 1.0)])
        # columns whose bracket is still the whole range share one sketch for all their ranks
        groups: dict[tuple, list[float]] = {}
        keys = []
        for w, ask in zip(large, asks):
            key = (w.column, w.low, w.high)
            keys.append(key)
            groups.setdefault(key, []).extend(ask)
        sketches = []
        for i, ((column, low, high), ask) in enumerate(groups.items()):
            v = F.col(names[column])
            whole = (low, high) == bounds[column][1:]
            held = v if whole else F.when((v >= F.lit(low)) & (v <= F.lit(high)), v)
            sketches.append(F.percentile_approx(held, ask, accuracy).alias(f"q{i}"))
        row = sample.agg(*sketches).first()
        found = {key: dict(zip(ask, row[f"q{i}"] or [])) for i, (key, ask) in enumerate(groups.items())}
        tighter = []
        for w, key, ask in zip(large, keys, asks):
            low = w.low if ask[0] == 0.0 else found[key].get(ask[0], w.low)
            high = w.high if ask[1] == 1.0 else found[key].get(ask[1], w.high)
            tighter.append(_Wanted(w.column, w.prob, w.rows, low, high))
        _count(values, names, tighter)
        progress = False
        for w, t in zip(large, tighter):
            # a bracket that missed its rank is dropped: the wider, counted one stays
            if t.holds() and t.inside < w.inside:
                w.low, w.high, w.below, w.inside = t.low, t.high, t.below, t.inside
                progress = True
        if not progress:
            return


def _select(values: DataFrame, names: dict, wanted: list[_Wanted], answers: dict) -> None:
    open_brackets = []
    for w in wanted:
        if w.low == w.high:
            answers[(w.column, w.prob)] = w.low
        else:
            open_brackets.append(w)
    if not open_brackets:
        return
    long, per_column, inside = _melted(values, names, open_brackets)
    any_inside = inside[0]
    for test in inside[1:]:
        any_inside = any_inside | test
    hits = F.filter(F.array(*[F.when(test, F.lit(k)) for k, test in enumerate(inside)]), lambda k: k.isNotNull())
    at = {(i, k): w for i, ws in enumerate(per_column) for k, w in enumerate(ws)}
    width = len(inside)
    slots = [at.get((i, k)) for i in range(len(per_column)) for k in range(width)]
    ranks = F.array(*[F.lit(w.rank - w.below if w else -1) for w in slots])
    next_ranks = F.array(*[F.lit(w.next_rank - w.below if w else -1) for w in slots])
    per_bracket = Window.partitionBy("slot").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the filter comes first: only the few rows inside some bracket are exploded and shuffled
    rows = (
        long.where(any_inside)
        .select("c", "v", F.explode(hits).alias("k"))
        .groupBy((F.col("c") * width + F.col("k")).alias("slot"), "v")
        .agg(F.count("*").alias("n"))
        .withColumn("upto", F.sum("n").over(per_bracket))
        .withColumn("rank", F.get(ranks, F.col("slot")))
        .withColumn("next_rank", F.get(next_ranks, F.col("slot")))
        .where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("next_rank")))
        .select("slot", "v", "upto", "n")
        .collect()
    )
    for (i, k), w in at.items():
        spans = [(r["upto"] - r["n"], r["upto"], r["v"]) for r in rows if r["slot"] == i * width + k]
        value = {x: next(v for lo, hi, v in spans if lo <= x - w.below < hi) for x in (w.rank, w.next_rank)}
        share = w.position - w.rank
        answers[(w.column, w.prob)] = value[w.rank] + (value[w.next_rank] - value[w.rank]) * share
