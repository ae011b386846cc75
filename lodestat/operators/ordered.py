"""Ordered operators (rank, running sums, carry of the last value) that survive hot groups.

A plain window sorts each group in one task. That is right while groups are small, so the size of
the largest group is measured first. Beyond the limit the rows are range-partitioned on
(keys, order), which splits hot groups over many tasks; each piece is windowed alone, and what a
piece needs from the earlier ones is a small per-piece summary. The pieces are written to the
shared checkpoint folder, so that piece ids cannot change between the two uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions.columns import named
from lodestat.session import checkpointed

MAX_GROUP_ROWS = 1_000_000


def largest_group(df: DataFrame, keys: list[str]) -> int:
    if not keys:
        return df.count()
    sizes = df.groupBy(*[named(k) for k in keys]).agg(F.count("*").alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def pieces(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Globally sorted rows with ``_piece`` (rising along the order) and ``_at`` (row in the piece)."""
    by = [named(k) for k in keys] + list(order)
    ident = F.col("_id")
    tagged = (
        df.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_piece", F.shiftright(ident, 33).cast("int"))
        .withColumn("_at", ident.bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_id")
    )
    return checkpointed(tagged)


def _with_carry(tagged: DataFrame, keys: list[str], summary: list[Column], carry) -> DataFrame:
    """Join to every (keys, piece) what ``carry`` makes of the summaries of earlier pieces.

    The summary has one row per group and piece, and a group has at most as many pieces as the
    table has partitions, so the window over it is small.
    """
    key_cols = [named(k) for k in keys]
    per_piece = tagged.groupBy(*key_cols, "_piece").agg(*summary)
    earlier = Window.partitionBy(*(key_cols or [F.lit(0)])).orderBy("_piece")
    carried = carry(per_piece, earlier)
    carried = carried.select(
        *[named(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_piece").alias("_kp"),
        *[c for c in carried.columns if c.startswith("_carry")],
    )
    match = F.col("_piece") == F.col("_kp")
    for i, k in enumerate(keys):
        match = match & named(k).eqNullSafe(F.col(f"_k{i}"))
    return tagged.join(carried, match, "left").drop("_kp", *[f"_k{i}" for i in range(len(keys))])


def running(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    sums: dict[str, str] | None = None,
    row_number: str | None = None,
    leads: dict[str, str] | None = None,
    max_group_rows: int = MAX_GROUP_ROWS,
    group_rows: int | None = None,
) -> DataFrame:
    """Add running totals ``sums`` {output: input}, a 1-based ``row_number`` and next-row values ``leads``.

    ``order`` must be unique within ``keys`` for a reproducible result. Rows that share the whole
    order tuple also share a piece, so aggregate them first. ``group_rows`` is the size of the
    largest group, or a bound on it, where the caller knows it already.
    """
    sums, leads = sums or {}, leads or {}
    key_cols = [named(k) for k in keys]
    if (largest_group(df, keys) if group_rows is None else group_rows) <= max_group_rows:
        w = Window.partitionBy(*(key_cols or [F.lit(0)])).orderBy(*order)
        total = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        added = {out: F.sum(named(c)).over(total) for out, c in sums.items()}
        added.update({out: F.lead(named(c)).over(w) for out, c in leads.items()})
        if row_number:
            added[row_number] = F.row_number().over(w).cast("bigint")
        return df.withColumns(added)

    tagged = pieces(df, keys, order)
    inner = Window.partitionBy(*key_cols, "_piece").orderBy("_at")
    total = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summary = [F.count("*").alias("_n")]
    summary += [F.sum(named(c)).alias(f"_s_{out}") for out, c in sums.items()]
    summary += [F.min_by(named(c), "_at").alias(f"_f_{out}") for out, c in leads.items()]

    def carry(per_piece, earlier):
        before = earlier.rowsBetween(Window.unboundedPreceding, -1)
        added = {"_carry_n": F.coalesce(F.sum("_n").over(before), F.lit(0))}
        for out in sums:
            added[f"_carry_s_{out}"] = F.coalesce(F.sum(f"_s_{out}").over(before), F.lit(0))
        for out in leads:
            added[f"_carry_f_{out}"] = F.lead(f"_f_{out}").over(earlier)
        return per_piece.withColumns(added)

    joined = _with_carry(tagged, keys, summary, carry)
    added = {out: F.sum(named(c)).over(total) + F.col(f"_carry_s_{out}") for out, c in sums.items()}
    for out, c in leads.items():
        last_in_piece = F.row_number().over(inner) == F.count("*").over(Window.partitionBy(*key_cols, "_piece"))
        added[out] = F.when(last_in_piece, F.col(f"_carry_f_{out}")).otherwise(F.lead(named(c)).over(inner))
    if row_number:
        added[row_number] = (F.row_number().over(inner) + F.col("_carry_n")).cast("bigint")
    result = joined.withColumns(added)
    return result.drop("_piece", "_at", *[c for c in joined.columns if c.startswith("_carry")])


def carry_value(
    df: DataFrame,
    column: str,
    keys: list[str],
    order: list[str],
    backward: bool = False,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Replace missing values of ``column`` by the last (or next, if ``backward``) present one."""
    key_cols = [named(k) for k in keys]
    by = [named(c).desc_nulls_last() if backward else named(c).asc_nulls_first() for c in order]
    value = named(column)
    if largest_group(df, keys) <= max_group_rows:
        w = Window.partitionBy(*(key_cols or [F.lit(0)])).orderBy(*by)
        filled = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return df.withColumn(column, filled)

    tagged = pieces(df, keys, by)
    inner = Window.partitionBy(*key_cols, "_piece").orderBy("_at")
    inner = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summary = [F.max_by(value, F.when(value.isNotNull(), F.col("_at"))).alias("_last")]

    def carry(per_piece, earlier):
        before = earlier.rowsBetween(Window.unboundedPreceding, -1)
        return per_piece.withColumn("_carry", F.last("_last", ignorenulls=True).over(before))

    joined = _with_carry(tagged, keys, summary, carry)
    filled = F.coalesce(F.last(value, ignorenulls=True).over(inner), F.col("_carry"))
    return joined.withColumn(column, filled).select(*[named(c) for c in df.columns])
