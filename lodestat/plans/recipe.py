"""Recipes: replayable lists of cleaning and feature steps, with undo and redo."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from lodestat.errors import NothingToRedo, NothingToUndo
from lodestat.operators.clean import operation
from lodestat.operators.fitting import fit_statistics

HISTORY = 20
WHOLE_TABLE = {"dummies", "impute_all"}


@dataclass
class FittedRecipe:
    """Steps with the statistics they were fitted on; applies to any table or stream of that shape."""

    steps: list[tuple[dict, dict]]
    passes: int

    def transform(self, df: DataFrame) -> DataFrame:
        for step, stats in self.steps:
            df = operation(step).apply(df, step, stats)
        return df


def fit_recipe(df: DataFrame, steps: list[dict]) -> FittedRecipe:
    """Fit the steps in as few passes over the data as their dependencies allow.

    Consecutive steps share one pass while none of them reads a column that an earlier one of
    the group rewrites, and no earlier one removes rows.
    """
    fitted, passes, at = [], 0, 0
    while at < len(steps):
        group, keys, dirty, rows_changed = [], [], set(), False
        for step in steps[at:]:
            op = operation(step)
            touched = {step["column"]} if "column" in step else set(step.get("columns", []))
            whole = step["op"] in WHOLE_TABLE
            if group and (whole or touched & dirty):
                break
            needs = op.needs(df, step)
            if needs and rows_changed:
                break
            group.append(step)
            keys += needs
            dirty |= op.writes(df, step)
            rows_changed = rows_changed or op.changes_rows(step)
            at += 1
            # the columns that one-hot encoding makes depend on the data: later steps are planned on its result
            if whole or step.get("method") == "one_hot":
                break
        stats = fit_statistics(df, keys)
        passes += bool(keys)
        for step in group:
            own = {k: stats[k] for k in stats if k in operation(step).needs(df, step)}
            df = operation(step).apply(df, step, own)
            fitted.append((step, own))
    return FittedRecipe(fitted, passes)


def apply_recipe(df: DataFrame, steps: list[dict]) -> DataFrame:
    return fit_recipe(df, steps).transform(df)


@dataclass
class Recipe:
    """Editable recipe. At most ``HISTORY`` steps can be undone; a new step clears the redo list."""

    steps: list[dict] = field(default_factory=list)
    undone: list[dict] = field(default_factory=list)
    undoable: int = 0

    def add(self, step: dict) -> Recipe:
        operation(step)
        self.steps.append(step)
        self.undone.clear()
        self.undoable = min(self.undoable + 1, HISTORY)
        return self

    def undo(self) -> Recipe:
        if not self.undoable:
            raise NothingToUndo("nothing to undo")
        self.undone.append(self.steps.pop())
        self.undoable -= 1
        return self

    def redo(self) -> Recipe:
        if not self.undone:
            raise NothingToRedo("nothing to redo")
        self.steps.append(self.undone.pop())
        self.undoable += 1
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        return apply_recipe(df, self.steps)


def auto_clean(df: DataFrame, recommendations: DataFrame) -> tuple[DataFrame, list[dict]]:
    """Turn recommended strategies (kind, column, strategy) into a recipe and apply it.

    The recommendations have at most one row per column and kind.
    """
    rows = recommendations.select("kind", "column", "strategy").collect()
    rank = {"missing": 0, "encoding": 1, "outlier": 2}
    rows.sort(key=lambda r: (rank[r["kind"]], df.columns.index(r["column"])))
    steps = [fix_step(r["kind"], r["column"], r["strategy"]) for r in rows]
    return apply_recipe(df, steps), steps


def fix_step(issue: str, column: str, strategy: str) -> dict:
    if issue == "missing":
        if strategy == "drop_column":
            return {"op": "drop_column", "column": column}
        if strategy == "drop_rows":
            return {"op": "drop_na"}
        return {"op": "fill_na", "column": column, "method": strategy}
    if issue == "encoding":
        return {"op": "encode", "column": column, "method": strategy}
    return {"op": "handle_outliers", "column": column, "method": "drop" if strategy == "drop_outliers" else "clip"}
