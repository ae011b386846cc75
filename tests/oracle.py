"""Run registered queries next to their SQL twins in DuckDB and compare every value."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def normal(frame: pd.DataFrame) -> list[tuple]:
    def text(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
            return "NULL"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        return repr(float(v)) if isinstance(v, float) else str(v)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(text(v) for v in row) for row in frame.itertuples(index=False, name=None))


def compare(spark, con, name, fn, sql, folder) -> tuple[bool, str]:
    start = time.time()
    got = fn(spark, folder).toPandas()
    took = time.time() - start
    if sql is None:
        return True, f"{name}: rows only, {len(got)} rows, {took:.1f}s"
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return False, f"{name}: columns {sorted(got.columns)} != {sorted(want.columns)}"
    kinds = [(c, got[c].dtype.kind, want[c].dtype.kind) for c in got.columns if got[c].dtype.kind != want[c].dtype.kind]
    odd = [k for k in kinds if {k[1], k[2]} <= set("ifub") and len(got) and not want[k[0]].isna().any()]
    a, b = normal(got), normal(want)
    if a != b:
        diff = [x for x in zip(a, b) if x[0] != x[1]][:3]
        return False, f"{name}: {len(a)} rows vs {len(b)}; first differences {diff} kinds {kinds}"
    return True, f"{name}: ok {len(a)} rows, {took:.1f}s" + (f" TYPES {odd}" if odd else "")


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from lodestat.plans.catalog import ORACLES, QUERIES
    from lodestat.session import build_session

    folder = sys.argv[1]
    prefixes = tuple(sys.argv[2:])
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, fn in QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            ok, text = compare(spark, con, name, fn, ORACLES.get(name), folder)
        except Exception as error:  # report and go on with the next query
            ok, text = False, f"{name}: {type(error).__name__} {str(error)[:600]}"
        bad += not ok
        print(("   " if ok else "BAD ") + text, flush=True)
    print("bad:", bad)
