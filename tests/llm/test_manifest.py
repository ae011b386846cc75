"""The Merkle manifest against a plain version."""

import random
import zlib

import brute
import pytest
from pyspark.sql import functions as F

from lodestat.llm import manifest
from lodestat.llm.queries import QUERIES

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def hit(row):
    i, source, lang, n, text = row
    tampered = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and n is not None
    return (i, source, lang, n + 1, text) if tampered else row


def run(df):
    changes = {"n_chars": F.col("n_chars") + F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, 1).otherwise(0)}
    return manifest.manifest(df, tampered=changes)


def same(got, rows):
    def order(r):
        return (r[0] is not None, r[0] or 0, r[1:])

    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=order) == sorted(brute.merkle(rows, hit), key=order)


def test_query_equals_a_plain_version(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select(*manifest.FIELDS)
    got = QUERIES["op13_merkle_manifest"](spark, data)
    assert got.columns == COLUMNS
    same(got, [tuple(r) for r in docs.collect()])


@pytest.mark.parametrize("sizes", [[1], [3], [1, 1], [17, 8, 1, 1, 33], [1, 64, 65, 2, 1, 1, 1, 1, 9]])
def test_shapes(spark, monkeypatch, sizes):
    monkeypatch.setattr(manifest, "LEVELS", 2)
    monkeypatch.setattr(manifest, "RANKED_ROWS", 10)
    monkeypatch.setattr(manifest, "FEW_TARGETS", 3)
    random.seed(1)
    names = [None, "", "en", "é", "z", "zz", "Z", "en-GB", "0"]
    rows = [(random.randint(-50, 500), None if k % 5 == 0 else "web", names[g], None if k % 3 == 0 else k, "x" * (k % 4)) for g, n in enumerate(sizes) for k in range(n)]
    same(run(spark.createDataFrame(rows, SCHEMA)), rows)


def test_nulls_ties_long_texts_and_clashing_columns(spark):
    long = "é word " * 200_000
    rows = [(1, "a", "en", 3, "x"), (1, "a", "en", 3, "x"), (1, "a", "en", 4, "x"), (None, None, None, None, None), (None, None, None, None, None), (None, "b", "en", 1, ""), (2, "b", "en", 1, None), (3, "b", "fr", 1, long), (3, "b", "fr", 1, long)]
    df = spark.createDataFrame(rows, SCHEMA)
    clash = {c: F.lit("other") for c in ("tree", "level", "at", "total", "digest", "step", "key", "changed", "segment", "leaf", "root", "place", "tie")}
    same(run(df.withColumns(clash)), rows)


def test_empty_table_and_untampered_rows(spark):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0
    got = manifest.manifest(spark.createDataFrame([(k, "a", "en", 1, "t") for k in range(20)], SCHEMA)).collect()
    assert all(r.verified and r.folded_root == r.root for r in got) and {len(r.proof) for r in got} == {3, 5}
