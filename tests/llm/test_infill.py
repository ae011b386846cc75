"""Fill-in-the-middle samples against a plain version."""

import random
import sys
from pathlib import Path

import brute
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent.parent))
from oracle import connect  # noqa: E402

from lodestat.llm import infill  # noqa: E402
from lodestat.llm.queries import ORACLES, QUERIES  # noqa: E402
from lodestat.llm.words import bytes_of  # noqa: E402


def check(df, rows):
    got = infill.transform(df).collect()

    def order(r):
        return (r[0] is not None, r[0] or 0, r[1:2] or "", str(r))

    found = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got), key=order)
    assert found == sorted(((i, *brute.infill(i, t), t or "") for i, t in rows), key=order)


def test_query_equals_sql(spark, data):
    name = "op12_fill_in_middle"
    got, want = QUERIES[name](spark, data), connect(data).execute(ORACLES[name])
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_unit_ends_and_code_points_of_random_texts():
    random.seed(2)
    alphabet = "ab \t\n\x0b\x0c\r\x08\x0e\x1f!\x7fé中😀  \x00"
    for _ in range(300):
        texts = ["".join(random.choices(alphabet, k=random.randint(0, 40))) for _ in range(random.randint(1, 9))]
        data, offsets = bytes_of(pa.array(texts))
        ends, heads = infill.unit_marks(data, offsets)
        want, at = [], 0
        for t in texts:
            for u in brute.UNIT.findall(t):
                at += len(u.encode())
                want.append(at - 1)
        assert ends.select(np.arange(len(want))).tolist() == want
        assert np.diff(heads.rank(offsets)).tolist() == [len(t) for t in texts]
        assert np.diff(ends.rank(offsets)).tolist() == [len(brute.UNIT.findall(t)) for t in texts]


def test_edges(spark):
    long = "é word\t" * 150_000
    texts = [None, "", " ", " \n\t", "a", " a", "a ", "a b", "x <P> y", "x <S>", "<M>", "<p> <s>", "<P", "中 文 字", long, "z" * 3_000_000, "\x00 \x00"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(texts)] + [(3, "again and again"), (3, "again and again"), (None, "no id here"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df, rows)
    clash = {c: F.lit("other") for c in ("n", "form", "output", "restored", "prefix_chars", "ends", "heads")}
    check(df.withColumns(clash), rows)
    assert infill.transform(df.where("false")).count() == 0


def test_forms_and_round_trip(spark):
    rows = [(i, "one two three four five six") for i in range(2000)]
    got = infill.transform(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    share = {f: sum(r.form == f for r in got) / 2000 for f in ("plain", "spm", "psm")}
    assert abs(share["plain"] - 0.5) < 0.04 and abs(share["spm"] - 0.4) < 0.04
    assert all(infill.restore(r.output, r.form) == "one two three four five six" for r in got)
