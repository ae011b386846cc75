"""Every query with a SQL twin gives the same values as DuckDB on the smallest tables."""

import pytest
from oracle import compare, connect

from lodestat.plans.catalog import ORACLES, QUERIES



@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, data, duck, name):
    ok, text = compare(spark, duck, name, QUERIES[name], ORACLES[name], data)
    assert ok, text


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 11
    assert set(entry.oracle_sql()) <= set(entry.queries())
