"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import pytest
from oracle import compare, duck

import __spark_entry__ as entry
from plumbline.demos import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, sf, name):
    ok, message = compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf)
    assert ok, message


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["suite", "name", "type"] and df.count() == 9


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
