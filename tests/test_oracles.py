"""Every registered query against its SQL oracle on the small data; rows-only where there is no oracle."""

import pytest

import __spark_entry__ as entry
from harness import compare, connect

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    rows, problem = compare(spark, con, sf, name, QUERIES[name], ORACLES.get(name))
    assert problem is None, problem
    assert rows >= 0


def test_entry(spark):
    assert entry.entry(spark).count() == 2


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
