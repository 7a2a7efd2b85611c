"""Every registered query against its SQL on DuckDB, at the smallest scale."""

import pytest

import __spark_entry__ as contract
from riskloom.queries.check import connect, differences

NAMES = sorted(contract.queries())


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, sf_dir, name):
    query, sql = contract.queries()[name], contract.oracle_sql().get(name)
    if sql:
        assert differences(spark, duck, sf_dir, query, sql) == []
    else:
        assert query(spark, sf_dir).count() > 0


def test_entry(spark):
    assert len(contract.entry(spark).columns) > 1000
