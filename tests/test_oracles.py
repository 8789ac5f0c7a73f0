"""Every registered query against its SQL on the small tables."""

import pytest

import __spark_entry__ as contract
from workload.check import connection, spark_rows, sql_rows
from workload.oracles import ORACLES
from workload.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    got = spark_rows(QUERIES[name](spark, sf))
    assert sum(got[1].values()) > 0
    assert got == sql_rows(con, ORACLES[name])


def test_entry(spark):
    assert contract.entry(spark).count() > 0
    assert set(ORACLES) == set(QUERIES)
    assert QUERIES.items() <= contract.queries().items()
    assert ORACLES.items() <= contract.oracle_sql().items()
