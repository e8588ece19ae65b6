"""Every registered query beside its comparison SQL, and the driver contract."""

import pytest

import __spark_entry__ as contract
from tools.check_queries import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUERIES = contract.queries()
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    ok, note = compare(spark, duck, SF_DIR, name, QUERIES[name], ORACLES.get(name))
    assert ok, note


def test_entry(spark):
    assert contract.entry(spark).count() > 0
    assert set(ORACLES) <= set(QUERIES)
