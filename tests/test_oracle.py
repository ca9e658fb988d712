"""Every registered query against its SQL, on the smallest given tables."""

import os

import pytest

from checks import QUERIES, SQL
from checks.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert len(got.columns) > 0
    if name in SQL:
        problem = differences(got, con.execute(SQL[name]).df())
        assert problem is None, problem


def test_contract(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() == 3
