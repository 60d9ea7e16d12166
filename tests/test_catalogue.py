from __future__ import annotations

import pytest

import __spark_entry__
from lakecairn.plans import catalogue
from tests.conftest import SF
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    assert same(catalogue.QUERIES[name](spark, SF), con, catalogue.ORACLES[name]) > 0


def test_entry_points(spark):
    queries = __spark_entry__.queries()
    assert set(catalogue.QUERIES) <= set(queries) and set(__spark_entry__.oracle_sql()) <= set(queries)
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
    assert __spark_entry__.entry(spark).count() > 0
