"""Every query with SQL gives what DuckDB gives, at the smallest scale."""

import pytest
from conftest import DATA
from oracle import compare, connect

from sortlane.plans import QUERIES, SQL

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    compare(spark, con, QUERIES[name], SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
