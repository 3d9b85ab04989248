"""Every query against its SQL in an independent engine."""

import pytest
from oracle_check import compare, database

from __spark_entry__ import oracle_sql, queries


@pytest.fixture(scope="module")
def con(sf):
    pytest.importorskip("duckdb")
    return database(sf)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, sf, con, name):
    assert compare(queries()[name](spark, sf), con, oracle_sql()[name]) == []
