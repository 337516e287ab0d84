"""Every query with SQL of its own gives DuckDB's rows on the smallest tables."""

import pytest

from feedlens.registry import ORACLE_SQL, QUERIES
from tests.compare import assert_same, duck


@pytest.fixture(scope="module")
def con(data):
    return duck(data)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    assert_same(QUERIES[name](spark, data), con, ORACLE_SQL[name])
