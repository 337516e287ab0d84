"""Queries that SQL can express give DuckDB's rows."""

import pytest

from feedlens.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import assert_same, duck


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, data, name):
    assert_same(QUERIES[name](spark, data), duck(data), ORACLE_SQL[name])
