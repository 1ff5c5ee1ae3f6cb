"""The queries that SQL can express against DuckDB."""

from __future__ import annotations

import pytest

from tessella.llm import queries
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), name, queries.QUERIES[name], queries.ORACLE_SQL[name], sf_dir) is None
