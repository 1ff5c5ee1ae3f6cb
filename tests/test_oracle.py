"""Every query that has SQL must give the same rows in DuckDB."""

from __future__ import annotations

import pytest

from tessella.plans import catalog

from .oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, con, sf_dir, name):
    assert compare(spark, con, name, catalog.QUERIES[name], catalog.ORACLE_SQL[name], sf_dir) is None
