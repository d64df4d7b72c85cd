"""Every query with SQL against DuckDB on the small tables; the others must run and give rows."""

from __future__ import annotations

import pytest
from tests.compare import connect, rows

from docquarry.plans import registry

registry.load_all()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, small, con, name):
    df = registry.QUERIES[name](spark, small)
    want = con.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, small, name):
    assert registry.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_id", "chunk_id", "rank", "rerank_score", "rerank_rank"]
