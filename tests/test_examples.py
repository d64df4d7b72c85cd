"""The worked examples."""

from __future__ import annotations

import duckdb
import pytest

from tests.compare import rows
from tests.examples import EXAMPLES


@pytest.mark.parametrize("name", sorted(EXAMPLES))
def test_example(spark, name):
    make, sql = EXAMPLES[name]
    df, want = make(spark, ""), duckdb.connect().sql(sql)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
