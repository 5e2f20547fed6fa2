"""Every core query against its DuckDB form."""

from __future__ import annotations

import oracle
import pytest

from lodestone.plans import catalogue

MAY_BE_EMPTY = {"embedding_dim_check"}


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    df = catalogue.QUERIES[name](spark, str(oracle.DATA))
    if name in catalogue.ORACLE_SQL:
        assert oracle.same_rows(df, oracle.connect(), catalogue.ORACLE_SQL[name]) or name in MAY_BE_EMPTY
    else:
        assert df.count()


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1
