"""Every core query with SQL beside DuckDB on the smallest tables."""

import pytest

from compare import rows, views
from reelsieve.plans import registry


@pytest.fixture(scope="module")
def con(small):
    return views(small)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, small, con, name):
    df = registry.QUERIES[name](spark, small)
    a = rows(df.columns, [tuple(r) for r in df.collect()])
    r = con.sql(registry.SQL[name])
    assert a == rows(r.columns, r.fetchall())


def test_all_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
