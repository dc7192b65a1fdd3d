"""Every registered query of the document engine against its oracle."""

import pytest
from oracle import connect, rows

from vellumspark.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, con, name):
    found = registry.queries()[name](spark, sf).toPandas()
    assert len(found)
    sql = registry.oracle_sql().get(name)
    if sql:
        expected = con.sql(sql).df()
        assert sorted(found.columns) == sorted(expected.columns)
        assert rows(found) == rows(expected)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
