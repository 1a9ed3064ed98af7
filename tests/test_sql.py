"""Every registered query against its SQL, over whole small tables."""

import pytest

from textmill import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["reason", "n"]
    assert set(e.oracle_sql()) <= set(e.queries())
