"""Every query of the catalog against its SQL."""

import pytest

import oracle
from codelode.plans import catalog

WITHOUT = sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, name):
    oracle.same(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name])


def test_every_query_has_sql():
    assert not WITHOUT


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["id", "file_id", "start_line", "start_column", "role", "position"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
