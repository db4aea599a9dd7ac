"""Every registered query against its SQL; queries without SQL must run and keep a stable schema."""

from __future__ import annotations

import pytest
from support import SF, same_rows

from plumbline import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(df.columns) == len(set(df.columns))
    assert len(df.collect()) > 0


def test_names_are_covered():
    ids = catalog.coverage()
    assert len(ids) > 200
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(entry.queries())
