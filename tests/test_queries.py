"""Every registered query against its SQL on the smallest tables; the others run and have rows."""

import pytest
from conftest import SF, same_rows

from atomweave import entries


@pytest.mark.parametrize("name", [n for n in entries.QUERIES if n in entries.SQL])
def test_query_matches_sql(spark, duck, name):
    same_rows(entries.QUERIES[name](spark, SF), duck.sql(entries.SQL[name]))


@pytest.mark.parametrize("name", [n for n in entries.QUERIES if n not in entries.SQL])
def test_query_runs(spark, name):
    assert entries.QUERIES[name](spark, SF).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(entries.SQL) <= set(entries.QUERIES)


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(entries.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
