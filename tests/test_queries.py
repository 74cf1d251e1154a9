"""Every named query against its DuckDB oracle on the smallest data."""

import pytest
from conftest import SMALL, rows_of

from quadweave import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_oracle(spark, duck, name):
    ours = queries.QUERIES[name](spark, SMALL).toPandas()
    theirs = duck.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


def test_every_query_has_an_oracle():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert not e.entry(spark).isEmpty()
    assert set(queries.QUERIES) <= set(e.queries())
