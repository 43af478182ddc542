"""Every registered query against its SQL in DuckDB."""

import pytest
from check_oracle import compare, connect

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        ok, note = compare(df, con, SQL[name])
        assert ok, note
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
