"""Every registered query against its SQL."""

from __future__ import annotations

import pytest
from oracle import database, differences

import __spark_entry__ as entry_points

QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert differences(df, con, SQL[name]) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["shard_id", "batch_id", "n_rows", "first_key", "checkpoint"]
    assert df.count() > 0


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)
