from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from rowferry.operators import surplus as module
from rowferry.operators.surplus import row_counts, surplus

SCHEMA = "a int, b string, c double"


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("copies", [1, 7, 10_000])
def test_surplus_is_the_difference_by_number(spark, monkeypatch, copies):
    monkeypatch.setattr(module, "COPIES", copies)
    all_rows = [(1, "x", 1.0)] * 50 + [(None, None, None)] * 3 + [(1, "", 1.0), (1, None, 1.0), (2, "y", -0.5)] * 2
    had = [(1, "x", 1.0)] * 20 + [(None, None, None)] * 3 + [(1, None, 1.0)] * 5 + [(9, "gone", 0.0)]
    counts = row_counts(spark.createDataFrame(had, SCHEMA))
    out = surplus(spark.createDataFrame(all_rows, SCHEMA), counts)
    assert out.schema == spark.createDataFrame([], SCHEMA).schema
    assert rows_of(out) == Counter(all_rows) - Counter(had)


def test_counts_add_up_over_several_lines(spark):
    df = spark.createDataFrame([(1, "x", 1.0)] * 9, SCHEMA)
    counts = row_counts(df.limit(4)).union(row_counts(df.limit(3)))
    assert rows_of(surplus(df, counts)) == Counter({(1, "x", 1.0): 2})


def test_empty_sides_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x")], "n int, digest string")
    nothing = row_counts(df.limit(0))
    assert rows_of(surplus(df, nothing)) == Counter({(1, "x"): 2})
    assert surplus(df.limit(0), row_counts(df)).count() == 0
    assert surplus(df.select(F.col("n").alias("a.b")), nothing).columns == ["a.b"]
