from __future__ import annotations

from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowferry.operators.ranges import MOST_RANGES, bins_of, even_cuts, ranges_for
from rowferry.sources import jdbc

KEYS = st.lists(st.one_of(st.integers(-3, 3), st.integers(-(2**63), 2**63 - 1), st.integers(10**9, 10**9 + 500)), min_size=1)


def counter(keys, low, calls=None):
    """The same counts in plain Python."""

    def count(width, parent, parents):
        if calls is not None:
            calls.append((width, len(parents)))
        places = [k - low for k in keys]
        wanted = [p for p in places if not parents or p - p % parent in parents]
        return Counter(p - p % width for p in wanted).items()

    return count



def check(keys, cuts, ranges):
    most, by_range = -(-len(keys) // ranges), {}
    for k in keys:
        by_range.setdefault(sum(k >= c for c in cuts), []).append(k)
    assert cuts == sorted(set(cuts)) and len(cuts) <= 2 * ranges
    assert len(by_range) == len(cuts) + 1
    for held in by_range.values():
        assert len(held) <= most or len(set(held)) == 1


@settings(max_examples=200, deadline=None)
@given(KEYS, st.integers(1, 30))
def test_ranges_hold_their_share_or_a_single_key(keys, ranges):
    low, high = min(keys), max(keys)
    check(keys, even_cuts(low, high, len(keys), ranges, counter(keys, low)), ranges)


def test_only_heavy_bins_are_counted_again():
    keys, calls = [i**3 for i in range(20_000)], []
    cuts = even_cuts(0, keys[-1], len(keys), 40, counter(keys, 0, calls))
    check(keys, cuts, 40)
    assert 40 <= len(cuts) + 1 <= 60
    assert len(calls) > 2 and all(n < 4 * 40 for _, n in calls)


def test_a_hot_key_is_a_range_of_its_own():
    keys = [7] * 5_000 + list(range(10_000))
    cuts = even_cuts(0, 9_999, len(keys), 10, counter(keys, 0))
    check(keys, cuts, 10)
    assert {7, 8} <= set(cuts)


def test_counts_of_a_table(spark):
    rows = spark.range(3_000).select((F.col("id") * F.col("id") * F.col("id") - 10**6).alias("k"))
    rows = rows.union(spark.sql("select cast(null as bigint) from range(50)"))
    keys = [i**3 - 10**6 for i in range(3_000)]
    cuts = even_cuts(keys[0], keys[-1], len(keys), 12, bins_of(rows, "k", keys[0], keys[-1]))
    assert cuts == even_cuts(keys[0], keys[-1], len(keys), 12, counter(keys, keys[0]))
    wide = [-(2**63), 0, 5, 2**63 - 1]
    frame = spark.createDataFrame([(k,) for k in wide], "k bigint")
    check(wide, even_cuts(wide[0], wide[-1], 4, 4, bins_of(frame, "k", wide[0], wide[-1])), 4)


def test_counts_of_a_database_statement(spark):
    """The statement, run by Spark, counts what the DataFrame form counts."""
    keys = [i * i - 400 for i in range(2_500)]
    rows = spark.createDataFrame([(k,) for k in [*keys, None]], "k bigint")
    rows.createOrReplaceTempView("trial_bins")
    plain = bins_of(rows, "k", keys[0], keys[-1])
    for width, parent, parents in ((4_096, 0, []), (256, 4_096, [0, 8_192]), (1, 256, [256 * i for i in range(1_500)])):
        sql = jdbc.bins_query("trial_bins", "k", keys[0], width, parent, parents, "jdbc:mysql:")
        assert {tuple(r) for r in spark.sql(sql).collect()} == set(plain(width, parent, parents))


def test_number_of_ranges_comes_from_the_rows():
    assert [ranges_for(n) for n in (0, 1, 1_000_000, 1_000_001)] == [1, 1, 1, 2]
    assert ranges_for(10**13) == MOST_RANGES
    assert ranges_for(100, 7) == 15
