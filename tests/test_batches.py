"""Batch numbering on skewed, repeated and missing keys, against a plain count."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rowferry.operators.batches import assign_batches, batch_manifest, key_cuts
from rowferry.operators.sharding import SHARD, with_shards


def expected_manifest(keys, shards, size):
    by_shard = defaultdict(list)
    for k in keys:
        by_shard[0 if k is None else k % shards].append(k)
    out = set()
    for shard, members in by_shard.items():
        members.sort(key=lambda k: (k is not None, k or 0))
        for b in range(0, len(members), size):
            part = [k for k in members[b : b + size] if k is not None]
            n = len(members[b : b + size])
            out.add((shard, b // size, n, min(part, default=None), max(part, default=None)))
    return out


def frame(spark, keys):
    rows = [(k, f"row {i}") for i, k in enumerate(keys)]
    return with_shards(spark.createDataFrame(rows, "k bigint, payload string").repartition(4), "k", 3)


def keys_unique():
    return random.Random(1).sample(range(-5000, 100000), 900)


def keys_hot():
    rng = random.Random(2)
    return [42] * 400 + [7] * 150 + [rng.randrange(-300, 300) for _ in range(600)]


def keys_null():
    return [None] * 300 + list(range(500))


def keys_outlier():
    return [1, 2, 3] + [2**62 + i for i in range(800)]


def keys_one():
    return [5] * 700


@pytest.mark.parametrize("make", [keys_unique, keys_hot, keys_null, keys_outlier, keys_one])
@pytest.mark.parametrize("group", [10_000, 120, 25])
def test_manifest(spark, make, group):
    keys = make()
    out = batch_manifest(frame(spark, keys), "k", 40, rows_per_group=group).collect()
    assert {tuple(r) for r in out} == expected_manifest(keys, 3, 40)
    assert len(out) == len({(r[0], r[1]) for r in out})


@pytest.mark.parametrize("make", [keys_unique, keys_hot, keys_null, keys_outlier, keys_one])
@pytest.mark.parametrize("group", [10_000, 120, 25])
def test_assign(spark, make, group):
    keys = make()
    df = frame(spark, keys)
    out = assign_batches(df, "k", 40, rows_per_group=group).collect()
    assert Counter((r["k"], r["payload"]) for r in out) == Counter((r["k"], r["payload"]) for r in df.collect())
    got = defaultdict(list)
    for r in out:
        got[r[SHARD], r["batch_id"]].append(r["k"])
    seen = set()
    for (shard, batch), members in got.items():
        present = [k for k in members if k is not None]
        seen.add((shard, batch, len(members), min(present, default=None), max(present, default=None)))
    assert seen == expected_manifest(keys, 3, 40)


def test_copies_of_one_row(spark):
    """Equal rows cannot be told apart, but each still gets its place."""
    rows = [(9, "same")] * 1000 + [(9, "other")] * 3 + [(k, "x") for k in range(50)]
    df = with_shards(spark.createDataFrame(rows, "k bigint, payload string"), "k", 2)
    out = assign_batches(df, "k", 64, rows_per_group=30).collect()
    assert Counter((r["k"], r["payload"]) for r in out) == Counter(rows)
    sizes = Counter((r[SHARD], r["batch_id"]) for r in out)
    assert {k: v for k, v in sizes.items() if v != 64} == {(0, 0): 25, (1, 16): 1028 - 16 * 64}


@pytest.mark.parametrize("make", [keys_unique, keys_hot])
def test_groups_stay_small(spark, make):
    """No window group is much larger than asked for, whatever the key spread."""
    from pyspark.sql import functions as F

    from rowferry.operators.batches import with_segments

    df = frame(spark, make())
    cuts = key_cuts(df, "k", df.count(), 100)
    sizes = with_segments(df, "k", cuts).where(F.col("_place") % 2 == 0).groupBy("_bucket", "_place").count()
    assert sizes.agg(F.max("count")).first()[0] <= 300


def test_row_number_is_not_global(spark):
    """The segmented plan numbers rows per segment, with one shuffle of the rows."""
    df = frame(spark, keys_unique())
    plan = assign_batches(df, "k", 40, rows_per_group=100)._jdf.queryExecution().toString()
    assert "windowspecdefinition(shard_id" in plan
    assert "_bucket" in plan


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.one_of(st.none(), st.integers(-50, 50), st.integers(-(2**62), 2**62)), min_size=1, max_size=120),
    st.integers(1, 30),
    st.integers(3, 60),
)
def test_manifest_property(spark, keys, size, group):
    out = batch_manifest(frame(spark, keys), "k", size, rows_per_group=group).collect()
    assert {tuple(r) for r in out} == expected_manifest(keys, 3, size)


def test_hot_segments_keep_zero_signs_and_the_plain_order(spark):
    rows = [(5, -0.0 if i % 2 else 0.0, i % 40) for i in range(400)] + [(k, 1.5, k) for k in range(60)]
    df = with_shards(spark.createDataFrame(rows, "k bigint, v double, p bigint").repartition(3), "k", 1)
    one, many = (assign_batches(df, "k", 7, rows_per_group=n).collect() for n in (10**9, 20))

    def seen(found, *names):
        return Counter(tuple(str(r[n]) for n in names) for r in found)

    assert seen(one, "k", "v", "p") == seen(many, "k", "v", "p")
    assert seen(one, "k", "p", "batch_id") == seen(many, "k", "p", "batch_id")
