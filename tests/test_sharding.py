from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowferry.operators.resume import ResumePoint, parse_checkpoint, resume_filter, resume_point
from rowferry.operators.sharding import (
    SHARD,
    key_order,
    max_key_per_shard,
    one_shard,
    stride_bounds,
    stride_of,
    with_shards,
)
from rowferry.sources import jdbc


@pytest.fixture(scope="module")
def keys(spark):
    return spark.range(-5, 20).select(F.col("id").alias("k"))


def test_modulo_variants(keys):
    assert with_shards(keys, "k", 3).count() == 25
    assert with_shards(keys, "k", 3, how="signed").count() == 21
    assert with_shards(keys, "k", 3, how="abs").count() == 25
    assert with_shards(keys, "k", 3).select(SHARD).distinct().count() == 3


def test_null_keys(spark):
    df = spark.createDataFrame([(None,), (1,)], "k bigint")
    assert {tuple(r) for r in with_shards(df, "k", 4).collect()} == {(None, 0), (1, 1)}
    assert with_shards(df, "k", 4, how="signed").count() == 1


def test_shards_make_the_table(keys):
    parts = [one_shard(keys, "k", 4, i) for i in range(4)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    assert sorted(r["k"] for r in union.collect()) == list(range(-5, 20))


def test_max_key(keys):
    out = {r[SHARD]: r["max_key"] for r in max_key_per_shard(keys.where("k < 2"), "k", 8).collect()}
    assert out == {0: "0", 1: "1", 2: "", 3: "-5", 4: "-4", 5: "-3", 6: "-2", 7: "-1"}


def test_key_order_spreads_one_shard(spark):
    """All keys in one shard still use several tasks, each in key order."""
    df = with_shards(spark.range(1000).select((F.col("id") * 4).alias("k")).repartition(8), "k", 4)
    parts = key_order(df, "k", partitions=8).withColumn("p", F.spark_partition_id()).collect()
    assert len({r["p"] for r in parts}) > 4
    last: dict[int, int] = {}
    for r in parts:
        assert last.get(r["p"], -1) < r["k"]
        last[r["p"]] = r["k"]


@settings(max_examples=200, deadline=None)
@given(st.integers(-(2**40), 2**40), st.integers(0, 2**40), st.integers(1, 50))
def test_stride_bounds_cover(low, span, parts):
    bounds = stride_bounds(low, low + span, parts)
    assert bounds[0][0] is None and bounds[-1][1] is None
    assert [b for _, b in bounds[:-1]] == [a for a, _ in bounds[1:]]
    assert len(bounds) == min(parts, span + 1)


@pytest.mark.parametrize(("low", "high", "parts"), [(0, 99, 7), (-10, 10, 4), (5, 5, 3), (0, 2**61, 16)])
def test_stride_of_agrees_with_bounds(spark, low, high, parts):
    bounds = stride_bounds(low, high, parts)
    probes = sorted({low, high, *[c + d for a, _ in bounds if a is not None for c in [a] for d in (-1, 0, 1)]})
    df = spark.createDataFrame([(p,) for p in probes if low <= p <= high], "k bigint")
    for r in df.withColumn("r", stride_of("k", low, high, parts)).collect():
        a, b = bounds[r["r"]]
        assert (a is None or r["k"] >= a) and (b is None or r["k"] < b)


def test_parse_checkpoint():
    assert [parse_checkpoint(t) for t in (None, "", "  ", " 42 ")] == [None, None, None, 42]
    with pytest.raises(ValueError, match="invalid literal"):
        parse_checkpoint("abc")


def test_resume_is_pushed_down(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    out = resume_filter(df, "event_id", ResumePoint(2, {0: 40, 1: 31}), high=90)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(event_id,31)" in plan
    assert "LessThanOrEqual(event_id,90)" in plan
    assert "Join" not in plan
    got = {r["event_id"] for r in out.collect()}
    assert got == {k for k in range(91) if (k > 40 if k % 2 == 0 else k > 31)}


def test_resume_keeps_null_keys_once(spark):
    df = spark.createDataFrame([(None,), (1,), (2,)], "k bigint")
    assert resume_filter(df, "k", ResumePoint(2, {}), high=2).count() == 3
    assert resume_filter(df, "k", ResumePoint(2, {0: 0, 1: 0}), high=2).count() == 2
    assert resume_filter(df, "k", ResumePoint(2, {1: 1}), high=2).count() == 2


def test_many_shards_resume_by_join(spark):
    df = spark.range(3000).select(F.col("id").alias("k"))
    point = ResumePoint(300, {s: s * 3 for s in range(300)})
    want = {k for k in range(3000) if k > (k % 300) * 3}
    assert {r["k"] for r in resume_filter(df, "k", point).collect()} == want


def checkpoints(spark, rows):
    return spark.createDataFrame(rows, "shard_id bigint, shard_count bigint, checkpoint string")


def test_resume_point(spark):
    same = resume_point(checkpoints(spark, [(0, 2, "8"), (1, 2, None)]), 2)
    assert same == ResumePoint(2, {0: 8, 1: None})
    assert same.floor is None
    grown = resume_point(checkpoints(spark, [(0, 2, "8"), (1, 2, "5")]), 3)
    assert grown == ResumePoint(3, {0: 5, 1: 5, 2: 5})
    gap = resume_point(checkpoints(spark, [(0, 2, "8")]), 3)
    assert gap.floor is None
    assert resume_point(checkpoints(spark, []), 3).bounds == {}


def as_spark_sql(predicate: str) -> str:
    """The statement text is ANSI; Spark delimits names with backticks."""
    return predicate.replace('"', "`")


@pytest.mark.parametrize("how", ["pmod", "signed", "abs"])
def test_jdbc_modulo_predicates(spark, keys, how):
    df = keys.unionByName(spark.createDataFrame([(None,)], "k bigint"))
    point = ResumePoint(4, {1: 5, 2: 2})
    for p in (None, point):
        mine = with_shards(resume_filter(df, "k", p or ResumePoint(4, {}), high=15, how=how), "k", 4, how=how)
        want = sorted((r[SHARD], r["k"] if r["k"] is not None else -99) for r in mine.collect())
        got = []
        for shard, predicate in enumerate(jdbc.mod_predicates("k", 4, how=how, point=p, high=15)):
            got += [
                (shard, r["k"] if r["k"] is not None else -99) for r in df.where(as_spark_sql(predicate)).collect()
            ]
        assert sorted(got) == want


def test_jdbc_range_predicates(spark, keys):
    df = keys.unionByName(spark.createDataFrame([(None,)], "k bigint"))
    parts = [df.where(as_spark_sql(p)).count() for p in jdbc.range_predicates("k", [0, 7, 7, 12])]
    assert parts == [6, 7, 5, 8]
    assert jdbc.range_predicates("k", []) == ["1 = 1"]


def test_jdbc_options():
    options = jdbc.jdbc_options({"url": "jdbc:x", "username": "u", "password": "p", "driver": None}, "log")
    assert options == {"url": "jdbc:x", "user": "u", "password": "p", "dbtable": "log", "fetchsize": "1000"}
    assert jdbc.range_options("id", 0, 99, 200)["numPartitions"] == "100"
    assert jdbc.quoted('a"b') == '"a""b"'
    assert jdbc.bounds_query("log", "time") == (
        'SELECT COUNT(*) AS n_rows, MIN("time") AS low, MAX("time") AS high, COUNT("time") AS n_keys FROM log'
    )
    assert jdbc.max_key_query("log", "id", 3).endswith('GROUP BY MOD("id", 3)')
    assert jdbc.jdbc_options({"url": "jdbc:mysql://h/d"}, "log")["useCursorFetch"] == "true"
    assert jdbc.bounds_query("log", "time", "jdbc:mysql://h/d").startswith("SELECT COUNT(*) AS n_rows, MIN(`time`)")
    assert jdbc.mod_predicates("id", 2, how="signed", url="jdbc:sqlserver://h") == ['("id" % 2) = 0', '("id" % 2) = 1']
