from __future__ import annotations

from pyspark.sql import functions as F

from rowferry.operators.counters import keep_rows, shard_counters, shard_times, time_maps, total_counters
from rowferry.operators.records import capped, latest_per_key, page, validate, validate_required
from rowferry.state import ledger


def test_latest_keeps_nulls_and_odd_names(spark):
    df = spark.createDataFrame(
        [("a", 1, "old", None), ("a", 3, None, "x"), ("a", 2, "mid", "y"), (None, 1, "n", "z")],
        "`the key` string, ts int, `a.b` string, c string",
    )
    out = latest_per_key(df, ["the key"], ["ts"])
    assert out.columns == df.columns
    assert {tuple(r) for r in out.collect()} == {("a", 3, None, "x"), (None, 1, "n", "z")}


def test_latest_is_combined_before_the_shuffle(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("ts"))
    plan = latest_per_key(df, ["k"], ["ts"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan
    assert "Window" not in plan


def test_page_and_cap(spark):
    df = spark.range(10)
    assert [r["id"] for r in page(df, 3, 4, order=["id"]).collect()] == [3, 4, 5, 6]
    assert [r["id"] for r in page(df, 8, 4, order=["id"]).collect()] == [8, 9]
    assert capped(df, 3, order=["id"]).count() == 3


def test_required_fields_in_order(spark):
    df = spark.createDataFrame([("a", "b"), (" ", None), ("a", ""), (None, "b")], "x string, y string")
    out = validate_required(df, {"x": "x missing", "y": "y missing"}).collect()
    assert [r["error"] for r in out] == [None, "x missing", "y missing", "x missing"]
    assert [r["error"] for r in validate(df, []).collect()] == [None] * 4


def test_filter_and_counters(spark):
    df = spark.createDataFrame(
        [(0, "", 5), (0, None, 6), (0, "why", 7), (1, "why", 8)], "shard_id bigint, reason string, k bigint"
    )
    assert sorted(r["k"] for r in keep_rows(df, F.col("reason")).collect()) == [5, 6]
    assert keep_rows(df).count() == 4
    per_shard = shard_counters(df, F.col("reason"), key="k")
    assert {tuple(r) for r in per_shard.collect()} == {(0, 3, 1, 2, 7), (1, 1, 1, 0, 8)}
    assert tuple(total_counters(per_shard).first()) == (4, 2, 2)
    assert tuple(total_counters(per_shard.where("false")).first()) == (0, 0, 0)


def test_times(spark):
    log = spark.createDataFrame(
        [(0, 0, 100, 150), (0, 1, 160, 180), (1, 0, 100, 400)],
        "shard_id bigint, batch_id bigint, start_ms bigint, end_ms bigint",
    )
    times = shard_times(log)
    assert {tuple(r) for r in times.collect()} == {(0, 80, 20), (1, 300, 300)}
    maps = time_maps(times).first()
    assert (maps["shard_durations"], maps["batch_times"]) == ({0: 80, 1: 300}, {0: 20, 1: 300})


def test_line_check_order(spark):
    lines = [
        {},
        {"taskId": "t"},
        {"taskId": "t", "sourceConfig": {"a": "b"}},
        {"taskId": "t", "sourceConfig": {"a": "b"}, "desConfig": {"a": "b"}, "sourceType": ""},
        {"taskId": "t", "sourceConfig": {"a": "b"}, "desConfig": {"a": "b"}, "sourceType": "mysql"},
        {"taskId": "t", "syncStats": {"status": "COMPLETED"}},
        {"syncStats": {"status": "COMPLETED"}},
    ]
    from rowferry.storage import control_rows

    out = ledger.checked(control_rows(spark, lines, ledger.LINE)).collect()
    assert [r["error"] for r in out] == [
        "taskId is empty",
        "sourceConfig is empty",
        "desConfig is empty",
        "sourceType is empty",
        None,
        None,
        "taskId is empty",
    ]
    assert out[5]["syncStats"]["taskId"] == "t"


def test_unpersisted_and_names(spark):
    df = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "task_id string, persisted boolean")
    assert sorted(r["task_id"] for r in ledger.unpersisted(df).collect()) == ["b", "c"]
    names = spark.createDataFrame([("a", "first")], "task_id string, task_name string")
    out = {r["task_id"]: r["task_name"] for r in ledger.with_task_name(df, names).collect()}
    assert out == {"a": "first", "b": "b", "c": "c"}


def test_mark_persisted_raises_the_version(spark):
    from datetime import datetime

    from rowferry.storage import control_rows

    lines = control_rows(spark, [{"taskId": "t", "syncStats": {"version": 4}}, {"taskId": "u", "syncStats": {"status": "x"}}], ledger.LINE)
    out = {r["taskId"]: r["syncStats"] for r in ledger.mark_persisted(lines, datetime(2026, 1, 2, 3, 4, 5)).collect()}
    assert (out["t"]["version"], out["t"]["persisted"], out["t"]["lastPersistTime"]) == (5, True, "2026-01-02 03:04:05")
    assert out["u"]["version"] == 1
