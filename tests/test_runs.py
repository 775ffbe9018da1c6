"""Whole runs, the ledger and checkpoints."""

from __future__ import annotations

import sys
import uuid
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rowferry import FieldSpec, SyncOptions, SyncSpec, SyncTask, Target, register_sink, run, run_batches
from rowferry.functions import sizing
from rowferry.functions.encode import redact_text, redact_url
from rowferry.operators.counters import shard_tallies
from rowferry.operators.mapping import map_columns
from rowferry.operators.resume import ResumePoint, resume_filter
from rowferry.plans.run import SyncFailed, TaskRejected
from rowferry.sources.registry import open_source, register_data_source
from rowferry.spec import SpecError
from rowferry.state import checkpoints, ledger
from rowferry.streaming.incremental import read_target, sync_new_files

# Test classes run in Python workers, which cannot import this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPEC = SyncSpec(
    entity="t",
    fields=(FieldSpec("id", "Long", checkpoint=True, role="id"), FieldSpec("v", "Integer", source="text")),
    options=SyncOptions(max_retries=2, retry_initial_delay_ms=1),
)
DAY = datetime(2026, 1, 5, 10, 0)


def land(spark, path, low, high, bad=()):
    text = F.when(F.col("id").isin(*bad), F.lit("x")).otherwise(F.col("id").cast("string")) if bad else F.col("id").cast("string")
    spark.range(low, high).select("id", text.alias("text")).write.mode("append").parquet(str(path))


def task(tmp_path, **changes):
    settings = {
        "task_id": "t1",
        "task_name": "copy",
        "source_type": "parquet",
        "destination_type": "parquet",
        "source_config": {"path": str(tmp_path / "source"), "password": "hunter2"},
        "destination_config": {"path": str(tmp_path / "target")},
        "spec": SPEC,
    }
    return SyncTask(**{**settings, **changes})


def target_ids(spark, tmp_path):
    return sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "target")).select("id").collect())


def test_run_then_new_rows(spark, tmp_path):
    state = str(tmp_path / "state")
    land(spark, tmp_path / "source", 0, 100)
    first = run(spark, task(tmp_path), state, now=DAY).first()
    assert (first["status"], first["totalRecords"], first["processedRecords"]) == ("COMPLETED", 100, 100)
    assert first["completedShards"] == first["shardCount"] > 0
    with pytest.raises(TaskRejected, match="already completed"):
        run(spark, task(tmp_path), state, now=DAY + timedelta(days=1))
    land(spark, tmp_path / "source", 100, 130)
    second = run(spark, task(tmp_path), state, now=DAY + timedelta(days=4)).first()
    assert (second["totalRecords"], second["processedRecords"]) == (130, 30)
    assert target_ids(spark, tmp_path) == list(range(130))
    log = checkpoints.CheckpointLog(spark, f"{state}/checkpoints").load("t1")
    assert log.agg(F.max(F.col("checkpoint").cast("int"))).first()[0] == 129


def test_rows_with_older_keys_are_not_picked_up(spark, tmp_path):
    state = str(tmp_path / "state")
    land(spark, tmp_path / "source", 50, 100)
    run(spark, task(tmp_path), state, guard=False)
    land(spark, tmp_path / "source", 0, 10)
    assert run(spark, task(tmp_path), state, guard=False).first()["processedRecords"] == 0


def test_empty_source(spark, tmp_path):
    land(spark, tmp_path / "source", 0, 0)
    out = run(spark, task(tmp_path), str(tmp_path / "state")).first()
    assert (out["status"], out["shardCount"], out["totalRecords"]) == ("COMPLETED", 0, 0)


def test_missing_settings_in_order(spark, tmp_path):
    for changes, message in [
        ({"task_id": " ", "task_name": ""}, "task id"),
        ({"task_name": None, "source_config": {}}, "task name"),
        ({"source_type": ""}, "source type"),
        ({"destination_type": "", "destination_config": {}}, "target type"),
        ({"source_config": {}}, "source config"),
        ({"destination_config": None}, "target config"),
    ]:
        with pytest.raises(TaskRejected, match=message):
            run(spark, task(tmp_path, **changes), str(tmp_path / "state"))
    with pytest.raises(ValueError, match="unsupported target type"):
        run(spark, task(tmp_path, destination_type="RABBITMQ"), str(tmp_path / "state"))
    with pytest.raises(ValueError, match="unsupported source type"):
        run(spark, task(tmp_path, source_type="mongodb"), str(tmp_path / "state"))


def test_failed_run_resumes_at_its_last_slice(spark, tmp_path):
    state, limit = str(tmp_path / "state"), [2]

    def breaks(mapped, spec, config) -> None:
        if not limit[0]:
            raise OSError("target down")
        limit[0] -= 1
        mapped.write.mode("append").parquet(config["path"])

    register_sink("breaks", breaks)
    land(spark, tmp_path / "source", 0, 200)
    broken = task(tmp_path, destination_type="breaks")
    with pytest.raises(SyncFailed, match="target down"):
        run(spark, broken, state, slices=4, now=DAY)
    assert target_ids(spark, tmp_path) == list(range(100))
    stats = ledger.Ledger(spark, f"{state}/ledger").task_stats("t1").first()
    assert (stats["status"], stats["failedShards"]) == ("FAILED", stats["shardCount"])
    limit[0] = 10
    again = run(spark, broken, state, slices=3, now=DAY + timedelta(minutes=5)).first()
    assert again["processedRecords"] == 100
    assert target_ids(spark, tmp_path) == list(range(200))


def test_lenient_run(spark, tmp_path):
    land(spark, tmp_path / "source", 0, 60, bad=(7, 33))
    with pytest.raises(SyncFailed, match="cannot convert"):
        run(spark, task(tmp_path), str(tmp_path / "strict"), now=DAY)
    out = run(spark, task(tmp_path), str(tmp_path / "state"), mode="lenient", now=DAY).first()
    assert (out["scannedRecords"], out["processedRecords"]) == (60, 58)
    assert target_ids(spark, tmp_path) == [i for i in range(60) if i not in (7, 33)]
    dead = spark.read.parquet(str(tmp_path / "state" / "dead_letters")).collect()
    assert {(r["record_id"], r["reason"], r["task_id"]) for r in dead} == {
        ("7", "cannot convert: v", "t1"),
        ("33", "cannot convert: v", "t1"),
    }


def test_two_targets(spark, tmp_path):
    land(spark, tmp_path / "source", 0, 30)
    both = task(tmp_path, more_targets=(Target("json", {"path": str(tmp_path / "second")}),))
    run(spark, both, str(tmp_path / "state"), stage=True)
    assert spark.read.json(str(tmp_path / "second")).count() == len(target_ids(spark, tmp_path)) == 30


def test_no_secret_reaches_the_ledger(spark, tmp_path):
    land(spark, tmp_path / "source", 0, 5)
    config = {"path": str(tmp_path / "target"), "apiToken": "s3cret", "url": "jdbc:mysql://bob:s3cret@db/x?user=bob&pw=s3cret"}
    register_sink("plain", lambda mapped, spec, c: mapped.write.mode("append").parquet(c["path"]))
    run(spark, task(tmp_path, destination_type="plain", destination_config=config), str(tmp_path / "state"))
    def leaks(mapped, spec, c) -> None:
        raise OSError(f"cannot reach {c['url']}")

    register_sink("leaks", leaks)
    with pytest.raises(SyncFailed):
        run(spark, task(tmp_path, task_id="t2", destination_type="leaks", destination_config=config), str(tmp_path / "state"))
    text = "".join(p.read_text() for p in Path(tmp_path / "state" / "ledger").rglob("*.json"))
    assert "t1" in text
    assert "cannot reach" in text
    assert "s3cret" not in text
    assert "hunter2" not in text


@pytest.mark.parametrize(
    ("url", "masked"),
    [
        ("jdbc:mysql://bob:p@ss@db:3306/x?user=bob&password=p#f", "jdbc:mysql://***@db:3306/x?user=***&password=***#f"),
        ("jdbc:sqlserver://db;user=sa;password=p", "jdbc:sqlserver://db;user=***;password=***"),
        ("jdbc:oracle:thin:scott/tiger@//db:1521/x", "jdbc:oracle:thin:***@//db:1521/x"),
        ("jdbc:postgresql://db/x", "jdbc:postgresql://db/x"),
    ],
)
def test_redact_url(spark, url, masked):
    assert spark.createDataFrame([(url,)], "u string").select(redact_url(F.col("u"))).first()[0] == masked


def lines(spark, rows):
    from rowferry.storage import control_rows

    return control_rows(spark, rows, ledger.LINE)


def test_ledger(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "ledger"))
    assert book.tasks().count() == 0
    config = {"taskId": "a", "taskName": "one", "sourceType": "mysql", "sourceConfig": {"u": "v"}, "desConfig": {"u": "v"}}
    for i in range(2):
        book.append(lines(spark, [{**config, "taskName": f"name {i}"}]), DAY + timedelta(seconds=i))
    book.append(lines(spark, [{**config, "taskId": "b", "desConfig": {}}]), DAY)
    stats = [
        {"taskId": "a", "taskName": "one", "syncStats": {"status": "STOPPED", "shardCount": 10, "failedShards": 20}},
        {"taskId": "c", "taskName": "c", "syncStats": {"status": "RUNNING", "taskId": ""}},
        {"taskId": "d", "taskName": "d", "syncStats": {"status": "COMPLETED"}},
        {"taskId": "", "syncStats": {"status": "COMPLETED"}},
    ]
    book.append(lines(spark, stats), DAY)
    assert [(r["taskId"], r["taskName"]) for r in book.tasks().collect()] == [("a", "name 1")]
    assert book.read().where("kind = 'config'").count() == 2
    assert {r["taskId"]: r["syncStats"]["taskId"] for r in book.stats().collect()} == {"a": "a", "c": "c", "d": "d"}
    assert book.task_stats("a").first()["failedShards"] == 20
    with pytest.raises(LookupError, match="no such task"):
        book.task_stats("zz")
    soon, later = DAY + timedelta(hours=1), DAY + timedelta(days=3, hours=1)
    assert {tuple(r) for r in book.blocked(soon).collect()} == {("c", "already running"), ("d", "already completed")}
    assert book.blocked(later).count() == 0
    parts = {p.parent.parent.name + "/" + p.parent.name for p in Path(tmp_path / "ledger").rglob("*.json")}
    assert parts == {f"dt=20260105/kind={kind}" for kind in ("config", "stats", "rejected")}
    assert {(r["taskId"], r["error"]) for r in book.rejected().collect()} == {
        ("b", ledger.NO_TARGET),
        ("", ledger.NO_TASK),
    }


def test_checkpoint_log(spark, tmp_path):
    log = checkpoints.CheckpointLog(spark, str(tmp_path / "cp"))
    assert log.load("t").count() == 0
    log.save("t", 2, {0: 10, 1: 11}, "r1", DAY)
    log.save("t", 2, {0: 20}, "r2", DAY + timedelta(hours=1))
    log.save("other", 2, {0: 99}, "r1", DAY)
    assert {(r["shard_id"], r["checkpoint"]) for r in log.load("t").collect()} == {(0, "20"), (1, "11")}
    log.delete("t", 1, 2, "r3", DAY + timedelta(hours=2))
    assert {(r["shard_id"], r["checkpoint"]) for r in log.load("t").collect()} == {(0, "20"), (1, None)}
    log.save("t", 3, {0: 30, 1: 31, 2: 32}, "r4", DAY + timedelta(hours=3))
    assert {(r["shard_count"], r["checkpoint"]) for r in log.load("t").collect()} == {(3, "30"), (3, "31"), (3, "32")}


@pytest.mark.parametrize(
    ("total", "high", "shards"),
    [(1367, 10, 10), (385, 10, 10), (3_000_000, 10, 10), (25_000_000, 10, 10), (3_000_000, 5, 5)]
    + [(1367, 64, 16), (25_000_000, 64, 25), (100_000_000, 64, 64)],
)
def test_shard_count(spark, total, high, shards):
    options = SyncOptions(max_shards=high)
    assert sizing.shard_count_of(total, options, 8, 4 * 2**30) == shards
    column = sizing.shard_count(F.lit(total).cast("bigint"), options, 8, 4 * 2**30)
    assert spark.range(1).select(column).first()[0] == shards


def test_status(spark):
    df = spark.createDataFrame(
        [(0, 0, 0, False), (9, 1, 0, False), (9, 0, 9, False), (9, 1, 1, False), (9, 0, 0, False), (9, 0, 0, True)],
        "total int, failed int, skipped int, late boolean",
    )
    out = df.select(
        sizing.run_status(F.col("total"), F.col("failed"), F.col("skipped"), F.col("late")),
        sizing.run_status_compat(F.col("total"), F.col("failed"), F.col("late")),
    ).collect()
    assert [tuple(r) for r in out] == [
        ("COMPLETED", "COMPLETED"),
        ("FAILED", "STOPPED"),
        ("PARTIAL", "COMPLETED"),
        ("FAILED", "STOPPED"),
        ("COMPLETED", "COMPLETED"),
        ("TIMEOUT", "TIMEOUT"),
    ]


def test_failed_shard_counts_once(spark):
    df = spark.createDataFrame([(0, "failed"), (0, "failed"), (1, "completed")], "shard_id int, outcome string")
    assert tuple(shard_tallies(df).first()) == (2, 1, 1, 0)


class Numbers(DataSource):
    """A partitioned source written in Python."""

    @classmethod
    def name(cls):
        return "numbers"

    def schema(self):
        return "id bigint, text string"

    def reader(self, schema):
        return NumbersReader()


class NumbersReader(DataSourceReader):
    def partitions(self):
        return [InputPartition(i) for i in range(4)]

    def read(self, partition):
        for i in range(10):
            yield partition.value * 10 + i, str(i)


def test_python_data_source(spark):
    register_data_source(spark, Numbers)
    df = open_source(spark, "NUMBERS", SPEC, {})
    assert df.rdd.getNumPartitions() == 4
    assert map_columns(df, SPEC).agg(F.sum("v")).first()[0] == 180


@pytest.mark.parametrize(
    ("text", "masked"),
    [
        ("login failed: password=hunter2", "login failed: password=***"),
        ("db.password = hunter2, user=me", "db.password = ***, user=me"),
        ('{"apiKey": "a b c", "n": 1}', '{"apiKey": ***, "n": 1}'),
        ("secret_token: x;y", "secret_token: ***;y"),
        ("Authorization token: Bearer abc.def ok", "Authorization token: *** ok"),
        ("jdbc:x://me:pw@host/db failed, pwd='a b'", "jdbc:x://***@host/db failed, pwd=***"),
        ("passwords were refused", "passwords were refused"),
        ("", ""),
        (None, None),
    ],
)
def test_secrets_in_messages_are_masked(spark, text, masked):
    found = spark.createDataFrame([(text,)], "t string").select(redact_text(F.col("t"))).first()[0]
    assert found == masked


def test_stream_two_drops_and_replay(spark, tmp_path):
    source, target = tmp_path / "drops", str(tmp_path / "target")
    spec = SyncSpec(fields=(FieldSpec("id", "Long", checkpoint=True), FieldSpec("text")))

    def sync(checkpoint, **how):
        schema = "id bigint, text string"
        sync_new_files(
            spark,
            str(source),
            spark.createDataFrame([], schema).schema,
            lambda rows: map_columns(rows, spec),
            target,
            str(tmp_path / checkpoint),
            timeout_seconds=120,
            **how,
        )

    land(spark, source, 0, 40)
    sync("cp")
    assert read_target(spark, target).count() == 40
    land(spark, source, 40, 100)
    sync("cp")
    sync("cp")
    assert sorted(r["id"] for r in read_target(spark, target).collect()) == list(range(100))
    sync("started over")
    assert sorted(r["id"] for r in read_target(spark, target).collect()) == list(range(100))


def test_stream_in_small_batches(spark, tmp_path):
    source, target = tmp_path / "drops", str(tmp_path / "target")
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).select("id", F.lit("x").alias("text")).coalesce(1).write.mode("append").parquet(
            str(source)
        )
    schema = spark.read.parquet(str(source)).schema
    for checkpoint in ("cp1", "cp2"):
        sync_new_files(spark, str(source), schema, lambda rows: rows, target, str(tmp_path / checkpoint), max_files=1)
        assert sorted(r["id"] for r in read_target(spark, target).collect()) == list(range(30))
    assert spark.read.parquet(target).select("batch_id").distinct().count() == 3


def test_replayed_rows_of_a_file_stay_where_they_are(spark, tmp_path):
    """A file's rows are not dealt by its name, nor a batch's by the attempt: they would meet in one task."""
    source, target, plans = tmp_path / "drops", str(tmp_path / "target"), []

    def seen(rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return rows

    spark.range(1000).coalesce(1).write.parquet(str(source))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the tables were large
    try:
        for checkpoint in ("cp1", "cp2"):
            sync_new_files(spark, str(source), spark.range(1).schema, seen, target, str(tmp_path / checkpoint))
        # Below it, file names alone are joined.
        assert len(plans) == 2 and "BroadcastHashJoin" in next(line for line in plans[1].splitlines() if "Join" in line)
        rows = read_target(spark, target)
        assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()
        assert rows.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_run_that_died_is_finished_under_its_own_id(spark, tmp_path):
    state, calls = str(tmp_path / "state"), []

    def dies(mapped, spec, config) -> None:
        mapped.write.mode("overwrite").parquet(f"{config['path']}/run_id={config['run_id']}")
        calls.append(config["run_id"])
        if len(calls) == 2:
            raise KeyboardInterrupt  # after the rows, before the checkpoint

    from rowferry.sinks import registry

    old = registry._sinks["PARQUET"]
    register_sink("PARQUET", dies, repeatable=lambda config: True)
    try:
        land(spark, tmp_path / "source", 0, 90)
        with pytest.raises(KeyboardInterrupt):
            run(spark, task(tmp_path), state, slices=3, guard=False)
        land(spark, tmp_path / "source", 90, 100)
        again = run(spark, task(tmp_path), state, guard=False).first()
    finally:
        register_sink("PARQUET", old, repeatable=registry._owns_folder)
    assert calls[1] == calls[2]
    assert (again["scannedRecords"], again["processedRecords"], again["status"]) == (70, 70, "COMPLETED")
    assert target_ids(spark, tmp_path) == list(range(100))


def test_table_without_any_key(spark, tmp_path):
    keyless = spark.range(50).select(F.lit(None).cast("bigint").alias("id"), F.lit("1").alias("text"))
    keyless.write.parquet(str(tmp_path / "source"))
    for status in ("COMPLETED", "COMPLETED"):
        assert run(spark, task(tmp_path), str(tmp_path / "state"), guard=False).first()["status"] == status
    assert spark.read.parquet(str(tmp_path / "target")).count() == 50
    keyless.limit(5).write.mode("append").parquet(str(tmp_path / "source"))
    out = run(spark, task(tmp_path), str(tmp_path / "state"), guard=False).first()
    assert (out["status"], out["processedRecords"], out["failedBatches"]) == ("COMPLETED", 5, [])
    assert run(spark, task(tmp_path), str(tmp_path / "state"), guard=False).first()["processedRecords"] == 0
    assert spark.read.parquet(str(tmp_path / "target")).count() == 55


def test_later_rows_without_a_key_where_nothing_was_noted(spark, tmp_path):
    """State of a version that kept no counts: they are reported, not delivered."""
    keyless = spark.range(50).select(F.lit(None).cast("bigint").alias("id"), F.lit("1").alias("text"))
    keyless.write.parquet(str(tmp_path / "source"))
    run(spark, task(tmp_path), str(tmp_path / "state"), guard=False)
    (tmp_path / "state" / "keyless").rename(tmp_path / "elsewhere")
    assert run(spark, task(tmp_path), str(tmp_path / "state"), guard=False).first()["status"] == "COMPLETED"
    keyless.limit(5).write.mode("append").parquet(str(tmp_path / "source"))
    out = run(spark, task(tmp_path), str(tmp_path / "state"), guard=False).first()
    assert (out["status"], out["processedRecords"]) == ("PARTIAL", 0)
    assert out["failedBatches"] == ["5 rows without a key came after the first run and were not delivered"]


def test_a_late_delivery_that_dies_is_finished_with_the_same_rows(spark, tmp_path):
    state, ids = str(tmp_path / "state"), []
    land(spark, tmp_path / "source", 0, 10)
    run(spark, task(tmp_path), state, guard=False)
    late = spark.range(30).select(F.lit(None).cast("bigint").alias("id"), (F.col("id") % 3).cast("string").alias("text"))
    late.write.mode("append").parquet(str(tmp_path / "source"))

    def dies(mapped, spec, config) -> None:
        registry.write_files(mapped, spec, config)
        ids.append(config["run_id"])
        if len(ids) == 1:
            raise KeyboardInterrupt  # after the rows, before they are noted

    from rowferry.sinks import registry

    old = registry._sinks["PARQUET"]
    register_sink("PARQUET", dies, repeatable=lambda config: True)
    try:
        with pytest.raises(KeyboardInterrupt):
            run(spark, task(tmp_path), state, guard=False)
        late.limit(3).write.mode("append").parquet(str(tmp_path / "source"))
        out = run(spark, task(tmp_path), state, guard=False).first()
    finally:
        register_sink("PARQUET", old, repeatable=registry._owns_folder)
    assert ids[0] == ids[1] != ids[2] and len(ids) == 3
    assert (out["status"], out["processedRecords"]) == ("COMPLETED", 33)
    assert spark.read.parquet(str(tmp_path / "target")).where("id is null").count() == 33


def test_later_rows_without_a_key_as_batches(spark, tmp_path):
    sent = spark.sparkContext.accumulator(0)
    rows = spark.range(20).select(F.lit(None).cast("bigint").alias("id"), F.lit("1").alias("text"))
    for expected in (20, 40, 40):
        if expected > sent.value:
            rows.write.mode("append").parquet(str(tmp_path / "source"))
        out = run_batches(spark, task(tmp_path), lambda t: sent.add(t.num_rows), str(tmp_path / "state"), guard=False)
        assert out.first()["status"] == "COMPLETED" and sent.value == expected


@pytest.mark.parametrize("kind", ["int", "bigint", "decimal(20,0)"])
def test_both_bounds_reach_the_scan(spark, tmp_path, kind):
    path = str(tmp_path / "keys")
    spark.range(0, 100, 2).select(F.col("id").cast(kind).alias("id")).write.parquet(path)
    point = ResumePoint(4, {s: 40 for s in range(4)})
    rows = resume_filter(spark.read.parquet(path), "id", point, high=60)
    assert sorted(int(r["id"]) for r in rows.collect()) == list(range(42, 61, 2))
    plan = rows._jdf.queryExecution().toString()
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line).split("PushedFilters")[1]
    assert "GreaterThan(id,40" in pushed
    assert "LessThanOrEqual(id,60" in pushed


def test_index_types(spark, tmp_path):
    land(spark, tmp_path / "source", 0, 5)
    spec = SyncSpec(fields=(FieldSpec("id", "Long", checkpoint=True, target_type="keyword"),))
    with pytest.raises(SpecError, match="index target"):
        run(spark, task(tmp_path, spec=spec), str(tmp_path / "state"))


def test_task_from_request(spark, tmp_path):
    land(spark, tmp_path / "source", 0, 25)
    request = {
        "taskId": "r1",
        "taskName": "from a request",
        "sourceType": "parquet",
        "destinationType": "PARQUET",
        "sourceConfig": {"path": str(tmp_path / "source")},
        "destinationConfig": {"path": str(tmp_path / "target")},
        "syncConfig": {"batchSize": 10, "maxShards": 3, "corePoolSize": 4, "lockTimeout": 9},
        "sourceFieldName": "log",
        "targetFieldName": "users",
        "fields": [
            {"javaField": "id", "sourceType": "Long", "targetType": "Long", "checkpoint": True, "role": "id"},
            {"javaField": "text", "sourceType": "String", "targetType": "Integer", "targetField": "n", "role": "data"},
        ],
    }
    given = SyncTask.from_request(request)
    assert (given.spec.options.batch_size, given.spec.options.max_shards) == (10, 3)
    out = run(spark, given, str(tmp_path / "state")).first()
    assert (out["processedRecords"], out["shardCount"]) == (25, 3)
    assert spark.read.parquet(str(tmp_path / "target")).agg(F.sum("n")).first()[0] == 300
    line = ledger.Ledger(spark, str(tmp_path / "state" / "ledger")).tasks().first()
    assert (line["sourceFieldName"], line["targetFieldName"], line["syncConfig"]["batchSize"]) == ("log", "users", 10)
    assert [f["targetField"] for f in line["fields"]] == ["id", "n"]


def test_batch_run_retried_after_failure(spark, tmp_path):
    state, box = str(tmp_path / "state"), str(tmp_path / "box")
    Path(box).mkdir()
    spec = SyncSpec(
        fields=(FieldSpec("id", "Long", checkpoint=True, target="key", target_type="String"),),
        options=SyncOptions(batch_size=10, max_retries=1, retry_initial_delay_ms=1, min_shards=2, max_shards=2),
    )

    def sender(refused):
        def send(table) -> None:
            keys = table["key"].to_pylist()
            if refused & set(keys):
                raise OSError("refused")
            Path(box, f"{min(keys)}-{uuid.uuid4().hex}").write_text("\n".join(keys))

        return send

    def delivered():
        return sorted(int(k) for p in Path(box).iterdir() for k in p.read_text().split())

    land(spark, tmp_path / "source", 0, 80)
    drop = F.when(F.col("id") == 5, F.lit("five")).otherwise(F.lit(""))
    push = task(tmp_path, spec=spec)
    with pytest.raises(SyncFailed, match="shard 0 batch 1: OSError: refused"):
        run_batches(spark, push, sender({"22"}), state, filter_key=drop, now=DAY)
    # Batch 1 of shard 0 is 20, 22, ..., 38.
    lost = set(range(20, 40, 2))
    assert delivered() == [i for i in range(80) if i != 5 and i not in lost]
    dead = spark.read.parquet(f"{state}/dead_letters").collect()
    assert {r["row_json"] for r in dead} == {f'{{"key":"{i}"}}' for i in lost}
    stats = ledger.Ledger(spark, f"{state}/ledger").task_stats("t1").first()
    assert (stats["status"], stats["failedShards"], stats["completedShards"]) == ("FAILED", 1, 1)
    assert (stats["scannedRecords"], stats["filteredRecords"], stats["processedRecords"]) == (80, 1, 69)
    assert (stats["retryCount"], set(stats["shardDurations"])) == (1, {"0", "1"})
    log = checkpoints.CheckpointLog(spark, f"{state}/checkpoints")
    # The checkpoint passes the lost batch, whose rows are dead letters: nothing is sent again.
    assert {(r["shard_id"], r["checkpoint"]) for r in log.load("t1").collect()} == {(0, "79"), (1, "79")}
    again = run_batches(spark, push, sender(set()), state, filter_key=drop, now=DAY + timedelta(minutes=1)).first()
    assert (again["status"], again["scannedRecords"]) == ("COMPLETED", 0)
    assert delivered() == [i for i in range(80) if i != 5 and i not in lost]


@pytest.mark.parametrize("step", [1, 2, 7])
def test_another_shard_count_repeats_and_loses_nothing(spark, tmp_path, step):
    state = str(tmp_path / "state")
    keys = spark.range(0, 200 * step, step).select("id", F.col("id").cast("string").alias("text"))
    keys.write.parquet(str(tmp_path / "source"))
    for day, (count, first) in enumerate(((4, 0), (6, 200 * step), (5, 210 * step))):
        if first:
            land(spark, tmp_path / "source", first, first + 10 * step)
        spec = SyncSpec(entity="t", fields=SPEC.fields, options=SyncOptions(min_shards=count, max_shards=count))
        run(spark, task(tmp_path, spec=spec), state, guard=False, now=DAY + timedelta(days=day))
    source = sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "source")).select("id").collect())
    assert target_ids(spark, tmp_path) == source
