"""Retry, dead letters, fan-out and sink frames."""

from __future__ import annotations

import json
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from rowferry import FieldSpec, SyncOptions, SyncSpec, Target, fan_out, register_sink
from rowferry.operators import delivery
from rowferry.operators.batches import assign_batches
from rowferry.operators.sharding import with_shards
from rowferry.sinks import frames
from rowferry.sinks.registry import find_sink, index_options, kafka_options, sink_names, write_files

# Test classes run in Python workers, which cannot import this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FAST = SyncOptions(batch_size=10, max_retries=3, retry_initial_delay_ms=1)
SPEC = SyncSpec(
    entity="t",
    target_table="things",
    fields=(FieldSpec("id", "Long", checkpoint=True, role="id"), FieldSpec("name", role="key", target="label")),
)


class Failing:
    """Fails a given number of times."""

    def __init__(self, times: int) -> None:
        self.left = times

    def __call__(self) -> None:
        if self.left:
            self.left -= 1
            raise OSError("down")


def test_backoff():
    assert delivery.backoff_schedule(SyncOptions()) == [1000, 2000, 4000]
    assert delivery.backoff_schedule(SyncOptions(retry_backoff_factor=1.5)) == [1000, 1500, 2250]


@pytest.mark.parametrize(
    ("times", "attempts", "waits", "error"),
    [(0, 1, [], None), (3, 4, [1.0, 2.0, 4.0], None), (4, 4, [1.0, 2.0, 4.0], "OSError: down")],
)
def test_retry_schedule(times, attempts, waits, error):
    slept: list[float] = []
    got = delivery.call_with_retry(Failing(times), SyncOptions(), sleep=slept.append)
    assert got == (attempts, int(sum(waits) * 1000), error)
    assert slept == waits


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(95).select(F.col("id"), F.concat(F.lit("n"), "id").alias("label"))
    return assign_batches(with_shards(df, "id", 2), "id", 10)


class Picky:
    def __init__(self) -> None:
        self.tries: dict[int, int] = {}

    def __call__(self, table) -> None:
        assert table.column_names == ["id", "label"]
        assert table.num_rows <= 10
        first = min(table["id"].to_pylist())
        self.tries[first] = self.tries.get(first, 0) + 1
        if first == 40 or (first == 21 and self.tries[first] < 3):
            raise ConnectionError("no")


def test_deliver(spark, rows):
    outcomes = delivery.deliver(rows, Picky(), FAST, key="id")
    assert outcomes.agg(F.sum("n_rows")).first()[0] == 95
    seen = {(r["shard_id"], r["batch_id"]): r for r in outcomes.collect()}
    assert len(seen) == 10
    assert (seen[0, 2]["attempts"], seen[0, 2]["delivered"], seen[0, 2]["error"]) == (4, False, "ConnectionError: no")
    assert (seen[1, 1]["attempts"], seen[1, 1]["delivered"], seen[1, 1]["retries"]) == (3, True, 2)
    dead = delivery.dead_letters(rows, outcomes, "t1", "r1").collect()
    assert sorted(json.loads(r["row_json"])["id"] for r in dead) == list(range(40, 60, 2))
    points = {r["shard_id"]: (r["checkpoint"], r["outcome"]) for r in delivery.delivered_checkpoints(outcomes).collect()}
    assert points == {0: (38, "failed"), 1: (93, "completed")}


def test_first_batch_failed_has_no_checkpoint(spark, rows):
    def refuse(table) -> None:
        raise ConnectionError("no")

    outcomes = delivery.deliver(rows, refuse, SyncOptions(max_retries=0), key="id")
    points = delivery.delivered_checkpoints(outcomes).collect()
    assert {(r["checkpoint"], r["outcome"]) for r in points} == {(None, "failed")}


def test_sink_names():
    assert {"JDBC", "KAFKA", "ELASTICSEARCH"} <= set(sink_names())
    assert find_sink(" jdbc ") is find_sink("JDBC")
    for name in ("RABBITMQ", "", None):
        with pytest.raises(ValueError, match="unsupported target type"):
            find_sink(name)


@pytest.fixture
def mapped(spark):
    return spark.createDataFrame([(1, "a"), (2, None)], "id bigint, label string")


def test_kafka_frame(mapped):
    out = sorted(map(tuple, frames.kafka_records(mapped, SPEC).collect()))
    assert out == [
        ("things", "a", '{"id":1,"label":"a"}'),
        ("things", "null", '{"id":2,"label":null}'),
    ]
    no_key = SyncSpec(fields=(FieldSpec("id", "Long", checkpoint=True),))
    assert frames.kafka_records(mapped, no_key, "t").first()["key"] is None


def test_index_frames(mapped):
    docs = frames.index_documents(mapped, SPEC)
    assert sorted(map(tuple, docs.collect()))[0] == ("things", "1", '{"id":1,"label":"a"}')
    lines = frames.bulk_lines(docs).orderBy("value").first()["value"].split("\n")
    assert [json.loads(x) for x in lines] == [{"index": {"_index": "things", "_id": "1"}}, {"id": 1, "label": "a"}]
    no_id = SyncSpec(entity="things", fields=(FieldSpec("id", "Long", checkpoint=True),))
    line = frames.bulk_lines(frames.index_documents(mapped, no_id)).first()["value"]
    assert json.loads(line.split("\n")[0]) == {"index": {"_index": "things"}}


def test_index_mapping():
    spec = SyncSpec(
        fields=(
            FieldSpec("id", "Long", checkpoint=True),
            FieldSpec("at", "Date", target="when"),
            FieldSpec("name", "String"),
            FieldSpec("price", "Double"),
        ),
    )
    assert frames.index_mapping(spec)["mappings"]["properties"] == {
        "id": {"type": "long"},
        "when": {"type": "date", "format": "date_hour_minute_second||date_hour_minute_second_millis"},
        "price": {"type": "double"},
    }


def test_kafka_and_index_files(spark, mapped, tmp_path):
    fan_out(
        mapped,
        SPEC,
        [
            Target("kafka", {"path": str(tmp_path / "k"), "topic": "x"}),
            Target("elasticsearch", {"path": str(tmp_path / "e")}),
        ],
    )
    assert {r["topic"] for r in spark.read.json(str(tmp_path / "k")).collect()} == {"x"}
    assert spark.read.text(str(tmp_path / "e")).count() == 4


def test_missing_connector_is_reported(mapped):
    out = fan_out(mapped, SPEC, [Target("KAFKA", {"kafka.bootstrap.servers": "nowhere:1"})])
    assert not out[0].delivered
    assert out[0].attempts == 1


def test_fan_out_retries_only_what_failed(spark, mapped, tmp_path):
    calls: list[str] = []

    def flaky(frame, spec, config) -> None:
        calls.append(config["name"])
        if config["name"] == "b" and calls.count("b") < 3:
            raise OSError("down")

    register_sink("flaky", flaky, repeatable=lambda config: True)
    targets = [Target("flaky", {"name": n}, n) for n in "abc"]
    out = fan_out(mapped, SPEC, targets, FAST)
    assert calls == ["a", "b", "b", "b", "c"]
    assert [(o.name, o.attempts, o.delivered) for o in out] == [("a", 1, True), ("b", 3, True), ("c", 1, True)]


def test_fan_out_stops_at_the_first_lost_target(spark, mapped):
    def lost(frame, spec, config) -> None:
        raise OSError("down")

    done: list[int] = []
    register_sink("lost", lost)
    register_sink("fine", lambda frame, spec, config: done.append(1))
    out = fan_out(mapped, SPEC, [Target("fine", {}), Target("lost", {}), Target("fine", {})], FAST)
    assert [o.delivered for o in out] == [True, False]
    assert out[1].attempts == 1
    assert done == [1]


def test_unknown_target_writes_nothing(mapped, tmp_path):
    with pytest.raises(ValueError, match="unsupported"):
        fan_out(mapped, SPEC, [Target("parquet", {"path": str(tmp_path / "p")}), Target("rabbitmq", {})])
    assert not (tmp_path / "p").exists()


def test_run_folder_is_replaced(spark, mapped, tmp_path):
    path = str(tmp_path / "out")
    for run in ("r1", "r1", "r2"):
        write_files(mapped, SPEC, {"path": path, "run_id": run})
    assert spark.read.parquet(path).groupBy("run_id").count().orderBy("run_id").collect() == [("r1", 2), ("r2", 2)]


def test_target_options():
    plain = kafka_options({"bootstrapServers": "h:1", "producer-acks": "1", "password": "x", "sasl-mechanism": "Z"})
    assert plain == {
        "kafka.bootstrap.servers": "h:1",
        "kafka.batch.size": "16384",
        "kafka.linger.ms": "5",
        "kafka.acks": "1",
        "kafka.retries": "3",
        "kafka.enable.idempotence": "true",
    }
    secure = kafka_options({"security-protocol": "SASL_SSL", "sasl-jaas-config": "j", "kafka.client.id": "c"})
    assert secure["kafka.security.protocol"] == "SASL_SSL"
    assert (secure["kafka.sasl.mechanism"], secure["kafka.sasl.jaas.config"], secure["kafka.client.id"]) == ("PLAIN", "j", "c")
    assert index_options({"clusterNodes": "a:9200,b:9200", "username": "u", "password": ""}) == {
        "es.nodes": "a:9200,b:9200",
        "es.net.http.auth.user": "u",
    }


def numbered(spark, parts):
    rows = [(i, i % 3, i // 30, f"v{i}") for i in range(300)]
    return spark.createDataFrame(rows, "id long, shard_id long, batch_id long, v string").repartition(parts)


def sent_files(folder):
    """Ids that ``keeping`` took, one file per batch."""
    return sorted(int(i) for f in folder.iterdir() for i in f.read_text().split())


def keeping(folder, gone=()):
    def send(rows):
        ids = rows["id"].to_pylist()
        if min(ids) // 30 in gone:
            raise delivery.TargetGone("closed")
        (folder / f"{min(ids)}-{time.time_ns()}").write_text(" ".join(map(str, ids)))

    return send


def test_a_gone_target_gets_the_rest_later(spark, tmp_path):
    folder, progress = tmp_path / "sent", str(tmp_path / "progress")
    folder.mkdir()
    first = delivery.deliver(numbered(spark, 2), keeping(folder, {4, 7}), FAST, key="id", progress=progress).collect()
    assert len(first) == 30
    assert {r["error"] for r in first if r["left_over"]} == {"TargetGone: closed"}
    assert not any(r["delivered"] for r in first if r["left_over"]) and any(r["left_over"] for r in first)
    rest = delivery.deliver(numbered(spark, 5), keeping(folder), FAST, key="id", progress=progress).collect()
    assert all(r["delivered"] and not r["left_over"] for r in rest)
    assert len(rest) == sum(r["left_over"] for r in first)
    assert sent_files(folder) == list(range(300))
    assert delivery.deliver(numbered(spark, 2), keeping(folder), FAST, key="id", progress=progress).count() == 0


def test_batches_of_committed_tasks_outlive_a_job_that_dies(spark, tmp_path):
    folder, progress = tmp_path / "sent", str(tmp_path / "progress")
    folder.mkdir()
    keep = keeping(folder)

    def dying(rows):
        if min(rows["id"].to_pylist()) // 30 == 9 and len(list(folder.iterdir())) < 30:
            for _ in range(600):  # the other tasks get time to commit
                if len(list(folder.iterdir())) >= 20:
                    break
                time.sleep(0.05)
            time.sleep(2)
            raise SystemExit(3)
        keep(rows)

    # So small a table would be one task otherwise.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        with pytest.raises(Exception, match="SystemExit|exit|Job aborted|Python worker"):
            delivery.deliver(numbered(spark, 8), dying, FAST, key="id", progress=progress)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    done = delivery.delivered_before(spark, progress).collect()
    assert 0 < len(done) < 30
    rest = delivery.deliver(numbered(spark, 8), keep, FAST, key="id", progress=progress).collect()
    assert len(rest) == 30 - len(done)
    assert set(sent_files(folder)) == set(range(300))


def test_batches_are_sent_from_their_partitions(spark, tmp_path):
    rows = spark.range(0, 95, 1, 3).selectExpr("id", "concat('v', id) AS v")
    folder, progress = tmp_path / "sent", str(tmp_path / "progress")
    folder.mkdir()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # batches span what Spark hands over
    try:
        first = delivery.deliver_in_place(rows, keeping(folder, {1}), FAST, key="id", progress=progress).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum(r["n_rows"] for r in first) == 95 and max(r["n_rows"] for r in first) == 10
    assert len({r["shard_id"] for r in first}) == 3
    assert any(r["left_over"] for r in first)
    rest = delivery.deliver_in_place(rows, keeping(folder), FAST, key="id", progress=progress).collect()
    assert sum(r["n_rows"] for r in rest) == sum(r["n_rows"] for r in first if not r["delivered"])
    assert sent_files(folder) == list(range(95))
    empty = delivery.deliver_in_place(rows.limit(0), keeping(folder), FAST, key="id", progress=str(tmp_path / "none"))
    assert empty.count() == 0
