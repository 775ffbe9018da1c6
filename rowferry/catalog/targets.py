"""Sink frames, file sinks, fan-out and batch delivery."""

from __future__ import annotations

from dataclasses import replace

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.catalog.registry import EVENT_MESSAGES, EVENTS, query, table, table_path
from rowferry.operators import delivery
from rowferry.operators.batches import BATCH, assign_batches
from rowferry.operators.mapping import map_columns
from rowferry.operators.records import capped
from rowferry.operators.sharding import SHARD, with_shards
from rowferry.plans.run import SyncFailed, SyncTask, run_batches
from rowferry.sinks import frames
from rowferry.sinks.registry import Target, fan_out, register_sink, write_files
from rowferry.spec import FieldSpec, SyncOptions, SyncSpec
from rowferry.state.checkpoints import CheckpointLog
from rowferry.state.ledger import Ledger
from rowferry.storage import new_folder

_JSON = "'{\"event_id\":' || event_id || ',\"user\":' || user_id || ',\"type\":\"' || event_type || '\"}'"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_columns(table(spark, sf_dir, "events"), EVENT_MESSAGES)


@query(f"SELECT 'event_messages' AS topic, CAST(user_id AS VARCHAR) AS key, {_JSON} AS value FROM events")
def kafka_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message records: topic, key text, JSON value."""
    return frames.kafka_records(_messages(spark, sf_dir), EVENT_MESSAGES)


@query(
    "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'null') AS key, "
    "'{\"quality\":' || coalesce(CAST(l.quality AS VARCHAR), 'null') || '}' AS value "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
)
def kafka_null_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULL fields stay in the JSON; a NULL key value is the text ``null``."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    joined = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.select(
        "doc_id", frames.record_key("quality").alias("key"), frames.json_value(["quality"]).alias("value")
    )


@query(f"SELECT 'event_messages' AS _index, CAST(event_id AS VARCHAR) AS _id, {_JSON} AS doc FROM events")
def es_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search documents: index, id, JSON document."""
    return frames.index_documents(_messages(spark, sf_dir), EVENT_MESSAGES)


@query(
    "SELECT '{\"index\":{\"_index\":\"event_messages\",\"_id\":\"' || event_id || '\"}}' || chr(10) || "
    f"{_JSON} AS value FROM events"
)
def es_bulk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as bulk text."""
    return frames.bulk_lines(frames.index_documents(_messages(spark, sf_dir), EVENT_MESSAGES))


_MAPPED = "SELECT event_id, ts AS event_time, user_id, event_type AS type, value AS amount FROM events"


@query(_MAPPED)
def file_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as a run's own partition, twice: a repeated run replaces itself."""
    path = new_folder(spark, "file-sink")
    mapped = map_columns(table(spark, sf_dir, "events"), EVENTS)
    for _ in range(2):
        write_files(mapped, EVENTS, {"path": path, "run_id": "run-1"})
    return spark.read.parquet(path).drop("run_id")


@query(_MAPPED)
def snappy_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows through a compressed columnar file."""
    path = new_folder(spark, "snappy")
    write_files(map_columns(table(spark, sf_dir, "events"), EVENTS), EVENTS, {"path": path, "codec": "snappy"})
    return spark.read.parquet(path)


@query("SELECT event_id, ts AS event_time, user_id, event_type AS type, value AS amount, true AS compressed FROM events")
def compressed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows through files of a codec that is not the default; the file names carry it."""
    path = new_folder(spark, "compressed")
    write_files(map_columns(table(spark, sf_dir, "events"), EVENTS), EVENTS, {"path": path, "codec": "gzip"})
    return spark.read.parquet(path).withColumn("compressed", F.col("_metadata.file_name").endswith(".gz.parquet"))


@query(
    "SELECT target, event_id, user_id, type FROM ("
    "SELECT unnest(['first', 'second', 'third']) AS target) "
    "CROSS JOIN (SELECT event_id, user_id, event_type AS type FROM events)"
)
def fan_out_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows delivered to three targets."""
    root = new_folder(spark, "fan-out")
    kinds = {"first": "parquet", "second": "json", "third": "PARQUET"}
    targets = [Target(kind, {"path": f"{root}/{name}"}, name) for name, kind in kinds.items()]
    mapped = map_columns(table(spark, sf_dir, "events"), EVENTS)
    outcomes = fan_out(mapped, EVENTS, targets, run_id="run-1")
    if not all(o.delivered for o in outcomes):
        raise RuntimeError(f"fan-out failed: {outcomes}")
    out = None
    for name, kind in kinds.items():
        read = spark.read.format(kind.lower()).schema(mapped.schema).load(f"{root}/{name}")
        rows = read.select(F.lit(name).alias("target"), "event_id", "user_id", "type")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT event_id, user_id FROM events")
def custom_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sink registered by name is chosen like a built-in one."""
    path = new_folder(spark, "custom-sink")
    register_sink("orc-folder", lambda mapped, spec, config: mapped.write.mode("overwrite").orc(config["path"]))
    mapped = map_columns(table(spark, sf_dir, "events"), EVENTS)
    outcomes = fan_out(mapped, EVENTS, [Target("ORC-Folder", {"path": path})])
    if not outcomes[0].delivered:
        raise RuntimeError(outcomes[0].error)
    return spark.read.orc(path).select("event_id", "user_id")


class FaultySend:
    """A target for trials: batches whose first key is 0 modulo 3 always fail, those
    with 1 fail on the first attempt."""

    def __init__(self) -> None:
        self.seen: set[int] = set()

    def __call__(self, rows: pa.Table) -> None:
        first = pc.min(rows["event_id"]).as_py()
        if first % 3 == 0:
            raise ConnectionError("refused")
        if first % 3 == 1 and first not in self.seen:
            self.seen.add(first)
            raise ConnectionError("try again")


_RETRY = SyncOptions(batch_size=500, max_retries=2, retry_initial_delay_ms=1)
_BATCHED = (
    "SELECT event_id, event_id % 4 AS shard_id, "
    "(row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) - 1) // 500 AS batch_id FROM events"
)
_MANIFEST = (
    "SELECT shard_id, batch_id, count(*) AS n_rows, min(event_id) AS first_key, max(event_id) AS checkpoint "
    f"FROM ({_BATCHED}) GROUP BY shard_id, batch_id"
)


def _delivered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    rows = assign_batches(with_shards(events, "event_id", 4), "event_id", _RETRY.batch_size)
    return rows, delivery.deliver(rows, FaultySend(), _RETRY, key="event_id")


@query(
    "SELECT shard_id, batch_id, n_rows, CASE first_key % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS attempts, "
    f"first_key % 3 <> 0 AS delivered FROM ({_MANIFEST})"
)
def delivery_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches handed to a faulty target: attempts and result of each."""
    return _delivered(spark, sf_dir)[1].select(SHARD, BATCH, "n_rows", "attempts", "delivered")


@query(
    "SELECT b.shard_id, b.batch_id, b.event_id, 'ConnectionError: refused' AS reason "
    f"FROM ({_BATCHED}) b JOIN ({_MANIFEST}) m ON b.shard_id = m.shard_id AND b.batch_id = m.batch_id "
    "WHERE m.first_key % 3 = 0"
)
def delivery_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the batches that stayed undelivered."""
    dead = delivery.dead_letters(*_delivered(spark, sf_dir), "task", "run")
    event = F.get_json_object("row_json", "$.event_id").cast("bigint")
    return dead.select(SHARD, BATCH, event.alias("event_id"), "reason")


@query(
    f"WITH m AS ({_MANIFEST}), bad AS (SELECT shard_id, min(batch_id) AS bad FROM m WHERE first_key % 3 = 0 GROUP BY 1) "
    "SELECT m.shard_id, max(CASE WHEN bad IS NULL OR batch_id < bad THEN checkpoint END) AS checkpoint, "
    "CASE WHEN max(bad) IS NULL THEN 'completed' ELSE 'failed' END AS outcome "
    "FROM m LEFT JOIN bad ON m.shard_id = bad.shard_id GROUP BY m.shard_id"
)
def delivery_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each shard may resume after such a run."""
    return delivery.delivered_checkpoints(_delivered(spark, sf_dir)[1])


_FOUR_SHARDS = SyncSpec(
    fields=(
        FieldSpec("event_id", "Long", checkpoint=True, role="id"),
        FieldSpec("user", "Long", source="user_id", target="user_id"),
    ),
    options=replace(_RETRY, min_shards=4, max_shards=4),
)


def _batch_run(spark: SparkSession, sf_dir: str) -> str:
    """Run into the faulty target; the state folder of the failed run."""
    state = new_folder(spark, "run-batches")
    task = SyncTask(
        "events-push", "push events", "parquet", "parquet", {"path": table_path(sf_dir, "events")}, {"path": state}, _FOUR_SHARDS
    )
    try:
        run_batches(spark, task, FaultySend(), state)
    except SyncFailed:
        return state
    raise RuntimeError("the faulty target took everything")


@query("SELECT unnest(range(0, 4)) AS shard_id, (SELECT CAST(max(event_id) AS VARCHAR) FROM events) AS checkpoint")
def run_batches_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints a run into a faulty target leaves behind: lost batches are dead letters and are passed."""
    log = CheckpointLog(spark, f"{_batch_run(spark, sf_dir)}/checkpoints")
    return log.load("events-push").select(SHARD, "checkpoint")


@query(
    f"WITH m AS ({_MANIFEST}), b AS (SELECT count(DISTINCT shard_id) AS n FROM m WHERE first_key % 3 = 0) "
    "SELECT 'FAILED' AS status, CAST(sum(n_rows) AS BIGINT) AS total, "
    "CAST(sum(n_rows) FILTER (WHERE first_key % 3 <> 0) AS BIGINT) AS processed, "
    "CAST(sum(CASE first_key % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END) AS BIGINT) AS retries, "
    "4 - max(b.n) AS completed, max(b.n) AS failed FROM m, b"
)
def run_batches_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of that run: its shards and retries."""
    stats = Ledger(spark, f"{_batch_run(spark, sf_dir)}/ledger").task_stats("events-push")
    return stats.select(
        "status",
        F.col("totalRecords").alias("total"),
        F.col("processedRecords").alias("processed"),
        F.col("retryCount").alias("retries"),
        F.col("completedShards").alias("completed"),
        F.col("failedShards").alias("failed"),
    )


@query(
    f"SELECT b.shard_id, b.batch_id, e.event_id, e.user_id FROM ({_BATCHED}) b "
    f"JOIN ({_MANIFEST}) m ON b.shard_id = m.shard_id AND b.batch_id = m.batch_id "
    "JOIN events e ON e.event_id = b.event_id WHERE m.first_key % 3 = 0"
)
def run_batches_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that run could not deliver, as its dead-letter table keeps them."""
    dead = spark.read.parquet(f"{_batch_run(spark, sf_dir)}/dead_letters")
    row = F.from_json("row_json", "event_id bigint, user_id bigint")
    return dead.select(SHARD, BATCH, row["event_id"].alias("event_id"), row["user_id"].alias("user_id"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 1000")
def failed_batch_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of at most 1,000 dead letters; the table behind it stays whole."""
    dead = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return capped(dead, SyncOptions().max_failed_batches, order=["l_orderkey", "l_linenumber"])
