"""Runs after runs: what targets hold once a task has been repeated, repaired or resumed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.catalog.registry import query, table, table_path
from rowferry.catalog.targets import _BATCHED, _MANIFEST, _RETRY, FaultySend
from rowferry.operators.batches import BATCH
from rowferry.operators.delivery import OUTCOME, TargetGone
from rowferry.operators.sharding import SHARD
from rowferry.plans.run import SyncFailed, SyncTask, run, run_batches
from rowferry.sinks.registry import Target, register_sender, register_sink
from rowferry.spec import FieldSpec, SyncOptions, SyncSpec
from rowferry.state.ledger import Ledger
from rowferry.storage import control_rows, new_folder
from rowferry.streaming.incremental import read_target, sync_new_files

_FIELDS = (FieldSpec("event_id", "Long", checkpoint=True, role="id"), FieldSpec("user_id", "Long"))


def _task(root: str, shards: int = 4, **changes) -> SyncTask:
    settings = {
        "task_id": "events-again",
        "task_name": "events in two drops",
        "source_type": "parquet",
        "destination_type": "parquet",
        "source_config": {"path": f"{root}/source"},
        "destination_config": {"path": f"{root}/target"},
        "spec": SyncSpec(fields=_FIELDS, options=SyncOptions(min_shards=shards, max_shards=shards, max_retries=0)),
    }
    return SyncTask(**{**settings, **changes})


def _drops(spark: SparkSession, sf_dir: str, key: Column, folder: str) -> Sequence[DataFrame]:
    """The events up to their middle and the rest, to be added to ``folder`` one after the other."""
    events = table(spark, sf_dir, "events")
    middle = events.agg(F.max("event_id")).first()[0] // 2
    rows = events.select(key.alias("event_id"), "user_id", (F.col("event_id") <= middle).alias("_first"))
    return [rows.where("_first").drop("_first"), rows.where("NOT _first").drop("_first")]


def _two_runs(spark: SparkSession, sf_dir: str, key: Column) -> DataFrame:
    """Two drops, each followed by a run with a shard count of its own; then a third run."""
    root = new_folder(spark, "reruns")
    for drop, shards in zip(_drops(spark, sf_dir, key, root), (4, 6), strict=True):
        drop.write.mode("append").parquet(f"{root}/source")
        run(spark, _task(root, shards), f"{root}/state", guard=False)
    run(spark, _task(root, 5), f"{root}/state", guard=False)
    return spark.read.parquet(f"{root}/target").drop("run_id")


@query("SELECT event_id, user_id FROM events")
def run_task_resharded_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another shard count in every run: each row arrives once."""
    return _two_runs(spark, sf_dir, F.col("event_id"))


@query("SELECT event_id * 2 AS event_id, user_id FROM events")
def run_task_resharded_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with even keys, which leave some shards empty."""
    return _two_runs(spark, sf_dir, F.col("event_id") * 2)


@query("SELECT CASE WHEN user_id % 5 <> 0 THEN event_id END AS event_id, user_id FROM events")
def run_task_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a key arrive once each, equal ones as often as they stand in the source, also those of the second drop."""
    return _two_runs(spark, sf_dir, F.when(F.col("user_id") % 5 != 0, F.col("event_id")))


@query(
    "SELECT 'COMPLETED' AS status, count(*) AS total, count(*) FILTER (WHERE second) AS processed, CAST(0 AS BIGINT) AS failed "
    "FROM (SELECT event_id > (SELECT max(event_id) // 2 FROM events) AS second FROM events)"
)
def run_task_null_keys_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second run counts: its drop, with and without keys."""
    root = new_folder(spark, "reruns")
    out = None
    for drop in _drops(spark, sf_dir, F.when(F.col("user_id") % 5 != 0, F.col("event_id")), root):
        drop.write.mode("append").parquet(f"{root}/source")
        out = run(spark, _task(root), f"{root}/state", guard=False)
    return out.select(
        "status",
        F.col("totalRecords").alias("total"),
        F.col("processedRecords").alias("processed"),
        F.size("failedBatches").cast("bigint").alias("failed"),
    )


class _Down:
    """A sink that is down for the given calls, counted from 0."""

    def __init__(self, calls: Sequence[int]) -> None:
        self.calls, self.seen = set(calls), 0

    def __call__(self, mapped: DataFrame, spec: SyncSpec, config) -> None:
        self.seen += 1
        if self.seen - 1 in self.calls:
            raise ConnectionError("target down")
        mapped.write.mode("append").parquet(config["path"])


@query(
    "SELECT target, event_id, user_id FROM (SELECT unnest(['first', 'second']) AS target), "
    "(SELECT event_id, user_id FROM events)"
)
def run_task_after_target_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second of two targets fails once; the repeated run serves that one alone. Both sinks only append."""
    root = new_folder(spark, "reruns")
    for drop in _drops(spark, sf_dir, F.col("event_id"), root):
        drop.write.mode("append").parquet(f"{root}/source")
    register_sink("trial-up", _Down(()))
    register_sink("trial-down-once", _Down((1,)))
    task = _task(
        root,
        destination_type="trial-up",
        destination_config={"path": f"{root}/first"},
        more_targets=(Target("trial-down-once", {"path": f"{root}/second"}),),
    )
    failures = 0
    for _ in range(2):
        try:
            run(spark, task, f"{root}/state", slices=3, guard=False)
        except SyncFailed:
            failures += 1
    if failures != 1:
        raise RuntimeError(f"{failures} failed runs")
    first = spark.read.parquet(f"{root}/first").withColumn("target", F.lit("first"))
    return first.unionByName(spark.read.parquet(f"{root}/second").withColumn("target", F.lit("second")))


@query("SELECT 'FAILED' AS status, count(*) AS scanned, true AS some, true AS counted, true AS distinct_rows FROM events")
def run_task_failed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sliced run that fails half-way counts the slices it delivered."""
    root = new_folder(spark, "reruns")
    for drop in _drops(spark, sf_dir, F.col("event_id"), root):
        drop.write.mode("append").parquet(f"{root}/source")
    register_sink("trial-down-third", _Down((2,)))
    try:
        run(spark, _task(root, destination_type="trial-down-third"), f"{root}/state", slices=4)
    except SyncFailed:
        pass
    stats = Ledger(spark, f"{root}/state/ledger").task_stats("events-again")
    held = spark.read.parquet(f"{root}/target").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids")
    )
    return stats.join(F.broadcast(held), F.col("processedRecords") <= F.col("n"), "left").select(
        "status",
        F.col("scannedRecords").alias("scanned"),
        (F.col("processedRecords") > 0).alias("some"),
        F.coalesce(F.col("processedRecords") == F.col("n"), F.lit(False)).alias("counted"),
        F.coalesce(F.col("n") == F.col("ids"), F.lit(False)).alias("distinct_rows"),
    )


@query(
    f"WITH m AS ({_MANIFEST}) SELECT 1 AS run, CAST(sum(n_rows) AS BIGINT) AS scanned, "
    "CAST(sum(n_rows) FILTER (WHERE first_key % 3 <> 0) AS BIGINT) AS sent, "
    "CAST(sum(n_rows) FILTER (WHERE first_key % 3 = 0) AS BIGINT) AS dead FROM m "
    "UNION ALL SELECT 2, 0, 0, CAST(sum(n_rows) FILTER (WHERE first_key % 3 = 0) AS BIGINT) FROM m"
)
def run_batches_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs into a faulty target: rows sent and dead letters together are the source, once."""
    root = new_folder(spark, "reruns")
    for drop in _drops(spark, sf_dir, F.col("event_id"), root):
        drop.write.mode("append").parquet(f"{root}/source")
    spec = SyncSpec(
        fields=_FIELDS,
        options=SyncOptions(batch_size=_RETRY.batch_size, max_retries=2, retry_initial_delay_ms=1, min_shards=4, max_shards=4),
    )
    out = None
    for number in (1, 2):
        try:
            run_batches(spark, _task(root, spec=spec), FaultySend(), f"{root}/state", guard=False)
        except SyncFailed:
            if number == 2:
                raise
        stats = Ledger(spark, f"{root}/state/ledger").task_stats("events-again").first()
        row = spark.read.parquet(f"{root}/state/dead_letters").agg(
            F.lit(number).alias("run"),
            F.lit(stats["scannedRecords"]).cast("bigint").alias("scanned"),
            F.lit(stats["processedRecords"]).cast("bigint").alias("sent"),
            F.count(F.lit(1)).alias("dead"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def _stream(spark: SparkSession, source: str, root: str, checkpoint: str) -> None:
    schema = spark.read.parquet(source).schema
    sync_new_files(spark, source, schema, lambda rows: rows, f"{root}/target", f"{root}/{checkpoint}")


@query("SELECT event_id, user_id FROM events")
def stream_lost_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's checkpoint is lost and the old files are gone: what was delivered stays."""
    root = new_folder(spark, "stream")
    for number, drop in enumerate(_drops(spark, sf_dir, F.col("event_id"), root)):
        drop.write.parquet(f"{root}/inbox-{number}")
        _stream(spark, f"{root}/inbox-{number}", root, f"checkpoint-{number}")
    return read_target(spark, f"{root}/target")


@query("SELECT event_id, user_id FROM events")
def stream_replayed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new checkpoint sees old files together with new ones: the old ones are passed over."""
    root = new_folder(spark, "stream")
    for number, drop in enumerate(_drops(spark, sf_dir, F.col("event_id"), root)):
        drop.write.mode("append").parquet(f"{root}/inbox")
        _stream(spark, f"{root}/inbox", root, f"checkpoint-{number}")
    return read_target(spark, f"{root}/target")


@query(
    "SELECT CAST(event_id AS VARCHAR) AS id, unnest(['event_id', 'user', 'kind', 'at']) AS field, "
    "unnest(['long', 'keyword', 'text', 'date']) AS type, unnest([NULL, NULL, 'ik_max_word', NULL]) AS analyzer, "
    "unnest([NULL, NULL, NULL, 'date_hour_minute_second||date_hour_minute_second_millis']) AS format FROM events"
)
def es_index_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of an index target with the field types its mapping file declares; an unknown type is left out."""
    root = new_folder(spark, "index")
    table(spark, sf_dir, "events").write.parquet(f"{root}/source")
    names = ("javaField", "sourceType", "sourceField", "targetType", "targetField")
    fields = [
        ("event_id", "Long", "event_id", "long", "event_id"),
        ("user", "Long", "user_id", "keyword", "user"),
        ("kind", "String", "event_type", "TEXT", "kind"),
        ("at", "LocalDateTime", "ts", "date", "at"),
        ("other", "String", "event_type", "geo_hash_of_mine", "other"),
    ]
    request = {
        "taskId": "events-index",
        "taskName": "events to an index",
        "sourceType": "parquet",
        "destinationType": "ElasticSearch",
        "sourceConfig": {"path": f"{root}/source"},
        "destinationConfig": {"path": f"{root}/bulk"},
        "targetFieldName": "events_index",
        "fields": [
            {**dict(zip(names, f, strict=True)), "checkpoint": f[0] == "event_id", "role": "id" if f[0] == "event_id" else ""}
            for f in fields
        ],
    }
    run(spark, SyncTask.from_request(request), f"{root}/state")
    declared = "struct<mappings:struct<properties:map<string,struct<type:string,analyzer:string,format:string>>>>"
    mapping = spark.read.text(f"{root}/bulk_mapping").select(
        F.lit("events_index").alias("_index"),
        F.explode(F.from_json("value", declared)["mappings"]["properties"]).alias("field", "how"),
    )
    action = F.from_json("value", "struct<index:struct<_index:string,_id:string>>")["index"]
    documents = spark.read.text(f"{root}/bulk").select(action.alias("a")).where("a._id IS NOT NULL").select("a.*")
    return documents.join(F.broadcast(mapping), "_index").select(
        F.col("_id").alias("id"), "field", "how.type", "how.analyzer", "how.format"
    )


class _GoneForGood:
    """A target that breaks down at batches whose first key is 0 modulo 3 and takes nothing after that."""

    def __call__(self, rows: pa.Table) -> None:
        if pc.min(rows["event_id"]).as_py() % 3 == 0:
            raise TargetGone("connection closed")


@query(
    "SELECT shard_id, batch_id, count(*) AS n_rows, min(event_id) AS first_key, max(event_id) AS last_key, CAST(1 AS BIGINT) AS times "
    f"FROM ({_BATCHED}) GROUP BY shard_id, batch_id"
)
def run_batches_killed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target breaks down for good in the middle of a run, twice; the third run sends what is left: each batch
    is sent once, and no slices are asked for."""
    root = new_folder(spark, "killed")
    spec = SyncSpec(fields=_FIELDS, options=replace(_RETRY, min_shards=4, max_shards=4))
    task = _task(root, spec=spec, source_config={"path": table_path(sf_dir, "events")})
    for send in (_GoneForGood(), _GoneForGood(), lambda rows: None):
        try:
            run_batches(spark, task, send, f"{root}/state", guard=False)
        except SyncFailed:
            continue
    sent = spark.read.schema(OUTCOME).parquet(f"{root}/state/progress/*/*").where("delivered")
    return sent.groupBy(SHARD, BATCH, "n_rows", "first_key", "last_key").agg(F.count(F.lit(1)).alias("times"))


@query("SELECT 'COMPLETED' AS status, count(*) AS total, count(*) AS processed FROM events")
def run_batches_killed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the runs around a break-down count: together each row once; the last one is complete."""
    root = new_folder(spark, "killed")
    spec = SyncSpec(fields=_FIELDS, options=replace(_RETRY, min_shards=4, max_shards=4))
    task = _task(root, spec=spec, source_config={"path": table_path(sf_dir, "events")})
    processed = 0
    for send in (_GoneForGood(), lambda rows: None):
        try:
            out = run_batches(spark, task, send, f"{root}/state", guard=False)
        except SyncFailed:
            out = Ledger(spark, f"{root}/state/ledger").task_stats(task.task_id)
            processed = out.first()["processedRecords"]
    return out.select("status", F.col("totalRecords").alias("total"), (F.col("processedRecords") + processed).alias("processed"))


class _Stubborn:
    """A target whose even batches (by first key) need ``tries`` more attempts."""

    def __init__(self, tries: int) -> None:
        self.tries, self.failed = tries, {}

    def __call__(self, rows: pa.Table) -> None:
        first = rows["event_id"][0].as_py()
        if first % 2 == 0 and self.failed.get(first, 0) < self.tries:
            self.failed[first] = self.failed.get(first, 0) + 1
            raise ConnectionError("try again")


def _sender_task(spark: SparkSession, sf_dir: str, root: str) -> SyncTask:
    """The events, in keys' order but with odd and even first keys of batches, to the sender ``trial-sender``."""
    table(spark, sf_dir, "events").where("event_id % 1000 <> 7").select("event_id", "user_id").write.parquet(f"{root}/source")
    spec = SyncSpec(fields=_FIELDS, options=replace(_RETRY, min_shards=4, max_shards=4))
    return _task(root, spec=spec, destination_type="trial-sender")


@query("SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS other_attempts, true AS retried FROM events WHERE event_id % 1000 <> 7")
def run_task_batch_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target of its own fails twice for chosen batches: each is retried by itself, where its rows lie."""
    root = new_folder(spark, "senders")
    register_sender("trial-sender", lambda config: _Stubborn(2))
    run(spark, _sender_task(spark, sf_dir, root), f"{root}/state", guard=False)
    sent = spark.read.schema(OUTCOME).parquet(f"{root}/state/progress/*/*/*")
    wanted = F.when(F.col("first_key") % 2 == 0, 3).otherwise(1)
    return sent.where("delivered").agg(
        F.sum("n_rows").alias("n_rows"),
        F.count_if(F.col("attempts") != wanted).alias("other_attempts"),
        F.bool_or(F.col("attempts") == 3).alias("retried"),
    )


@query("SELECT 'COMPLETED' AS status, count(*) AS n_rows, CAST(1 AS BIGINT) AS times FROM events WHERE event_id % 1000 <> 7")
def run_task_batches_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target refuses chosen batches beyond their retries; the next run sends those alone."""
    root = new_folder(spark, "senders")
    task, status = _sender_task(spark, sf_dir, root), None
    for tries in (9, 0):
        register_sender("trial-sender", lambda config, tries=tries: _Stubborn(tries))
        try:
            status = run(spark, task, f"{root}/state", guard=False).first()["status"]
        except SyncFailed:
            continue
    sent = spark.read.schema(OUTCOME).parquet(f"{root}/state/progress/*/*/*").where("delivered")
    each = sent.groupBy(SHARD, BATCH).agg(F.count(F.lit(1)).alias("times"), F.sum("n_rows").alias("n"))
    return each.groupBy("times").agg(F.sum("n").alias("n_rows")).select(F.lit(status).alias("status"), "n_rows", "times")


@query("SELECT unnest([1, 2, 3]) AS run, unnest([1, 1, 2]) AS config_lines, (SELECT count(*) FROM events) AS total")
def run_task_config_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Config lines after a run, after the same again, and after one with another batch size and a new password."""
    root, out = new_folder(spark, "configs"), None
    for number, size in enumerate((500, 500, 600), 1):
        spec = SyncSpec(fields=_FIELDS, options=SyncOptions(batch_size=size))
        config = {"path": table_path(sf_dir, "events"), "password": f"no. {number}"}
        task = _task(root, spec=spec, source_config=config)
        total = run(spark, task, f"{root}/state", guard=False).first()["totalRecords"]
        lines = Ledger(spark, f"{root}/state/ledger").read().where("kind = 'config'").count()
        row = control_rows(spark, [{"run": number, "config_lines": lines, "total": total}], "run int, config_lines int, total bigint")
        out = row if out is None else out.unionByName(row)
    return out
