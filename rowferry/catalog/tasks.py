"""Task runs, validation, start guard and the ledger."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.catalog.registry import EVENTS, query, table, table_path
from rowferry.operators.records import latest_per_key, page, validate_required
from rowferry.plans.run import SyncTask, run
from rowferry.spec import FieldSpec, SyncOptions, SyncSpec
from rowferry.state import ledger
from rowferry.state.checkpoints import CheckpointLog
from rowferry.storage import new_folder


@query(
    "SELECT user_id, event_id, ts, event_type FROM ("
    "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"
)
def latest_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of every user."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return latest_per_key(events, ["user_id"], ["ts", "event_id"])


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 20")
def page_offset_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of a list in a defined order."""
    return page(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), 20, 50, order=["c_custkey"])


@query(
    "SELECT event_id, CASE WHEN user_id % 11 = 0 THEN 'task id must not be blank' "
    "WHEN value < 3 THEN 'task name must not be blank' END AS error FROM events"
)
def validate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required texts checked in order; the first missing one is reported."""
    requests = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("user_id") % 11 == 0, F.lit("  ")).otherwise(F.col("user_id").cast("string")).alias("task_id"),
        F.when(F.col("value") >= 3, F.col("event_type")).alias("task_name"),
    )
    rules = {"task_id": "task id must not be blank", "task_name": "task name must not be blank"}
    return validate_required(requests, rules).select("event_id", "error")


def _status():
    kind = F.col("event_type")
    return (
        F.when(kind == "view", F.lit("RUNNING")).when(kind == "click", F.lit("COMPLETED")).otherwise(F.lit("STOPPED"))
    )


_STATUS = "CASE event_type WHEN 'view' THEN 'RUNNING' WHEN 'click' THEN 'COMPLETED' ELSE 'STOPPED' END"


@query(
    "SELECT c.c_custkey AS task_id, CASE WHEN s.status = 'RUNNING' "
    "AND s.ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY THEN 'already running' "
    "WHEN s.status = 'COMPLETED' AND s.ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY THEN 'already completed' "
    f"END AS reason FROM customer c LEFT JOIN (SELECT user_id, {_STATUS} AS status, ts FROM ("
    "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"
    ") s ON c.c_custkey = s.user_id"
)
def start_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that may start, and rejected ones with the reason."""
    events = table(spark, sf_dir, "events")
    stats = latest_per_key(
        events.select(F.col("user_id").alias("task_id"), _status().alias("status"), "ts", "event_id"),
        ["task_id"],
        ["ts", "event_id"],
    )
    now = events.agg(F.max("ts")).first()[0]
    blocked = ledger.blocked_tasks(stats, F.lit(now).cast("timestamp_ntz"))
    requests = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id"))
    accepted, rejected = ledger.start_guard(requests, blocked)
    return accepted.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected)


@query(
    "SELECT d.doc_id AS task_id, coalesce('quality ' || l.quality, CAST(d.doc_id AS VARCHAR)) AS task_name "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
)
def task_name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stats named after their config, or after the task when there is none."""
    stats = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("task_id"))
    configs = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("task_id"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("task_name")
    )
    return ledger.with_task_name(stats, configs)


@query("SELECT event_id, user_id FROM events WHERE NOT coalesce(CASE user_id % 3 WHEN 0 THEN true WHEN 1 THEN false END, false)")
def unpersisted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records not stored yet; an unset flag counts as not stored."""
    flag = F.when(F.col("user_id") % 3 == 0, F.lit(True)).when(F.col("user_id") % 3 == 1, F.lit(False))
    records = table(spark, sf_dir, "events").select("event_id", "user_id", flag.alias("persisted"))
    return ledger.unpersisted(records).drop("persisted")


def _text(column: str):
    return F.col(column).cast("string")


def _recorded():
    return F.date_format("ts", ledger.RECORDED)


@query(
    "SELECT event_id, CASE WHEN user_id % 13 = 0 THEN 'taskId is empty' WHEN event_type = 'view' THEN NULL "
    "WHEN value < 2 THEN 'sourceConfig is empty' WHEN value < 4 THEN 'desConfig is empty' "
    "WHEN value < 6 THEN 'sourceType is empty' END AS error FROM events"
)
def ledger_line_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a line may not be stored; statistics need a task id only."""
    empty = F.create_map().cast("map<string,string>")
    filled = F.create_map(F.lit("k"), F.lit("v"))
    events = table(spark, sf_dir, "events")
    lines = ledger.as_lines(
        events,
        {
            "taskId": F.when(F.col("user_id") % 13 != 0, _text("user_id")).otherwise(F.lit("")),
            "taskName": _text("event_id"),
            "sourceConfig": F.when(F.col("value") >= 2, filled),
            "desConfig": F.when(F.col("value") < 4, empty).otherwise(filled),
            "sourceType": F.when(F.col("value") < 6, F.lit("")).otherwise(F.lit("mysql")),
            "syncStats": F.when(
                F.col("event_type") == "view", F.from_json(F.lit("{}"), ledger.STATS)
            ),
        },
    )
    checked = ledger.checked(lines)
    return checked.select(F.col("taskName").cast("bigint").alias("event_id"), "error")


def _stats_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a statistics line of its user's task."""
    return ledger.as_lines(
        table(spark, sf_dir, "events"),
        {"taskId": _text("user_id"), "taskName": F.col("event_type"), "recordedAt": _recorded()},
        {"status": _status(), "processedRecords": F.col("event_id"), "version": F.lit(1)},
    )


@query(
    f"SELECT CAST(user_id AS VARCHAR) AS task_id, {_STATUS} AS status, event_id AS processed, "
    "CAST(user_id AS VARCHAR) AS own_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn "
    "FROM events) WHERE rn = 1"
)
def ledger_task_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics lines written, read back, newest per task; the task id is filled in."""
    book = ledger.Ledger(spark, new_folder(spark, "ledger"))
    book.append(_stats_lines(spark, sf_dir), many=True)
    return book.stats().select(
        F.col("taskId").alias("task_id"),
        F.col("syncStats.status").alias("status"),
        F.col("syncStats.processedRecords").alias("processed"),
        F.col("syncStats.taskId").alias("own_id"),
    )


@query(
    "SELECT event_id AS processed, 2 AS version, true AS persisted, "
    "strftime(ts, '%Y-%m-%d %H:%M:%S') AS stored_at FROM events"
)
def ledger_mark_persisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next version of every line, marked as stored."""
    when = F.to_timestamp_ntz("recordedAt", F.lit(ledger.RECORDED))
    marked = ledger.mark_persisted(_stats_lines(spark, sf_dir), when)
    return marked.select(
        F.col("syncStats.processedRecords").alias("processed"),
        F.col("syncStats.version").alias("version"),
        F.col("syncStats.persisted").alias("persisted"),
        F.col("syncStats.lastPersistTime").alias("stored_at"),
    )


@query(
    "SELECT CAST(page_id AS VARCHAR) AS task_id, regexp_replace(regexp_replace(replace(url, '://', '://bob:pw@'), "
    "'//[^/\\s?#]*@', '//***@', 'g'), '([?&;][^=&;?#]+)=[^&;#]*', '\\1=***', 'g') AS url, "
    "'***' AS password, 'orders' AS table_name FROM pages"
)
def ledger_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Config lines stored with passwords and URL credentials masked; listed per task."""
    secret = F.regexp_replace("url", "://", "://bob:pw@")
    config = F.create_map(F.lit("url"), secret, F.lit("dbPassword"), F.col("url"), F.lit("table"), F.lit("orders"))
    lines = ledger.as_lines(
        table(spark, sf_dir, "pages"),
        {
            "taskId": _text("page_id"),
            "sourceType": F.lit("mysql"),
            "sourceConfig": config,
            "desConfig": config,
        },
    )
    book = ledger.Ledger(spark, new_folder(spark, "ledger"))
    book.append(lines, datetime(2024, 1, 2, 3, 4, 5), many=True)
    return book.tasks().select(
        F.col("taskId").alias("task_id"),
        F.col("sourceConfig")["url"].alias("url"),
        F.col("desConfig")["dbPassword"].alias("password"),
        F.col("sourceConfig")["table"].alias("table_name"),
    )


def _task(sf_dir: str, root: str, spec: SyncSpec = EVENTS, **changes) -> SyncTask:
    settings = {
        "task_id": "events-copy",
        "task_name": "copy of events",
        "source_type": "parquet",
        "destination_type": "parquet",
        "source_config": {"path": table_path(sf_dir, "events")},
        "destination_config": {"path": f"{root}/target"},
        "spec": spec,
    }
    return SyncTask(**{**settings, **changes})


_MAPPED = "SELECT event_id, ts AS event_time, user_id, event_type AS type, value AS amount FROM events"


@query(_MAPPED)
def run_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run: what the target holds afterwards."""
    root = new_folder(spark, "run-task")
    run(spark, _task(sf_dir, root), f"{root}/state")
    return spark.read.parquet(f"{root}/target").drop("run_id")


@query(_MAPPED)
def run_task_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in four key slices, each with its checkpoint."""
    root = new_folder(spark, "run-task")
    run(spark, _task(sf_dir, root), f"{root}/state", slices=4)
    return spark.read.parquet(f"{root}/target").drop("run_id")


@query(
    "SELECT * FROM (SELECT 1 AS run, 'COMPLETED' AS status, count(*) AS total, count(*) AS scanned, "
    "count(*) FILTER (WHERE event_type = 'error') AS filtered, count(*) FILTER (WHERE event_type <> 'error') AS processed "
    "FROM events UNION ALL SELECT 2, 'COMPLETED', count(*), 0, 0, 0 FROM events)"
)
def run_task_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a run with a record filter, and of a second run that finds nothing new."""
    root = new_folder(spark, "run-task")
    skip = F.when(F.col("event_type") == "error", F.lit("error")).otherwise(F.lit(""))
    out = None
    for number in (1, 2):
        stats = run(spark, _task(sf_dir, root), f"{root}/state", filter_key=skip, guard=False)
        row = stats.select(
            F.lit(number).alias("run"),
            "status",
            F.col("totalRecords").alias("total"),
            F.col("scannedRecords").alias("scanned"),
            F.col("filteredRecords").alias("filtered"),
            F.col("processedRecords").alias("processed"),
        )
        out = row if out is None else out.unionByName(row)
    return out


@query(f"SELECT * FROM ({_MAPPED}) WHERE event_id > (SELECT max(event_id) // 3 FROM events)")
def run_task_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that starts behind a saved checkpoint of another shard count."""
    root = new_folder(spark, "run-task")
    reached = table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] // 3
    log = CheckpointLog(spark, f"{root}/state/checkpoints")
    log.save("events-copy", 1, {0: reached}, "earlier", datetime(2024, 1, 1))
    run(spark, _task(sf_dir, root), f"{root}/state")
    return spark.read.parquet(f"{root}/target").drop("run_id")


@query(
    "SELECT event_id, props_number IS NULL AS dead, props_number FROM ("
    "SELECT event_id, CASE WHEN event_type = 'click' THEN NULL ELSE user_id END AS props_number FROM events)"
)
def run_task_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that sets rows aside: target and dead letters together are the source."""
    root = new_folder(spark, "run-task")
    word = F.when(F.col("event_type") == "click", F.lit("n/a")).otherwise(F.col("user_id").cast("string"))
    table(spark, sf_dir, "events").select("event_id", word.alias("word")).write.parquet(f"{root}/source")
    spec = SyncSpec(
        fields=(FieldSpec("event_id", "Long", checkpoint=True), FieldSpec("props_number", "Long", source="word")),
        options=SyncOptions(records_per_shard=1_000),
    )
    task = _task(sf_dir, root, spec, source_config={"path": f"{root}/source"})
    run(spark, task, f"{root}/state", mode="lenient")
    good = spark.read.parquet(f"{root}/target").select("event_id", F.lit(False).alias("dead"), "props_number")
    dead = spark.read.parquet(f"{root}/state/dead_letters").select(
        F.col("record_id").cast("bigint").alias("event_id"),
        F.lit(True).alias("dead"),
        F.lit(None).cast("bigint").alias("props_number"),
    )
    return good.unionByName(dead)
