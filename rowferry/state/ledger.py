"""The run ledger: task configs and run statistics as JSON lines.

One folder per day and kind. Lines are only ever added; the current view is the
newest line per task. Secrets are masked before anything is written.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from rowferry.functions.encode import ledger_time, redact_map, redact_text
from rowferry.operators.records import first_failure, is_empty, is_empty_map, latest_per_key
from rowferry.storage import no_rows

# The envelope of a ledger line.
SYNC_CONFIG = (
    "struct<batchSize int, maxRetries int, retryInitialDelay bigint, retryBackoffFactor double, "
    "minShards int, maxShards int, recordsPerShard bigint, globalTimeout int>"
)
FIELDS = (
    "array<struct<javaField string, sourceType string, targetType string, sourceField string, "
    "checkpoint boolean, targetField string, role string>>"
)
STATS = (
    "struct<status string, startTime bigint, duration bigint, totalRecords bigint, shardCount int, "
    "maxFailedBatches int, scannedRecords bigint, filteredRecords bigint, processedRecords bigint, "
    "completedShards bigint, failedShards bigint, skippedShards bigint, retryCount bigint, "
    "shardDurations map<string,bigint>, batchTimes map<string,bigint>, failedBatches array<string>, "
    "taskId string, persisted boolean, lastPersistTime string, version int>"
)
LINE = (
    "taskId string, taskName string, sourceType string, destinationType string, "
    "sourceConfig map<string,string>, desConfig map<string,string>, "
    f"syncConfig {SYNC_CONFIG}, sourceFieldName string, targetFieldName string, "
    f"fields {FIELDS}, syncStats {STATS}, recordedAt string"
)
RECORDED, RECORDED_PY = "yyyy-MM-dd HH:mm:ss.SSSSSS", "%Y-%m-%d %H:%M:%S.%f"
CONFIG, STATISTICS, REJECTED = "config", "stats", "rejected"

# How long a finished task stays known and a silent run counts as
# alive, and the messages of line checks.
COMPLETED_DAYS = 3
RUN_TIMEOUT_S = 86_400
NO_TASK, NO_SOURCE, NO_TARGET, NO_TYPE = (
    "taskId is empty",
    "sourceConfig is empty",
    "desConfig is empty",
    "sourceType is empty",
)

# About 100 MB of lines.
LINES_PER_FILE = 50_000


def as_lines(df: DataFrame, values: Mapping[str, Column], stats: Mapping[str, Column] | None = None) -> DataFrame:
    """Ledger lines from the columns of ``df``; entries not given are NULL."""
    envelope = T.StructType.fromDDL(LINE)

    def filled(schema: T.StructType, given: Mapping[str, Column]) -> list[Column]:
        unknown = set(given) - set(schema.names)
        if unknown:
            raise ValueError(f"not part of a ledger line: {sorted(unknown)}")
        return [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]

    columns = dict(values)
    if stats is not None:
        columns["syncStats"] = F.struct(*filled(envelope["syncStats"].dataType, stats))
    return df.select(*filled(envelope, columns))


def redacted(lines: DataFrame) -> DataFrame:
    """Lines with the secrets of both connection configs and of error texts masked."""
    stats = F.col("syncStats")
    failures = F.transform(stats["failedBatches"], redact_text)
    return lines.withColumns(
        {
            "sourceConfig": redact_map(F.col("sourceConfig")),
            "desConfig": redact_map(F.col("desConfig")),
            "syncStats": F.when(stats.isNotNull(), stats.withField("failedBatches", failures)),
        }
    )


def line_error() -> Column:
    """Why a line may not be stored: stats need a task id, configs four entries."""
    config = F.col("syncStats").isNull()
    return first_failure(
        [
            (is_empty(F.col("taskId")), NO_TASK),
            (config & is_empty_map(F.col("sourceConfig")), NO_SOURCE),
            (config & is_empty_map(F.col("desConfig")), NO_TARGET),
            (config & is_empty(F.col("sourceType")), NO_TYPE),
        ]
    )


def checked(lines: DataFrame) -> DataFrame:
    """Add ``error``; a stats line without its own task id gets that of the line."""
    own = F.coalesce(F.nullif(F.col("syncStats.taskId"), F.lit("")), F.col("taskId"))
    stats = F.when(F.col("syncStats").isNotNull(), F.col("syncStats").withField("taskId", own))
    return lines.withColumns({"error": line_error(), "syncStats": stats})


def unpersisted(records: DataFrame, flag: str = "persisted") -> DataFrame:
    """Records not stored yet; an unset flag counts as not stored."""
    return records.where(~F.coalesce(F.col(flag), F.lit(False)))


def with_task_name(stats: DataFrame, configs: DataFrame) -> DataFrame:
    """Name every stats record after its task config, else after its task id."""
    names = configs.select("task_id", F.col("task_name").alias("_name"))
    joined = stats.join(names, "task_id", "left")
    return joined.withColumn("task_name", F.coalesce("_name", F.col("task_id").cast("string"))).drop("_name")


def mark_persisted(stats: DataFrame, at: datetime | Column) -> DataFrame:
    """Next version of stats lines: flag set, time noted, version raised."""
    when = at if isinstance(at, Column) else F.lit(at).cast("timestamp_ntz")
    s = F.col("syncStats")
    return stats.withColumn(
        "syncStats",
        s.withField("persisted", F.lit(True))
        .withField("lastPersistTime", ledger_time(when))
        .withField("version", (F.coalesce(s["version"], F.lit(0)) + 1).cast("int")),
    )


def blocked_tasks(
    stats: DataFrame, now: Column, days: int = COMPLETED_DAYS, timeout_s: int = RUN_TIMEOUT_S
) -> DataFrame:
    """Tasks that may not start: running, or completed within the last ``days``.

    ``stats``: one row per task with task_id, status and ts. A run that has not
    reported for ``timeout_s`` counts as dead, not as running.
    """
    recent = F.col("ts") >= now - F.make_dt_interval(F.lit(days))
    alive = F.col("ts") >= now - F.make_dt_interval(secs=F.lit(timeout_s))
    reason = F.when((F.col("status") == "RUNNING") & alive, F.lit("already running")).when(
        (F.col("status") == "COMPLETED") & recent, F.lit("already completed")
    )
    return stats.select("task_id", reason.alias("reason")).where(F.col("reason").isNotNull())


def start_guard(requests: DataFrame, blocked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests that may start, rejected requests with their reason)."""
    return requests.join(blocked, "task_id", "left_anti"), requests.join(blocked, "task_id")


class Ledger:
    """Ledger lines under a path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def append(
        self, lines: DataFrame, at: datetime | None = None, *, many: bool = False, changed_only: bool = False
    ) -> None:
        """Add lines, masked, recorded ``at`` a time or at their own ``recordedAt``. Lines that may
        not be stored go to a kind of their own, with the reason.

        ``many`` rebalances them first, so that a day is a few files and a long day
        more than one task. ``changed_only`` leaves out config lines that say, once masked,
        what the newest one of their task says.
        """
        if at is not None:
            lines = lines.withColumn("recordedAt", F.lit(at.strftime(RECORDED_PY)))
        masked = redacted(checked(lines))
        if changed_only:
            said = [F.col(c) for c in T.StructType.fromDDL(LINE).names if c != "recordedAt"]
            body = F.to_json(F.struct(*said))
            known = self.tasks().select("taskId", body.alias("_body"))
            masked = masked.withColumn("_body", body).join(known, ["taskId", "_body"], "left_anti").drop("_body")
        when = F.to_timestamp_ntz("recordedAt", F.lit(RECORDED))
        placed = masked.select(
            *T.StructType.fromDDL(LINE).names,
            F.date_format(when, "yyyyMMdd").alias("dt"),
            "error",
            F.when(F.col("error").isNotNull(), F.lit(REJECTED))
            .when(F.col("syncStats").isNotNull(), F.lit(STATISTICS))
            .otherwise(F.lit(CONFIG))
            .alias("kind"),
        )
        if many:
            placed = placed.hint("rebalance", "dt", "kind")
        placed.write.mode("append").partitionBy("dt", "kind").option("maxRecordsPerFile", LINES_PER_FILE).json(
            self.path
        )

    def read(self) -> DataFrame:
        """All lines with their day and kind."""
        schema = f"{LINE}, dt string, kind string"
        try:
            return self.spark.read.schema(schema).json(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return no_rows(self.spark, schema)

    def rejected(self) -> DataFrame:
        """Lines that could not be stored, and why."""
        try:
            lines = self.spark.read.schema(f"{LINE}, error string, dt string, kind string").json(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return no_rows(self.spark, f"{LINE}, error string, dt string, kind string")
        return lines.where(F.col("kind") == REJECTED)

    def _latest(self, kind: str, since: datetime | None) -> DataFrame:
        lines = self.read().where(F.col("kind") == kind)
        if since is not None:
            lines = lines.where(F.col("dt") >= since.strftime("%Y%m%d"))
        version = F.coalesce(F.col("syncStats.version"), F.lit(0))
        ranked = lines.withColumn("_version", version)
        return latest_per_key(ranked, ["taskId"], ["recordedAt", "_version"]).drop("_version")

    def tasks(self) -> DataFrame:
        """Newest config line of every task."""
        return self._latest(CONFIG, None)

    def stats(self, since: datetime | None = None) -> DataFrame:
        """Newest stats line of every task, from the days since ``since``."""
        return self._latest(STATISTICS, since)

    def task_stats(self, task_id: str) -> DataFrame:
        """Statistics of one task; an unknown task is an error."""
        found = self.stats().where(F.col("taskId") == task_id).select("taskId", "taskName", "syncStats.*")
        if found.isEmpty():
            raise LookupError(f"no such task: {task_id}")
        return found

    def blocked(self, now: datetime, timeout_s: int = RUN_TIMEOUT_S) -> DataFrame:
        """Tasks that may not start at ``now``; older days cannot block any more."""
        since = now - timedelta(days=COMPLETED_DAYS, seconds=timeout_s)
        recent = self.stats(since).select(
            F.col("taskId").alias("task_id"),
            F.col("syncStats.status").alias("status"),
            F.to_timestamp_ntz("recordedAt", F.lit(RECORDED)).alias("ts"),
        )
        return blocked_tasks(recent, F.lit(now).cast("timestamp_ntz"), timeout_s=timeout_s)

