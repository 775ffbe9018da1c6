"""Checkpoints as an append-only table: the newest row per shard is the truth.

Data is written first and its checkpoint rows last, so a run that died leaves no
checkpoint and its rows are delivered again (at least once) or, for run-owned
folders, replaced.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from rowferry.operators.records import latest_per_key
from rowferry.operators.sharding import SHARD
from rowferry.storage import control_rows, no_rows

SCHEMA = (
    "task_id string, shard_id bigint, shard_count bigint, checkpoint string, run_id string, ts timestamp_ntz"
)


def latest(log: DataFrame) -> DataFrame:
    """Newest checkpoint per task and shard. A NULL checkpoint is a deletion."""
    return latest_per_key(log, ["task_id", SHARD], ["ts", "run_id"])


def current(log: DataFrame) -> DataFrame:
    """Newest checkpoints of the shard count each task used last."""
    newest = latest(log)
    count = newest.groupBy("task_id").agg(
        F.max_by("shard_count", F.struct("ts", "run_id", "shard_count")).alias("shard_count")
    )
    return newest.join(count, ["task_id", "shard_count"]).select(*log.columns)


def as_rows(per_shard: DataFrame, task_id: str, shards: int, run_id: str, ts: datetime) -> DataFrame:
    """Checkpoint rows from ``shard_id`` and ``checkpoint`` columns."""
    return per_shard.select(
        F.lit(task_id).alias("task_id"),
        F.col(SHARD).cast("bigint").alias(SHARD),
        F.lit(shards).cast("bigint").alias("shard_count"),
        F.col("checkpoint").cast("string").alias("checkpoint"),
        F.lit(run_id).alias("run_id"),
        F.lit(ts).cast("timestamp_ntz").alias("ts"),
    )


class CheckpointLog:
    """The checkpoint table under a path, one folder per task."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def append(self, rows: DataFrame) -> None:
        """Add checkpoint rows."""
        rows.write.mode("append").partitionBy("task_id").parquet(self.path)

    def save(
        self, task_id: str, shards: int, checkpoints: Mapping[int, int | str | None], run_id: str, ts: datetime
    ) -> None:
        """Append the given shard -> checkpoint entries, one file."""
        rows = [{SHARD: s, "checkpoint": None if c is None else str(c)} for s, c in sorted(checkpoints.items())]
        frame = control_rows(self.spark, rows, f"{SHARD} bigint, checkpoint string")
        self.append(as_rows(frame, task_id, shards, run_id, ts))

    def delete(self, task_id: str, shard_id: int, shards: int, run_id: str, ts: datetime) -> None:
        """Forget a shard: a row without a checkpoint."""
        self.save(task_id, shards, {shard_id: None}, run_id, ts)

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return no_rows(self.spark, SCHEMA)

    def load(self, task_id: str) -> DataFrame:
        """Current checkpoints of one task; reads that task's folder only."""
        return current(self.read().where(F.col("task_id") == task_id))
