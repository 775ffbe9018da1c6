"""Incremental file sync."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.catalog.registry import EVENTS, query, table, table_path
from rowferry.operators.mapping import map_columns
from rowferry.storage import materialize, new_folder
from rowferry.streaming.incremental import read_target, sync_new_files

_MAPPED = "SELECT event_id, ts AS event_time, user_id, event_type AS type, value AS amount FROM events"


def _sync(spark: SparkSession, sf_dir: str, target: str, checkpoint: str) -> None:
    schema = table(spark, sf_dir, "events").schema
    sync_new_files(
        spark, table_path(sf_dir, "events"), schema, lambda rows: map_columns(rows, EVENTS), target, checkpoint
    )


@query(_MAPPED)
def stream_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the same folder: the second finds no new file and adds nothing."""
    root = new_folder(spark, "stream")
    for _ in range(2):
        _sync(spark, sf_dir, f"{root}/target", f"{root}/checkpoint")
    return read_target(spark, f"{root}/target")


@query(_MAPPED)
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that lost its checkpoint delivers again and replaces what it wrote."""
    root = new_folder(spark, "stream")
    _sync(spark, sf_dir, f"{root}/target", f"{root}/checkpoint-1")
    _sync(spark, sf_dir, f"{root}/target", f"{root}/checkpoint-2")
    return read_target(spark, f"{root}/target")


class _Died(RuntimeError):
    """What ends a stream between rows and commit."""


def _die(batch_id: int) -> None:
    raise _Died(f"batch {batch_id}")


@query(
    "SELECT step, event_id, user_id FROM (VALUES ('after the break', 0), ('after the restart', 1)) s(step, kept), "
    "(SELECT event_id, user_id FROM events) WHERE kept = 1"
)
def stream_dies_before_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream writes its rows, dies before it commits them, and loses its checkpoint: nothing is visible. The next
    one delivers every row once."""
    root, out = new_folder(spark, "stream"), None
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    events.write.parquet(f"{root}/inbox")
    for step, hook in (("after the break", _die), ("after the restart", lambda batch_id: None)):
        checkpoint = f"{root}/{step.replace(' ', '-')}"
        try:
            sync_new_files(spark, f"{root}/inbox", events.schema, lambda rows: rows, f"{root}/target", checkpoint, before_commit=hook)
        except StreamingQueryException:
            pass
        seen = materialize(read_target(spark, f"{root}/target").select(F.lit(step).alias("step"), "event_id", "user_id"), "stream")
        out = seen if out is None else out.unionByName(seen)
    return out
