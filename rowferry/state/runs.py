"""What a run set out to do, written before it writes anything.

An append-only table with one ``begin`` row per run (upper key, key slices, rows without a key)
and one ``target`` row per finished target of a slice. A slice is over once its checkpoints are
saved under ``<run id>-<slice>``. A run that died is finished later under its own id and bounds:
folders it owns replace themselves, finished slices and targets are left alone.

Rows without a key that come later have deliveries of their own: a ``late`` row once they are set
down in a table, ``target`` rows, and a ``late-done`` row after the last target.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from rowferry.storage import control_rows, no_rows

SCHEMA = "task_id string, run_id string, event string, detail string, ts timestamp_ntz"
BEGIN, TARGET = "begin", "target"
LATE, LATE_DONE = "late", "late-done"

# Lower (exclusive) and upper key of a slice; None is an open end.
Slice = tuple[int | None, int | None]


@dataclass(frozen=True)
class Intent:
    """Bounds and shard count of a run. ``nulls`` counts the rows without a key that are delivered once it is
    over; ``with_nulls`` says whether it is this run that delivers them."""

    run_id: str
    high: int | None
    slices: tuple[Slice, ...]
    shards: int
    nulls: int = 0
    with_nulls: bool = True
    done: frozenset[tuple[int, int]] = field(default_factory=frozenset)

    def slice_id(self, number: int) -> str:
        return f"{self.run_id}-{number}"

    def finished_slices(self, saved_ids: set[str]) -> int:
        """How many slices have their checkpoints, given the run ids of the newest checkpoints."""
        return max((n + 1 for n in range(len(self.slices)) if self.slice_id(n) in saved_ids), default=0)


class RunLog:
    """Intents under a path, one folder per task."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _append(self, task_id: str, run_id: str, event: str, detail: dict[str, Any]) -> None:
        row = {"run_id": run_id, "event": event, "detail": json.dumps(detail)}
        frame = control_rows(self.spark, [row], "run_id string, event string, detail string")
        frame.select(
            F.lit(task_id).alias("task_id"), "*", F.lit(datetime.now()).cast("timestamp_ntz").alias("ts")
        ).write.mode("append").partitionBy("task_id").parquet(self.path)

    def begin(self, task_id: str, intent: Intent) -> None:
        detail = {
            "high": intent.high,
            "slices": intent.slices,
            "shards": intent.shards,
            "nulls": intent.nulls,
            "with_nulls": intent.with_nulls,
        }
        self._append(task_id, intent.run_id, BEGIN, detail)

    def target_done(self, task_id: str, run_id: str, number: int, target: int) -> None:
        """Target number ``target`` has all rows of slice ``number``."""
        self._append(task_id, run_id, TARGET, {"slice": number, "target": target})

    def late_begin(self, task_id: str, run_id: str) -> None:
        """Later rows without a key are set down under ``run_id``."""
        self._append(task_id, run_id, LATE, {})

    def late_done(self, task_id: str, run_id: str) -> None:
        """All targets have the rows of a late delivery."""
        self._append(task_id, run_id, LATE_DONE, {})

    def late_open(self, task_id: str) -> dict[str, frozenset[int]]:
        """Late deliveries that are not over, with the targets that have their rows; at most one per run that died."""
        events = self.read().where(F.col("task_id") == task_id)
        late = events.where(F.col("event").isin(LATE, LATE_DONE)).groupBy("run_id").agg(F.count_if(F.col("event") == LATE_DONE).alias("over"))
        began = late.where("over = 0").select("run_id")
        found = events.join(F.broadcast(began), "run_id", "left_semi").select("run_id", "event", "detail").collect()
        out: dict[str, set[int]] = {r["run_id"]: set() for r in found}
        for r in found:
            if r["event"] == TARGET:
                out[r["run_id"]].add(json.loads(r["detail"])["target"])
        return {run_id: frozenset(done) for run_id, done in sorted(out.items())}

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return no_rows(self.spark, SCHEMA)

    def newest(self, task_id: str) -> Intent | None:
        """The task's last intent; one row per target and slice of it reaches the driver."""
        events = self.read().where(F.col("task_id") == task_id)
        last = events.where(F.col("event") == BEGIN).agg(F.max_by("run_id", "ts").alias("run_id"))
        rows = events.join(F.broadcast(last), "run_id", "left_semi").select("run_id", "event", "detail", "ts").collect()
        began = max((r for r in rows if r["event"] == BEGIN), key=lambda r: r["ts"], default=None)
        if began is None:
            return None
        plan = json.loads(began["detail"])
        done = [json.loads(r["detail"]) for r in rows if r["event"] == TARGET]
        return Intent(
            began["run_id"],
            plan["high"],
            tuple((a, b) for a, b in plan["slices"]),
            plan["shards"],
            plan["nulls"],
            plan["with_nulls"],
            frozenset((d["slice"], d["target"]) for d in done),
        )
