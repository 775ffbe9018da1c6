"""Handing batches to a Python target with retry, and what became of them.

For targets without a Spark writer (an HTTP endpoint, a vendor client). Spark
groups rows by (shard, batch), so a task sees one batch of bounded size at a time.
The outcome table is written once: reading it again does not deliver again.
Delivery is at least once; a lost executor re-sends the batches of its task.

With a ``progress`` folder, outcomes become visible as each task commits, whether the
job ends well or not. A later attempt leaves out the batches that any earlier one
delivered, so a job that dies costs the batches of the tasks that were under way.
"""

from __future__ import annotations

import bisect
import sys
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from rowferry.operators.batches import BATCH
from rowferry.operators.sharding import SHARD
from rowferry.spec import SyncOptions
from rowferry.storage import materialize, no_rows

# Delivery code travels with the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])

# Helper column that carries the source key next to mapped rows.
KEY = "_key"

OUTCOME = (
    "shard_id bigint, batch_id bigint, n_rows bigint, first_key bigint, last_key bigint, "
    "attempts int, retries int, waited_ms bigint, "
    "start_ms bigint, end_ms bigint, delivered boolean, error string, left_over boolean"
)

# Makes a task's files visible when the task commits, not when the job does.
_AT_TASK_COMMIT = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


class TargetGone(Exception):
    """For ``send`` to raise when the target takes nothing any more.

    The batch is not retried and the task sends no other; all of them wait for the next attempt.
    """


def backoff_schedule(options: SyncOptions) -> list[int]:
    """Milliseconds to wait before each retry."""
    return [
        int(options.retry_initial_delay_ms * options.retry_backoff_factor**i) for i in range(options.max_retries)
    ]


def call_with_retry(
    action: Callable[[], object], options: SyncOptions, *, sleep: Callable[[float], None] = time.sleep
) -> tuple[int, int, str | None]:
    """Run ``action`` up to ``1 + max_retries`` times: (attempts, waited ms, last error)."""
    waits, waited, error = backoff_schedule(options), 0, None
    for attempt in range(1, options.max_retries + 2):
        try:
            action()
            return attempt, waited, None
        except TargetGone:
            raise
        except Exception as e:  # a target may fail in any way
            error = f"{type(e).__name__}: {e}"
        if attempt <= options.max_retries:
            sleep(waits[attempt - 1] / 1000.0)
            waited += waits[attempt - 1]
    return options.max_retries + 1, waited, error


def _sender(send: Callable[[pa.Table], object], options: SyncOptions, key: str) -> Callable[[tuple, pa.Table], pa.Table]:
    """Sends one batch and says what became of it; each task has its own copy, which stops once the target is gone."""
    gone: list[str] = []  # each task has its own copy

    def one_batch(group: tuple, table: pa.Table) -> pa.Table:
        ends = pc.min_max(table[key])
        rows = table.drop_columns([c for c in (SHARD, BATCH, KEY) if c in table.column_names])
        start = int(time.time() * 1000)
        attempts, waited, error = 0, 0, gone[0] if gone else None
        if not gone:
            try:
                attempts, waited, error = call_with_retry(lambda: send(rows), options)
            except TargetGone as e:
                gone.append(f"TargetGone: {e}")
                attempts, error = 1, gone[0]
        return pa.table(
            {
                "shard_id": pa.array([group[0].as_py()], pa.int64()),
                "batch_id": pa.array([group[1].as_py()], pa.int64()),
                "n_rows": pa.array([table.num_rows], pa.int64()),
                "first_key": pa.array([ends["min"].as_py()], pa.int64()),
                "last_key": pa.array([ends["max"].as_py()], pa.int64()),
                "attempts": pa.array([attempts], pa.int32()),
                "retries": pa.array([max(attempts - 1, 0)], pa.int32()),
                "waited_ms": pa.array([waited], pa.int64()),
                "start_ms": pa.array([start], pa.int64()),
                "end_ms": pa.array([int(time.time() * 1000)], pa.int64()),
                "delivered": pa.array([error is None], pa.bool_()),
                "error": pa.array([error], pa.string()),
                "left_over": pa.array([bool(gone)], pa.bool_()),
            }
        )

    return one_batch


def delivered_before(spark: SparkSession, progress: str) -> DataFrame:
    """``(shard_id, batch_id)`` of the batches that some attempt under ``progress`` delivered."""
    try:
        seen = spark.read.schema(f"{OUTCOME}, attempt string").parquet(progress)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        seen = no_rows(spark, OUTCOME)
    return seen.where("delivered").select(SHARD, BATCH).distinct()


def deliver(
    df: DataFrame,
    send: Callable[[pa.Table], object],
    options: SyncOptions,
    *,
    key: str,
    progress: str | None = None,
) -> DataFrame:
    """Send every (shard, batch) of ``df`` and return one outcome row per batch.

    ``df`` carries ``shard_id`` and ``batch_id``; ``send`` gets the other columns as
    an Arrow table of at most ``batch_size`` rows and raises to signal failure. A key
    column named ``_key`` is a helper and is not sent. ``left_over`` marks the batches
    that were not sent, or not again, because the target is gone.

    ``progress`` is a folder that outlives the attempt. Batches it knows as delivered are
    neither sent nor returned; rows and numbering of ``df`` must be those of the first
    attempt. The join that leaves them out is on the keys the rows are grouped by, so the
    rows are shuffled once.
    """
    one_batch = _sender(send, options, key)
    if progress is None:
        return materialize(df.groupBy(SHARD, BATCH).applyInArrow(one_batch, OUTCOME), "delivery")
    spark = df.sparkSession
    still = df.join(delivered_before(spark, progress), [SHARD, BATCH], "left_anti").select(*df.columns)
    path = f"{progress.rstrip('/')}/attempt={uuid.uuid4().hex}"
    still.groupBy(SHARD, BATCH).applyInArrow(one_batch, OUTCOME).write.options(**_AT_TASK_COMMIT).parquet(path)
    return spark.read.schema(OUTCOME).parquet(path)


def deliver_in_place(
    df: DataFrame,
    send: Callable[[pa.Table], object],
    options: SyncOptions,
    *,
    key: str,
    progress: str,
) -> DataFrame:
    """``deliver`` for rows as they lie in their partitions: ``batch_size`` rows each, in scan order, without a shuffle.

    ``shard_id`` is then the number of the partition and ``batch_id`` that of the batch in it. A
    later attempt sends what no earlier one delivered; its rows must lie as in the first, as those of
    the same files read with the same settings do. Only then are rows shuffled, to leave batches out.
    """
    spark, place = df.sparkSession, F.monotonically_increasing_id()
    # Fixed value: the id has the row's number in its partition in the lower 33 bits.
    row = place.bitwiseAND(F.lit((1 << 33) - 1))
    numbered = df.withColumns(
        {SHARD: F.shiftright(place, 33), BATCH: F.call_function("div", row, F.lit(options.batch_size).cast("bigint"))}
    )
    if not delivered_before(spark, progress).isEmpty():
        return deliver(numbered, send, options, key=key, progress=progress)
    one_batch = _sender(send, options, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for rows in batches:
            numbers = rows.column(BATCH).to_pylist()
            first = 0
            while first < rows.num_rows:
                last = bisect.bisect_right(numbers, numbers[first])
                if held and held[0].column(BATCH)[0].as_py() != numbers[first]:
                    yield from outcome(held)
                    held = []
                held.append(rows.slice(first, last - first))
                first = last
        if held:
            yield from outcome(held)

    def outcome(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        return one_batch((table[SHARD][0], table[BATCH][0]), table).to_batches()

    path = f"{progress.rstrip('/')}/attempt={uuid.uuid4().hex}"
    numbered.mapInArrow(run, OUTCOME).write.options(**_AT_TASK_COMMIT).parquet(path)
    return spark.read.schema(OUTCOME).parquet(path)


def dead_letters(df: DataFrame, outcomes: DataFrame, task_id: str, run_id: str) -> DataFrame:
    """Rows of the batches that stayed undelivered, as JSON, all of them; left-over batches are not among them."""
    failed = outcomes.where(~F.col("delivered") & ~F.col("left_over")).select(SHARD, BATCH, F.col("error").alias("reason"))
    payload = [F.col(f"`{c}`") for c in df.columns if c not in (SHARD, BATCH, KEY)]
    return df.join(failed, [SHARD, BATCH]).select(
        F.lit(task_id).alias("task_id"),
        F.lit(run_id).alias("run_id"),
        SHARD,
        BATCH,
        "reason",
        F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}).alias("row_json"),
    )


def delivered_checkpoints(outcomes: DataFrame) -> DataFrame:
    """Checkpoint per shard: last key before its first undelivered batch.

    ``outcome`` is completed or failed. A shard whose first batch failed has a
    NULL checkpoint, so a later run starts it where this one did.
    """
    first_bad = outcomes.where(~F.col("delivered")).groupBy(SHARD).agg(F.min(BATCH).alias("_bad"))
    seen = outcomes.join(first_bad, SHARD, "left")
    done = F.col("_bad").isNull() | (F.col(BATCH) < F.col("_bad"))
    return seen.groupBy(SHARD).agg(
        F.max(F.when(done, F.col("last_key"))).alias("checkpoint"),
        F.when(F.max("_bad").isNull(), F.lit("completed")).otherwise(F.lit("failed")).alias("outcome"),
    )
