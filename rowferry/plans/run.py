"""One sync run: check, guard, read, map, deliver, checkpoint, record."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Collection, Iterator, Mapping, Sequence
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta
from functools import partial
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from rowferry.functions import sizing
from rowferry.functions.convert import DEFAULT_RULES, Rules
from rowferry.operators import delivery
from rowferry.operators.batches import BATCH, assign_batches
from rowferry.operators.counters import keep_rows, shard_counters, shard_times
from rowferry.operators.delivery import KEY
from rowferry.operators.mapping import map_columns, split_bad_rows
from rowferry.operators.records import capped
from rowferry.operators.resume import ResumePoint, resume_filter, resume_point, uneven_shards
from rowferry.operators.sharding import SHARD, with_shards
from rowferry.operators.surplus import COUNTS, row_counts, surplus
from rowferry.sinks.registry import Target, fan_out, find_sink
from rowferry.sources.registry import DATABASES, known_counts, open_source
from rowferry.spec import OPTION_NAMES, SpecError, SyncOptions, SyncSpec, is_index_type
from rowferry.state.checkpoints import CheckpointLog
from rowferry.state.ledger import LINE, Ledger
from rowferry.state.runs import Intent, RunLog, Slice
from rowferry.storage import control_rows, no_rows, staged

# What a task request must bring, and what is said when it does not.
REQUIRED = (
    ("task_id", "task id must not be blank"),
    ("task_name", "task name must not be blank"),
    ("source_type", "source type must not be blank"),
    ("destination_type", "target type must not be blank"),
    ("source_config", "source config must not be empty"),
    ("destination_config", "target config must not be empty"),
)


INDEX = "ELASTICSEARCH"


class TaskRejected(ValueError):
    """The task may not start."""


class SyncFailed(RuntimeError):
    """A target kept failing; rows up to the saved checkpoints are delivered."""


@dataclass(frozen=True)
class SyncTask:
    """What to sync, from where, to where."""

    task_id: str
    task_name: str
    source_type: str
    destination_type: str
    source_config: Mapping[str, Any]
    destination_config: Mapping[str, Any]
    spec: SyncSpec
    more_targets: Sequence[Target] = field(default_factory=tuple)

    @classmethod
    def from_request(cls, request: Mapping[str, Any]) -> SyncTask:
        """From the body of a task request (``taskId``, ``sourceConfig``, ``fields``, ...)."""
        spec = SyncSpec.from_fields(
            request.get("fields") or (),
            any_target_type=(request.get("destinationType") or "").strip().upper() == INDEX,
            source_table=request.get("sourceFieldName") or "",
            target_table=request.get("targetFieldName") or "",
            options=SyncOptions.from_config(request.get("syncConfig")),
        )
        return cls(
            task_id=request.get("taskId"),
            task_name=request.get("taskName"),
            source_type=request.get("sourceType"),
            destination_type=request.get("destinationType"),
            source_config=request.get("sourceConfig"),
            destination_config=request.get("destinationConfig"),
            spec=spec,
        )

    def error(self) -> str | None:
        """First missing entry, in the order of ``REQUIRED``."""
        for name, message in REQUIRED:
            value = getattr(self, name)
            if value is None or (isinstance(value, str) and not value.strip()) or len(value) == 0:
                return message
        return None

    def targets(self) -> list[Target]:
        return [Target(self.destination_type, self.destination_config), *self.more_targets]


@dataclass(frozen=True)
class Counts:
    """Rows of the source as seen before the run: the run reads up to ``high``."""

    total: int
    high: int | None
    nulls: int = 0


def source_counts(df: DataFrame, key: str) -> Counts:
    """Row count, largest key and rows without a key, from the key column only."""
    k = F.col(f"`{key}`").cast("bigint")
    row = df.agg(F.count(F.lit(1)).alias("n"), F.max(k).alias("high"), F.count_if(k.isNull()).alias("nulls")).first()
    return Counts(row["n"], row["high"], row["nulls"])


def machine(spark: SparkSession) -> tuple[int, int]:
    """(parallel tasks, executor heap bytes) for shard sizing."""
    heap = spark.conf.get("spark.executor.memory", None) or spark.conf.get("spark.driver.memory", None) or "1g"
    units = {"k": 2**10, "m": 2**20, "g": 2**30, "t": 2**40}
    text = heap.strip().lower().rstrip("b")
    size = int(text[:-1]) * units[text[-1]] if text[-1] in units else int(text)
    return spark.sparkContext.defaultParallelism, size


def planned_shards(spark: SparkSession, total: int, spec: SyncSpec) -> int:
    """Adaptive shard count for a source of ``total`` rows."""
    cores, heap = machine(spark)
    return sizing.shard_count_of(total, spec.options, cores, heap)


def _slices(rows: DataFrame, key: str, high: int | None, parts: int) -> tuple[Slice, ...]:
    """Key ranges ``low < k <= high`` of about equal row counts, delivered and checkpointed
    one after the other. Rows without a key are in the first."""
    if parts <= 1 or high is None:
        return ((None, high),)
    at = [i / parts for i in range(1, parts)]
    k = F.col(f"`{key}`").cast("bigint")
    cuts = rows.agg(F.percentile_approx(k, at, max(10_000, 10 * parts))).first()[0] or []
    upper = sorted({c for c in cuts if c < high}) + [high]
    return tuple(zip([None, *upper[:-1]], upper, strict=True))


def _new_stats(spec: SyncSpec, started: float) -> dict[str, Any]:
    """Statistics of a run that has just begun."""
    counters = (
        "totalRecords shardCount scannedRecords filteredRecords processedRecords "
        "completedShards failedShards skippedShards retryCount version"
    ).split()
    return {
        "status": "RUNNING",
        "startTime": int(started * 1000),
        "maxFailedBatches": spec.options.max_failed_batches,
        "failedBatches": [],
        **dict.fromkeys(counters, 0),
    }


def _stats_line(task: SyncTask, stats: Mapping[str, Any]) -> dict[str, Any]:
    return {"taskId": task.task_id, "taskName": task.task_name, "syncStats": {**stats, "taskId": task.task_id}}


def _config_line(task: SyncTask) -> dict[str, Any]:
    return {
        "taskId": task.task_id,
        "taskName": task.task_name,
        "sourceType": task.source_type,
        "destinationType": task.destination_type,
        "sourceConfig": {k: str(v) for k, v in task.source_config.items()},
        "desConfig": {k: str(v) for k, v in task.destination_config.items()},
        "syncConfig": {name: getattr(task.spec.options, option) for name, option in OPTION_NAMES.items()},
        "sourceFieldName": task.spec.source_table,
        "targetFieldName": task.spec.target_table,
        "fields": [
            {
                "javaField": f.name,
                "sourceType": f.type,
                "targetType": f.target_type,
                "sourceField": f.source,
                "checkpoint": f.checkpoint,
                "targetField": f.target,
                "role": f.role,
            }
            for f in task.spec.fields
        ],
    }


@dataclass
class _Run:
    """What the steps of one run share."""

    spark: SparkSession
    task: SyncTask
    state_path: str
    log: CheckpointLog
    stats: dict[str, Any]
    run_id: str
    source: DataFrame
    runs: RunLog
    counts: Counts | None = None
    late: int = 0
    unnoted: bool = False  # whether rows without a key may have been delivered by a version that did not note them
    lost_shards: set[int] = field(default_factory=set)
    result: DataFrame | None = None


@contextmanager
def _recorded(spark: SparkSession, task: SyncTask, state_path: str, guard: bool, now: datetime | None) -> Iterator[_Run]:
    """Check and guard the task, open its source, and keep the ledger around the run."""
    problem = task.error()
    if problem:
        raise TaskRejected(problem)
    now = now or datetime.now()
    ledger, log = Ledger(spark, f"{state_path}/ledger"), CheckpointLog(spark, f"{state_path}/checkpoints")
    if guard:
        blocked = ledger.blocked(now, task.spec.options.global_timeout_s)
        reason = blocked.where(F.col("task_id") == task.task_id).first()
        if reason is not None:
            raise TaskRejected(f"{reason['reason']}: {task.task_id}")
    for target in task.targets():
        find_sink(target.kind)
        named = [f.name for f in task.spec.fields if is_index_type(f.target_type)]
        if named and target.kind.strip().upper() != INDEX:
            raise SpecError(f"index field types need an index target: {', '.join(named)}")
    started = time.time()
    source = open_source(spark, task.source_type, task.spec, task.source_config)
    stats = _new_stats(task.spec, started)
    ledger.append(control_rows(spark, [_config_line(task), _stats_line(task, stats)], LINE), now, changed_only=True)
    run_id = f"{now:%Y%m%d%H%M%S}-{uuid.uuid4().hex[:8]}"
    this = _Run(spark, task, state_path, log, stats, run_id, source, RunLog(spark, f"{state_path}/runs"))
    try:
        known = known_counts(spark, task.source_type, task.spec, task.source_config)
        this.counts = Counts(*known) if known else source_counts(source, task.spec.checkpoint.source)
        stats["totalRecords"], stats["status"] = this.counts.total, "COMPLETED"
        yield this
    except Exception as e:
        stats["status"] = "FAILED"
        if not stats["failedBatches"]:
            stats["failedBatches"] = [f"{run_id}: {type(e).__name__}: {e}"]
        raise
    finally:
        took = time.time() - started
        stats["duration"], stats["persisted"], stats["version"] = int(took * 1000), True, 1
        line = control_rows(spark, [_stats_line(task, stats)], LINE)
        ledger.append(line, now + timedelta(seconds=took))
        this.result = line.withColumn("syncStats", F.col("syncStats").dropFields("taskId")).select(
            "taskId", "taskName", "syncStats.*"
        )


@dataclass(frozen=True)
class _Pending:
    """Rows a run has to deliver, how far it means to go, and what each slice holds of them."""

    shards: int
    point: ResumePoint
    rows: DataFrame
    intent: Intent
    first: int
    again: bool
    per_slice: dict[int, dict[str, int]]

    def left(self) -> range:
        """Slices still to deliver."""
        return range(self.first, len(self.intent.slices))

    def reached(self, number: int) -> dict[int, int | None]:
        """Checkpoint of every shard once slice ``number`` is delivered.

        Shards without rows get it too: then a later run with another number of shards has one
        bound for all, repeats nothing, and the scan can skip what lies below it.
        """
        upto, out = self.intent.slices[number][1], {}
        for shard in range(self.shards):
            old = self.point.bounds.get(shard)
            out[shard] = old if upto is None else upto if old is None else max(old, upto)
        return out


def _in_slice(df: DataFrame, key: str, bounds: Slice) -> DataFrame:
    """Rows of one slice; the open end below takes the rows without a key."""
    (after, upto), k = bounds, F.col(f"`{key}`").cast("bigint")
    if after is not None:
        df = df.where(k > F.lit(after))
    if upto is not None:
        df = df.where(k.isNull() | (k <= F.lit(upto)) if after is None else k <= F.lit(upto))
    return df


def _pending(this: _Run, filter_key: Column | None, slices: int) -> _Pending:
    """What an earlier run left unfinished, under its id and bounds; else everything past the
    checkpoints up to the largest key known, as a new run.

    Rows without a key belong to the first run of a task; later ones have deliveries of
    their own (``_late_rows``).
    """
    task, counts = this.task, this.counts
    key = task.spec.checkpoint.source
    seen = this.log.load(task.task_id).select(SHARD, "shard_count", "checkpoint", "run_id").collect()
    earlier = this.runs.newest(task.task_id)
    first = earlier.finished_slices({r["run_id"] for r in seen}) if earlier else 0
    again = earlier is not None and first < len(earlier.slices)
    if again:
        with_nulls = earlier.with_nulls and first == 0
        intent = replace(earlier, nulls=counts.nulls) if with_nulls else earlier
        point = resume_point(seen, intent.shards)
        rows = resume_filter(this.source, key, point, high=intent.high, nulls=with_nulls)
    else:
        shards = uneven_shards(seen) or planned_shards(this.spark, counts.total, task.spec)
        point = resume_point(seen, shards)
        with_nulls = earlier is None and point.floor is None
        rows = resume_filter(this.source, key, point, high=counts.high, nulls=with_nulls)
        nulls = counts.nulls if with_nulls else earlier.nulls if earlier else 0
        cuts = _slices(rows, key, counts.high, slices)
        intent, first = Intent(this.run_id, counts.high, cuts, shards, nulls, with_nulls), 0
    this.unnoted = not with_nulls and (earlier is None or intent.nulls > 0)
    this.late = max(0, counts.nulls - intent.nulls)
    pending = _Pending(intent.shards, point, rows, intent, first, again, _per_slice(rows, key, filter_key, intent))
    this.stats["shardCount"] = intent.shards
    this.stats["scannedRecords"] += sum(r["scanned_records"] for r in pending.per_slice.values())
    this.stats["filteredRecords"] += sum(r["filtered_records"] for r in pending.per_slice.values())
    if pending.per_slice and (not again or intent != earlier):
        this.runs.begin(task.task_id, intent)
    return pending


def _per_slice(
    rows: DataFrame, key: str, filter_key: Column | None, intent: Intent
) -> dict[int, dict[str, int]]:
    """Scanned, filtered and processed rows of every slice: one pass over key and filter columns."""
    k, place = F.col(f"`{key}`").cast("bigint"), F.lit(0)
    for _, upto in intent.slices[:-1]:
        place = place + F.when(k > F.lit(upto), 1).otherwise(0)
    labelled = rows.select(
        place.alias(SHARD), (filter_key if filter_key is not None else F.lit("")).alias("_f")
    )
    return {r[SHARD]: r.asDict() for r in shard_counters(labelled, F.col("_f")).collect()}


def _keyless_path(this: _Run) -> str:
    return f"{this.state_path}/keyless"


def _note_keyless(this: _Run, rows: DataFrame, run_id: str) -> None:
    """How often each of these rows without a key occurs: they count as delivered from here on."""
    counts = row_counts(rows).withColumn("task_id", F.lit(this.task.task_id))
    counts.write.mode("overwrite").parquet(f"{_keyless_path(this)}/counts/run_id={run_id}")


def _keyless_counts(this: _Run) -> DataFrame:
    try:
        noted = this.spark.read.schema(f"{COUNTS}, task_id string, run_id string").parquet(f"{_keyless_path(this)}/counts")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        noted = no_rows(this.spark, f"{COUNTS}, task_id string")
    return noted.where(F.col("task_id") == this.task.task_id)


def _late_rows(this: _Run) -> Iterator[tuple[str, DataFrame, frozenset[int]]]:
    """Deliveries of rows without a key that came after the first run: id, rows, targets that have them.

    New are rows beyond what was noted, by content and number. They are set down in a table, so that a
    run that dies is finished with the same rows under the same id, and noted once all targets have them.
    """
    task, folder = this.task, f"{_keyless_path(this)}/rows"

    def deliveries(open_ids: Mapping[str, frozenset[int]]) -> Iterator[tuple[str, DataFrame, frozenset[int]]]:
        for run_id, done in open_ids.items():
            rows = this.spark.read.schema(this.source.schema).parquet(f"{folder}/run_id={run_id}")
            yield run_id, rows, done
            _note_keyless(this, rows, run_id)
            this.runs.late_done(task.task_id, run_id)

    yield from deliveries(this.runs.late_open(task.task_id))
    if not this.counts.nulls:
        return
    noted = _keyless_counts(this)
    if this.unnoted and noted.isEmpty():
        # An earlier version delivered rows without a key and noted nothing: which ones are new is unknown.
        if this.late:
            this.stats["status"] = "PARTIAL"
            this.stats["failedBatches"] += [
                f"{this.late} rows without a key came after the first run and were not delivered"
            ]
        return
    run_id = f"{this.run_id}-late"
    key = F.col(f"`{task.spec.checkpoint.source}`").cast("bigint")
    new = surplus(this.source.where(key.isNull()), noted)
    new.write.mode("overwrite").parquet(f"{folder}/run_id={run_id}")
    if not this.spark.read.schema(new.schema).parquet(f"{folder}/run_id={run_id}").isEmpty():
        this.runs.late_begin(task.task_id, run_id)
        yield from deliveries({run_id: frozenset()})


def _count_late(this: _Run, rows: DataFrame, filter_key: Column | None) -> int:
    """Add the rows of a late delivery to the statistics; the number of those that pass the filter."""
    counts = _per_slice(rows, this.task.spec.checkpoint.source, filter_key, Intent("", None, ((None, None),), 1))
    this.stats["scannedRecords"] += sum(r["scanned_records"] for r in counts.values())
    this.stats["filteredRecords"] += sum(r["filtered_records"] for r in counts.values())
    return sum(r["processed_records"] for r in counts.values())


def _each_pending(this: _Run, filter_key: Column | None, slices: int) -> Iterator[_Pending]:
    """What an earlier run left, if it did, then what is new."""
    while this.counts.total:
        pending = _pending(this, filter_key, slices)
        yield pending
        this.stats["completedShards"] = pending.shards
        if not pending.again:
            break


def run(
    spark: SparkSession,
    task: SyncTask,
    state_path: str,
    *,
    filter_key: Column | None = None,
    mode: str = "strict",
    rules: Rules = DEFAULT_RULES,
    slices: int = 1,
    stage: bool | None = None,
    guard: bool = True,
    now: datetime | None = None,
) -> DataFrame:
    """Run ``task`` and return its statistics, one row.

    The largest key is fixed before anything is read, so rows that arrive later
    belong to the next run. Rows are written from natural scan partitions; shards
    only label checkpoints and counters, so the run needs no shuffle. ``slices``
    cuts the key range so that a failure costs one slice. ``stage`` lands the mapped
    rows once for all targets; left open, that is done for several targets fed from
    a database, while files are simply read again. In ``lenient`` mode rows that
    cannot be converted go to ``<state>/dead_letters``.
    """
    with _recorded(spark, task, state_path, guard, now) as this:
        if stage is None:
            stage = len(task.targets()) > 1 and _from_database(task)
        for pending in _each_pending(this, filter_key, slices):
            _deliver_slices(this, pending, filter_key, mode, rules, stage)
        for late_id, rows, done in _late_rows(this):
            kept = _count_late(this, rows, filter_key)
            on_done = partial(this.runs.target_done, task.task_id, late_id, 0)
            set_aside = _write(this, keep_rows(rows, filter_key), late_id, mode, rules, stage, this.stats["shardCount"], done, on_done)
            this.stats["processedRecords"] += kept - set_aside
    return this.result


def _from_database(task: SyncTask) -> bool:
    return task.source_type.strip().lower() in DATABASES


def _deliver_slices(
    this: _Run, pending: _Pending, filter_key: Column | None, mode: str, rules: Rules, stage: bool
) -> None:
    """Write what is pending, slice by slice, and note how far every shard got."""
    if not pending.per_slice and not pending.again:
        return
    task, stats, intent = this.task, this.stats, pending.intent
    key = task.spec.checkpoint.source
    for number in pending.left():
        rows = _in_slice(pending.rows, key, intent.slices[number])
        slice_id = intent.slice_id(number)
        if intent.with_nulls and number == 0 and intent.nulls:
            _note_keyless(this, pending.rows.where(F.col(f"`{key}`").cast("bigint").isNull()), slice_id)
        done = {target for n, target in intent.done if n == number}
        on_done = partial(_target_done, this, intent, number, len(task.targets()))
        set_aside = _write(this, keep_rows(rows, filter_key), slice_id, mode, rules, stage, pending.shards, done, on_done)
        this.log.save(task.task_id, pending.shards, pending.reached(number), slice_id, datetime.now())
        stats["processedRecords"] += pending.per_slice.get(number, {}).get("processed_records", 0) - set_aside


def _write(
    this: _Run,
    part: DataFrame,
    run_id: str,
    mode: str,
    rules: Rules,
    stage: bool,
    shards: int,
    done: Collection[int],
    on_done: Callable[[int], None],
) -> int:
    """Map rows and write them to every target that does not have them; how many were set aside."""
    task, spec, stats, set_aside = this.task, this.task.spec, this.stats, 0
    if mode == "lenient":
        good, bad = split_bad_rows(part, spec, rules=rules)
        folder = f"{this.state_path}/dead_letters/run_id={run_id}"
        seen = Observation()
        bad = bad.withColumn("task_id", F.lit(task.task_id)).observe(seen, F.count(F.lit(1)).alias("rows"))
        bad.write.mode("overwrite").parquet(folder)
        set_aside = seen.get["rows"]
    else:
        good = map_columns(part, spec, rules=rules)
    with staged(good, "stage") if stage else nullcontext(good) as rows:
        progress = f"{this.state_path}/progress/run_id={run_id}"
        outcomes = fan_out(rows, spec, task.targets(), run_id=run_id, progress=progress, done=done, on_done=on_done)
    stats["retryCount"] += sum(o.attempts - 1 for o in outcomes)
    failed = [o for o in outcomes if not o.delivered]
    if failed:
        stats["failedShards"] = shards
        stats["failedBatches"] = [f"{run_id}: {o.name}: {o.error}" for o in failed]
        raise SyncFailed(failed[0].error)
    return set_aside


def _target_done(this: _Run, intent: Intent, number: int, targets: int, target: int) -> None:
    """Note a target's rows; after the last target the checkpoint says it."""
    if target < targets - 1:
        this.runs.target_done(this.task.task_id, intent.run_id, number, target)


def run_batches(
    spark: SparkSession,
    task: SyncTask,
    send: Callable[[pa.Table], object],
    state_path: str,
    *,
    filter_key: Column | None = None,
    rules: Rules = DEFAULT_RULES,
    slices: int = 1,
    guard: bool = True,
    now: datetime | None = None,
) -> DataFrame:
    """Run ``task`` into a Python target, batch by batch, and return its statistics.

    ``send`` gets every batch of mapped rows as an Arrow table and is retried. Rows of
    batches that stay undelivered go to ``<state>/dead_letters``, and the checkpoint passes
    them: every row is sent or is a dead letter, and the run fails once all are tried.
    Each task notes what it delivered under ``<state>/progress`` as it commits. A run that
    dies, or whose target is gone for good (``send`` raises ``TargetGone``), is finished by
    the next one, which sends what is not noted: the rest of the batches, and again those
    of tasks that died with their executor. ``slices`` cuts the rows at quantiles of the
    key and checkpoints after each.
    """
    with _recorded(spark, task, state_path, guard, now) as this:
        for pending in _each_pending(this, filter_key, slices):
            _deliver_batches(this, pending, send, filter_key, rules)
        for late_id, rows, _ in _late_rows(this):
            kept = _count_late(this, rows, filter_key)
            _send(this, keep_rows(rows, filter_key), send, late_id, max(1, this.stats["shardCount"]), kept, rules)
        if this.lost_shards:
            this.stats["failedShards"] = len(this.lost_shards)
            this.stats["completedShards"] = this.stats["shardCount"] - len(this.lost_shards)
            raise SyncFailed(this.stats["failedBatches"][0])
    return this.result


def _deliver_batches(
    this: _Run, pending: _Pending, send: Callable[[pa.Table], object], filter_key: Column | None, rules: Rules
) -> None:
    task, intent = this.task, pending.intent
    key = task.spec.checkpoint.source
    for number in pending.left() if pending.per_slice or pending.again else ():
        part = _in_slice(pending.rows, key, intent.slices[number])
        slice_id = intent.slice_id(number)
        if intent.with_nulls and number == 0 and intent.nulls:
            _note_keyless(this, pending.rows.where(F.col(f"`{key}`").cast("bigint").isNull()), slice_id)
        expected = pending.per_slice.get(number, {}).get("processed_records", 0)
        _send(this, keep_rows(part, filter_key), send, slice_id, pending.shards, expected, rules)
        this.log.save(task.task_id, pending.shards, pending.reached(number), slice_id, datetime.now())


def _send(
    this: _Run, part: DataFrame, send: Callable[[pa.Table], object], run_id: str, shards: int, expected: int, rules: Rules
) -> None:
    """Send rows batch by batch and keep those of lost batches; a target that is gone ends the run."""
    task, spec = this.task, this.task.spec
    kept = part.withColumn(KEY, F.col(f"`{spec.checkpoint.source}`").cast("bigint"))
    mapped = map_columns(with_shards(kept, KEY, shards), spec, keep=(SHARD, KEY), rules=rules)
    rows = assign_batches(mapped, KEY, spec.options.batch_size, rows=expected)
    with staged(rows, "batches") if _from_database(task) else nullcontext(rows) as batches:
        progress = f"{this.state_path}/progress/run_id={run_id}"
        outcomes = delivery.deliver(batches, send, spec.options, key=KEY, progress=progress)
        left = _count_batches(this, outcomes)
        if this.lost_shards:
            folder = f"{this.state_path}/dead_letters/run_id={run_id}"
            dead = delivery.dead_letters(batches, outcomes, task.task_id, run_id)
            dead.drop("run_id").write.mode("overwrite").parquet(folder)
    if left:
        raise SyncFailed(f"the target is gone; {left} batches are left for the next run")


def _count_batches(this: _Run, outcomes: DataFrame) -> int:
    """Add the outcomes of a slice to the statistics; the number of batches left for the next run."""
    stats, most = this.stats, this.task.spec.options.max_failed_batches
    totals = outcomes.agg(
        F.coalesce(F.sum(F.when(F.col("delivered"), F.col("n_rows"))), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("retries"), F.lit(0)).alias("retries"),
        F.count_if("left_over").alias("left"),
    ).first()
    stats["processedRecords"] += totals["rows"]
    stats["retryCount"] += totals["retries"]
    durations, last = stats.setdefault("shardDurations", {}), stats.setdefault("batchTimes", {})
    for r in shard_times(outcomes.where("not left_over")).collect():
        durations[str(r[SHARD])] = durations.get(str(r[SHARD]), 0) + r["duration_ms"]
        last[str(r[SHARD])] = r["last_batch_ms"]
    lost = outcomes.where(~F.col("delivered") & ~F.col("left_over"))
    shards = {r[SHARD] for r in lost.select(SHARD).distinct().collect()}
    this.lost_shards |= shards
    room = most - len(stats["failedBatches"])
    if shards and room > 0:
        stats["failedBatches"] += [
            f"shard {r[SHARD]} batch {r[BATCH]}: {r['error']}"
            for r in capped(lost, room, order=[SHARD, BATCH]).collect()
        ]
    return totals["left"]
