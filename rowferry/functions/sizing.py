"""Shard-count sizing, run status and run-rate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowferry.spec import SyncOptions

# Memory estimate of one buffered row, and the buffer copies kept.
ROW_BYTES = 120
BUFFER_COPIES = 2
MAX_CPU_SHARDS = 256


def _limits(options: SyncOptions, cores: int, heap_bytes: int) -> tuple[int, int, int]:
    """(fewest shards, shards the cores want, shards the memory allows)."""
    low = max(1, options.min_shards)
    high = max(low, options.max_shards)
    by_cpu = min(max(1, min(cores * 2, MAX_CPU_SHARDS)), high)
    buffered = max(1, options.batch_size) * ROW_BYTES * BUFFER_COPIES
    by_memory = min(max(1, (heap_bytes // 2) // buffered), high)
    return low, by_cpu, by_memory


def shard_count(total: Column, options: SyncOptions, cores: int, heap_bytes: int) -> Column:
    """Adaptive shard count of a table with ``total`` rows.

    Enough shards for the rows or for the cores, whichever is more, but no more
    than memory allows and at least ``min_shards``. The CPU and memory terms depend
    on the machine only, so they are literals.
    """
    low, by_cpu, by_memory = (F.lit(n).cast("bigint") for n in _limits(options, cores, heap_bytes))
    by_rows = F.ceil(total / F.lit(max(1, options.records_per_shard))).cast("bigint")
    return F.greatest(low, F.least(F.greatest(by_rows, by_cpu), by_memory))


def shard_count_of(total: int, options: SyncOptions, cores: int, heap_bytes: int) -> int:
    """The same for one known total."""
    low, by_cpu, by_memory = _limits(options, cores, heap_bytes)
    by_rows = -(-total // max(1, options.records_per_shard))
    return max(low, min(max(by_rows, by_cpu), by_memory))


def run_status(total: Column, failed: Column, skipped: Column, timed_out: Column | None = None) -> Column:
    """Final status: an empty table is COMPLETED, any failure FAILED, any skip PARTIAL."""
    status = (
        F.when(total == 0, F.lit("COMPLETED"))
        .when(failed > 0, F.lit("FAILED"))
        .when(skipped > 0, F.lit("PARTIAL"))
        .otherwise(F.lit("COMPLETED"))
    )
    return status if timed_out is None else F.when(timed_out, F.lit("TIMEOUT")).otherwise(status)


def run_status_compat(total: Column, failed: Column, timed_out: Column | None = None) -> Column:
    """Status as older ledgers hold it: a failed shard is STOPPED, a skip COMPLETED."""
    plain = F.when((total > 0) & (failed > 0), F.lit("STOPPED")).otherwise(F.lit("COMPLETED"))
    return plain if timed_out is None else F.when(timed_out, F.lit("TIMEOUT")).otherwise(plain)


def minutes(duration_ms: Column) -> Column:
    return duration_ms / F.lit(60000.0)


def rows_per_second(rows: Column, duration_ms: Column) -> Column:
    return F.when(duration_ms > 0, rows / (duration_ms / F.lit(1000.0)))
