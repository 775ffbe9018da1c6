"""Run statistics as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry.functions import sizing
from rowferry.operators.sharding import SHARD


def filtered_out(filter_key: Column) -> Column:
    """A row is filtered when its filter key is not empty; NULL counts as empty."""
    return F.coalesce(filter_key, F.lit("")) != F.lit("")


def keep_rows(df: DataFrame, filter_key: Column | None = None) -> DataFrame:
    """Rows that pass the record filter; without a filter key that is every row."""
    return df if filter_key is None else df.where(~filtered_out(filter_key))


def shard_counters(df: DataFrame, filter_key: Column | None = None, *, key: str | None = None) -> DataFrame:
    """Scanned, filtered and processed rows per shard, combined map-side."""
    dropped = F.lit(False) if filter_key is None else filtered_out(filter_key)
    aggs = [
        F.count(F.lit(1)).alias("scanned_records"),
        F.count_if(dropped).alias("filtered_records"),
        F.count_if(~dropped).alias("processed_records"),
    ]
    if key is not None:
        aggs.append(F.max(F.col(f"`{key}`")).alias("max_key"))
    return df.groupBy(SHARD).agg(*aggs)


def total_counters(per_shard: DataFrame) -> DataFrame:
    """Totals over shards, one row."""
    return per_shard.agg(
        F.coalesce(F.sum("scanned_records"), F.lit(0)).alias("scanned_records"),
        F.coalesce(F.sum("filtered_records"), F.lit(0)).alias("filtered_records"),
        F.coalesce(F.sum("processed_records"), F.lit(0)).alias("processed_records"),
    )


def shard_tallies(outcomes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Completed, failed and skipped shards per run (``by``); a failed shard counts once.

    ``outcomes`` holds one or more rows per shard with ``outcome`` in completed /
    failed / skipped; the worst outcome of a shard decides.
    """
    worst = outcomes.groupBy(*by, SHARD).agg(
        F.bool_or(F.col("outcome") == "failed").alias("failed"),
        F.bool_or(F.col("outcome") == "skipped").alias("skipped"),
    )
    return worst.groupBy(*by).agg(
        F.count(F.lit(1)).alias("shard_count"),
        F.count_if(~F.col("failed") & ~F.col("skipped")).alias("completed_shards"),
        F.count_if(F.col("failed")).alias("failed_shards"),
        F.count_if(~F.col("failed") & F.col("skipped")).alias("skipped_shards"),
    )


def shard_times(batch_log: DataFrame) -> DataFrame:
    """Duration of every shard and the time of its last batch.

    ``batch_log``: shard_id, batch_id, start_ms, end_ms.
    """
    return batch_log.groupBy(SHARD).agg(
        (F.max("end_ms") - F.min("start_ms")).alias("duration_ms"),
        F.max_by(F.col("end_ms") - F.col("start_ms"), F.col("batch_id")).alias("last_batch_ms"),
    )


def time_maps(times: DataFrame) -> DataFrame:
    """Per-shard times as the two maps a stats record carries: one entry per shard."""

    def as_map(value: str) -> Column:
        return F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(SHARD), F.col(value)))))

    return times.agg(as_map("duration_ms").alias("shard_durations"), as_map("last_batch_ms").alias("batch_times"))


def run_summary(stats: DataFrame) -> DataFrame:
    """Minutes and rows per second next to the totals of each run."""
    return stats.withColumn("duration_minutes", sizing.minutes(F.col("duration_ms"))).withColumn(
        "rows_per_second", sizing.rows_per_second(F.col("processed_records"), F.col("duration_ms"))
    )
