"""Counters, sizing, status and run rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.catalog.registry import query, table
from rowferry.functions import sizing
from rowferry.functions.dates import local_millis
from rowferry.operators import counters
from rowferry.operators.sharding import SHARD, with_shards
from rowferry.spec import SyncOptions

# Rows of users 0, 5, 10, ... and cheap events are filtered.
_KEY = "CASE WHEN user_id % 5 = 0 THEN 'user' WHEN value < 2 THEN 'small' ELSE '' END"


def _filter_key():
    return (
        F.when(F.col("user_id") % 5 == 0, F.lit("user")).when(F.col("value") < 2, F.lit("small")).otherwise(F.lit(""))
    )


@query(f"SELECT event_id, user_id, value FROM events WHERE {_KEY} = ''")
def record_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose filter key is empty."""
    return counters.keep_rows(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), _filter_key())


@query("SELECT event_id, value FROM events")
def record_filter_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a filter key every row is kept."""
    return counters.keep_rows(table(spark, sf_dir, "events").select("event_id", "value"))


@query("SELECT doc_id, lang FROM documents WHERE lang = 'en' AND length(text) >= 200")
def custom_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter key of one's own: any expression that names the reason to drop a row."""
    reason = F.concat(
        F.when(F.col("lang") != "en", F.lit("language ")).otherwise(F.lit("")),
        F.when(F.length("text") < 200, F.lit("short")).otherwise(F.lit("")),
    )
    return counters.keep_rows(table(spark, sf_dir, "documents"), reason).select("doc_id", "lang")


@query(
    f"SELECT event_id % 8 AS shard_id, count(*) AS scanned_records, count(*) FILTER (WHERE {_KEY} <> '') AS "
    f"filtered_records, count(*) FILTER (WHERE {_KEY} = '') AS processed_records, max(event_id) AS max_key "
    "FROM events GROUP BY 1"
)
def counters_per_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned, filtered and processed rows and the last key of every shard."""
    rows = with_shards(table(spark, sf_dir, "events"), "event_id", 8)
    return counters.shard_counters(rows, _filter_key(), key="event_id")


@query(
    f"SELECT count(*) AS scanned_records, count(*) FILTER (WHERE {_KEY} <> '') AS filtered_records, "
    f"count(*) FILTER (WHERE {_KEY} = '') AS processed_records FROM events"
)
def counters_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all shards."""
    rows = with_shards(table(spark, sf_dir, "events"), "event_id", 8)
    per_shard = counters.shard_counters(rows, _filter_key())
    totals = counters.total_counters(per_shard)
    return totals.select([F.col(c).cast("bigint").alias(c) for c in totals.columns])


@query(
    "SELECT event_type, count(*) AS total, greatest(1, least(greatest(CAST(ceil(count(*) / 100.0) AS BIGINT), 16), 64)) "
    "AS shard_count FROM events GROUP BY event_type"
)
def shard_count_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive shard count, each event type taken as a table (8 cores, 4 GiB heap)."""
    totals = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("total"))
    options = SyncOptions(records_per_shard=100)
    return totals.withColumn("shard_count", sizing.shard_count(F.col("total"), options, 8, 4 * 2**30))


@query(
    "SELECT run_id, duration_ms, processed_records, duration_ms / 60000.0::DOUBLE AS duration_minutes, "
    "CASE WHEN duration_ms > 0 THEN processed_records / (duration_ms / 1000.0::DOUBLE) END AS rows_per_second FROM ("
    "SELECT user_id AS run_id, max((epoch_us(ts) // 1000)) - min((epoch_us(ts) // 1000)) AS duration_ms, "
    "count(*) AS processed_records FROM events GROUP BY user_id)"
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes and rows per second, each user's events taken as a run."""
    at = local_millis(F.col("ts"))
    runs = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("run_id"))
        .agg((F.max(at) - F.min(at)).alias("duration_ms"), F.count(F.lit(1)).alias("processed_records"))
    )
    return counters.run_summary(runs)


_BATCH_LOG = (
    "SELECT user_id % 32 AS shard_id, event_id AS batch_id, (epoch_us(ts) // 1000) AS start_ms, "
    "(epoch_us(ts) // 1000) + CAST(floor(value * 100) AS BIGINT) AS end_ms FROM events"
)
_TIMES = (
    "SELECT shard_id, max(end_ms) - min(start_ms) AS duration_ms, "
    f"arg_max(end_ms - start_ms, batch_id) AS last_batch_ms FROM ({_BATCH_LOG}) GROUP BY shard_id"
)


def _batch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = local_millis(F.col("ts"))
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 32).alias(SHARD),
        F.col("event_id").alias("batch_id"),
        start.alias("start_ms"),
        (start + F.floor(F.col("value") * 100)).alias("end_ms"),
    )


@query(_TIMES)
def last_batch_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duration of every shard and the time its last batch took."""
    return counters.shard_times(_batch_log(spark, sf_dir))


@query(
    "SELECT '{' || string_agg('\"' || shard_id || '\":' || duration_ms, ',' ORDER BY shard_id) || '}' AS shard_durations, "
    "'{' || string_agg('\"' || shard_id || '\":' || last_batch_ms, ',' ORDER BY shard_id) || '}' AS batch_times "
    f"FROM ({_TIMES})"
)
def shard_time_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as the two maps of a stats record, shown as JSON."""
    maps = counters.time_maps(counters.shard_times(_batch_log(spark, sf_dir)))
    return maps.select(F.to_json("shard_durations").alias("shard_durations"), F.to_json("batch_times").alias("batch_times"))


# Each user is a run over ten shards; what happened to a shard follows from its rows.
_OUTCOMES = (
    "SELECT user_id, event_id % 10 AS shard_id, CASE WHEN user_id % 3 = 0 AND value > 200 THEN 'failed' "
    "WHEN user_id % 2 = 0 AND event_type = 'error' THEN 'skipped' ELSE 'completed' END AS outcome FROM events"
)
_TALLIES = (
    "SELECT user_id, count(*) AS shard_count, count(*) FILTER (WHERE NOT failed AND NOT skipped) AS completed_shards, "
    "count(*) FILTER (WHERE failed) AS failed_shards, count(*) FILTER (WHERE NOT failed AND skipped) AS skipped_shards "
    "FROM (SELECT user_id, shard_id, bool_or(outcome = 'failed') AS failed, bool_or(outcome = 'skipped') AS skipped "
    f"FROM ({_OUTCOMES}) GROUP BY user_id, shard_id) GROUP BY user_id"
)


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = (
        F.when((F.col("user_id") % 3 == 0) & (F.col("value") > 200), F.lit("failed"))
        .when((F.col("user_id") % 2 == 0) & (F.col("event_type") == "error"), F.lit("skipped"))
        .otherwise(F.lit("completed"))
    )
    return table(spark, sf_dir, "events").select(
        "user_id", (F.col("event_id") % 10).alias(SHARD), outcome.alias("outcome")
    )


@query(_TALLIES)
def shard_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed, failed and skipped shards of every run; a shard counts once."""
    return counters.shard_tallies(_outcomes(spark, sf_dir), ["user_id"])


@query(
    "SELECT user_id, CASE WHEN failed_shards > 0 THEN 'FAILED' WHEN skipped_shards > 0 THEN 'PARTIAL' ELSE 'COMPLETED' "
    "END AS status, CASE WHEN failed_shards > 0 THEN 'STOPPED' ELSE 'COMPLETED' END AS status_compat "
    f"FROM ({_TALLIES})"
)
def final_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every run from its shards, and as older ledgers say it."""
    t = counters.shard_tallies(_outcomes(spark, sf_dir), ["user_id"])
    total, failed, skipped = F.col("shard_count"), F.col("failed_shards"), F.col("skipped_shards")
    return t.select(
        "user_id",
        sizing.run_status(total, failed, skipped).alias("status"),
        sizing.run_status_compat(total, failed).alias("status_compat"),
    )
