"""Shards, batches and resume."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.catalog.registry import query, table
from rowferry.operators.batches import assign_batches, batch_manifest
from rowferry.operators.ranges import bins_of, even_cuts
from rowferry.operators.resume import resume_filter, resume_point
from rowferry.operators.sharding import SHARD, key_order, max_key_per_shard, one_shard, stride_of, with_shards
from rowferry.sources.jdbc import range_predicates
from rowferry.state import checkpoints
from rowferry.storage import new_folder

# Keys on both sides of zero, so the modulo variants differ.
_SHIFTED = "SELECT event_id - 5000 AS k, user_id FROM events"


def _shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("event_id") - 5000).alias("k"), "user_id")


@query(f"SELECT k, user_id, ((k % 16) + 16) % 16 AS shard_id FROM ({_SHIFTED})")
def shard_pmod(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key has a shard."""
    return with_shards(_shifted(spark, sf_dir), "k", 16)


@query(f"SELECT k, user_id, k % 16 AS shard_id FROM ({_SHIFTED}) WHERE k % 16 >= 0")
def shard_signed_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed remainder: negative keys with a remainder belong to no shard."""
    return with_shards(_shifted(spark, sf_dir), "k", 16, how="signed")


@query(f"SELECT k, user_id, abs(k) % 16 AS shard_id FROM ({_SHIFTED})")
def shard_abs_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remainder of the absolute key."""
    return with_shards(_shifted(spark, sf_dir), "k", 16, how="abs")


@query(
    "WITH b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) + 1 - min(o_orderkey) AS span FROM orders) "
    "SELECT o_orderkey, o_totalprice, ((o_orderkey - lo + 1) * 24 - 1) // span AS range_id FROM orders, b"
)
def shard_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evenly cut key ranges, as a range-partitioned scan cuts them."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    low, high = orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    return orders.withColumn("range_id", stride_of("o_orderkey", low, high, 24))


@query("SELECT l_orderkey * l_orderkey AS k, l_linenumber, true AS even FROM lineitem")
def shard_ranges_uneven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 ranges over keys that lie ever farther apart: each row is in one, and none has twice the mean."""
    lineitem = table(spark, sf_dir, "lineitem")
    rows = lineitem.select((F.col("l_orderkey") * F.col("l_orderkey")).alias("k"), "l_linenumber")
    low, high, total = rows.agg(F.min("k"), F.max("k"), F.count("k")).first()
    cuts = even_cuts(low, high, total, 24, bins_of(rows, "k", low, high)) if total else []
    scans = [F.when(F.expr(p), F.lit(n)) for n, p in enumerate(range_predicates("k", cuts, "jdbc:mysql:"))]
    # A row that two ranges want is shown twice, one that none wants not at all.
    held = rows.withColumn("range_id", F.explode(F.array_compact(F.array(*scans))))
    sizes = held.groupBy("range_id").agg((F.count(F.lit(1)) * 24 < 2 * total).alias("even"))
    return held.join(F.broadcast(sizes), "range_id").select("k", "l_linenumber", "even")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def shard_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scans of single shards together are the source."""
    orders = table(spark, sf_dir, "orders")
    scans = [one_shard(orders, "o_orderkey", 8, shard).drop(SHARD) for shard in range(8)]
    return reduce(DataFrame.unionByName, scans)


@query(
    "SELECT s.shard_id, coalesce(CAST(max(l_orderkey) AS VARCHAR), '') AS max_key "
    "FROM (SELECT unnest(range(0, 64)) AS shard_id) s "
    "LEFT JOIN lineitem ON l_orderkey % 64 = s.shard_id GROUP BY s.shard_id"
)
def shard_max_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest key per shard as text."""
    return max_key_per_shard(table(spark, sf_dir, "lineitem"), "l_orderkey", 64)


@query(
    "SELECT s.shard_id, coalesce(CAST(max(n_nationkey) AS VARCHAR), '') AS max_key "
    "FROM (SELECT unnest(range(0, 64)) AS shard_id) s "
    "LEFT JOIN nation ON n_nationkey % 64 = s.shard_id GROUP BY s.shard_id"
)
def shard_max_checkpoint_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With more shards than keys, empty shards have the empty text."""
    return max_key_per_shard(table(spark, sf_dir, "nation"), "n_nationkey", 64)


@query("SELECT event_id % 4 AS shard_id, event_id, user_id, value FROM events")
def shard_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows laid out by shard and key."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return key_order(with_shards(events, "event_id", 4), "event_id")


_BATCHED = (
    "SELECT event_id, event_id % 4 AS shard_id, "
    "(row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) - 1) // 500 AS batch_id FROM events"
)
_MANIFEST = (
    "SELECT CAST(shard_id AS BIGINT) AS shard_id, CAST(batch_id AS BIGINT) AS batch_id, "
    "CAST(count(*) AS BIGINT) AS n_rows, min(event_id) AS first_key, max(event_id) AS checkpoint "
    f"FROM ({_BATCHED}) GROUP BY 1, 2"
)


def _sharded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_shards(table(spark, sf_dir, "events").select("event_id"), "event_id", 4)


@query(_BATCHED)
def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch number of every row."""
    return assign_batches(_sharded_events(spark, sf_dir), "event_id", 500)


@query(_BATCHED)
def batch_assign_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with small window groups, the way a large table is numbered."""
    return assign_batches(_sharded_events(spark, sf_dir), "event_id", 500, rows_per_group=1_000)


@query(_MANIFEST)
def batch_manifest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and key range of every batch; the last key is its checkpoint."""
    return batch_manifest(_sharded_events(spark, sf_dir), "event_id", 500)


_HOT = "CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_orderkey END"


@query(
    "SELECT shard_id, batch_id, count(*) AS n_rows, min(k) AS first_key, max(k) AS checkpoint FROM ("
    "SELECT k, k % 8 AS shard_id, (row_number() OVER (PARTITION BY k % 8 ORDER BY k) - 1) // 700 AS batch_id "
    f"FROM (SELECT {_HOT} AS k FROM lineitem)) GROUP BY shard_id, batch_id"
)
def batch_manifest_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key holds about a third of all rows and spans many batches of its shard."""
    key = F.when(F.col("l_returnflag") == "R", F.lit(0)).otherwise(F.col("l_orderkey")).cast("bigint")
    rows = with_shards(table(spark, sf_dir, "lineitem").select(key.alias("k")), "k", 8)
    return batch_manifest(rows, "k", 700, rows_per_group=2_000)


@query(
    f"SELECT k, l_orderkey, l_linenumber, l_extendedprice, CASE WHEN l_linenumber % 2 = 0 THEN '-0.0' ELSE '0.0' END "
    "AS zero, CASE WHEN k <> 0 THEN shard_id END AS shard_id, CASE WHEN k <> 0 THEN lo END AS first_batch, "
    "CASE WHEN k <> 0 THEN hi END AS last_batch FROM (SELECT *, min(b) OVER (PARTITION BY k) AS lo, "
    "max(b) OVER (PARTITION BY k) AS hi FROM (SELECT *, k % 8 AS shard_id, "
    "(row_number() OVER (PARTITION BY k % 8 ORDER BY k) - 1) // 700 AS b "
    f"FROM (SELECT *, {_HOT} AS k FROM lineitem)))"
)
def batch_assign_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole rows under a key that holds a third of them: none lost, repeated or rewritten, zeros keep
    their sign. Rows of one key may be in either of its batches, so the key's first and last are shown."""
    key = F.when(F.col("l_returnflag") == "R", F.lit(0)).otherwise(F.col("l_orderkey")).cast("bigint")
    zero = (F.col("l_linenumber") % 2 * 2 - 1) * F.lit(0.0)  # computed: the optimizer takes literals -0.0 and 0.0 for equal
    rows = table(spark, sf_dir, "lineitem").select(
        key.alias("k"), "l_orderkey", "l_linenumber", "l_extendedprice", zero.alias("zero")
    )
    batched = assign_batches(with_shards(rows, "k", 8), "k", 700, rows_per_group=2_000)
    ends = batched.where("k <> 0").groupBy("k").agg(
        F.min("batch_id").alias("first_batch"), F.max("batch_id").alias("last_batch"), F.max(SHARD).alias(SHARD)
    )
    return batched.drop(SHARD, "batch_id").join(ends, "k", "left").withColumn("zero", F.col("zero").cast("string"))


# Checkpoint of a shard: the last key of its batch number ``shard_id + 1``.
_CHECKPOINTS = f"SELECT shard_id, max(event_id) AS cp FROM ({_BATCHED}) WHERE batch_id <= shard_id + 1 GROUP BY shard_id"


def _checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = batch_manifest(_sharded_events(spark, sf_dir), "event_id", 500)
    return (
        manifest.where(F.col("batch_id") <= F.col(SHARD) + 1)
        .groupBy(SHARD)
        .agg(F.max("checkpoint").cast("string").alias("checkpoint"))
        .withColumn("shard_count", F.lit(4).cast("bigint"))
    )


@query(
    f"SELECT e.event_id, e.user_id, e.value FROM events e LEFT JOIN ({_CHECKPOINTS}) c "
    "ON e.event_id % 4 = c.shard_id WHERE c.cp IS NULL OR e.event_id > c.cp"
)
def resume_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows past the checkpoint of their shard."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return resume_filter(events, "event_id", resume_point(_checkpoints(spark, sf_dir), 4))


@query(
    f"SELECT e.event_id, CASE WHEN e.event_id > c.cp THEN 2 ELSE 1 END AS phase "
    f"FROM events e JOIN ({_CHECKPOINTS}) c ON e.event_id % 4 = c.shard_id"
)
def resume_two_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stopped run delivered and what its successor adds: the table, once."""
    events = table(spark, sf_dir, "events").select("event_id")
    reached = _checkpoints(spark, sf_dir)
    limits = F.broadcast(reached.select(SHARD, F.col("checkpoint").cast("bigint").alias("cp")))
    first = with_shards(events, "event_id", 4).join(limits, SHARD).where(F.col("event_id") <= F.col("cp"))
    second = resume_filter(events, "event_id", resume_point(reached, 4))
    return first.select("event_id", F.lit(1).alias("phase")).unionByName(
        second.select("event_id", F.lit(2).alias("phase"))
    )


@query(f"SELECT event_id, user_id FROM events WHERE event_id > (SELECT min(cp) FROM ({_CHECKPOINTS}))")
def reshard_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With another shard count every shard starts at the smallest old checkpoint."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    return resume_filter(events, "event_id", resume_point(_checkpoints(spark, sf_dir), 6))


_LOG = (
    "SELECT event_type AS task_id, user_id % 8 AS shard_id, CAST(8 AS BIGINT) AS shard_count, "
    "CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id AS VARCHAR) END AS checkpoint, "
    "CAST(event_id AS VARCHAR) AS run_id, ts FROM events"
)
_LATEST = (
    "SELECT task_id, shard_id, shard_count, checkpoint, run_id, ts FROM ("
    f"SELECT *, row_number() OVER (PARTITION BY task_id, shard_id ORDER BY ts DESC, run_id DESC) AS rn FROM ({_LOG})"
    ") WHERE rn = 1"
)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("task_id"),
        (F.col("user_id") % 8).alias(SHARD),
        F.lit(8).cast("bigint").alias("shard_count"),
        F.when(F.col("event_id") % 3 != 0, F.col("event_id").cast("string")).alias("checkpoint"),
        F.col("event_id").cast("string").alias("run_id"),
        "ts",
    )


@query(_LATEST)
def checkpoint_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest checkpoint per task and shard; a deleted one (NULL) stays deleted."""
    return checkpoints.latest(_log(spark, sf_dir))


@query(f"SELECT * FROM ({_LATEST}) WHERE task_id = 'view'")
def checkpoint_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints written to the log table and loaded for one task."""
    log = checkpoints.CheckpointLog(spark, new_folder(spark, "checkpoints"))
    log.append(_log(spark, sf_dir))
    return log.load("view")


@query(
    f"SELECT task_id, shard_id, CASE WHEN shard_id = 3 THEN NULL ELSE checkpoint END AS checkpoint "
    f"FROM ({_LATEST}) WHERE task_id = 'click'"
)
def checkpoint_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleting a checkpoint adds a row without one."""
    log = checkpoints.CheckpointLog(spark, new_folder(spark, "checkpoints"))
    log.append(_log(spark, sf_dir))
    log.delete("click", 3, 8, "later", datetime(2100, 1, 1))
    return log.load("click").select("task_id", SHARD, "checkpoint")
