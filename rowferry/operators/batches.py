"""Numbered batches inside shards, in key order.

Row ``r`` of a shard (0-based, key order) is in batch ``r div batch_size``. The
textbook form, ``row_number()`` over one window per shard, sorts a whole shard in
one task. Beyond ``rows_per_group`` rows the table is therefore cut into key
*segments* first:

1. quantiles of the key give the cut points (one pass over the key column);
2. a key that fills whole quantile steps is *hot* and gets a segment of its own;
3. rows per (shard, segment) are counted (key column only, combined map-side)
   and summed up in segment order, which gives the rank a segment starts at;
4. rows are numbered inside their (shard, segment) and shifted by that rank.

Step 4 is one shuffle of the rows, as in the textbook form, but no window group
is larger than a quantile step. Rows of a hot segment share one key, so their
order is free: they are counted, not sorted.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowferry.operators.sharding import SHARD
from rowferry.storage import control_rows

BATCH = "batch_id"

# Rows one window group may hold before the table is cut into segments (both forms give the same
# rows), and the batch numbers one task lists at a time.
ROWS_PER_GROUP = 4_000_000
BATCHES_PER_PIECE = 10_000

_SEGMENT = ["_bucket", "_place"]


def _div(col: Column, size: int) -> Column:
    """Integer division; ``/`` would go through doubles."""
    return F.call_function("div", col, F.lit(size).cast("bigint"))


@dataclass(frozen=True)
class Cuts:
    """Where the key range is cut: sorted points, and keys that stand alone."""

    points: tuple[int, ...]
    hot: tuple[int, ...] = ()
    nulls: bool = False

    def stands_alone(self, key: Column) -> Column:
        """True for rows of hot segments; a plain filter, so the scan can use it."""
        missing = key.isNull() if self.nulls else F.lit(False)
        return missing | key.isin(*self.hot) if self.hot else missing


def key_cuts(df: DataFrame, key: str, rows: int, rows_per_group: int) -> Cuts:
    """Approximate quantiles of the key, one per ``rows_per_group`` rows.

    A key that is two quantiles in a row is hot. A trillion rows give 250,000 cuts, two
    megabytes, so they may go to the driver and to every task.
    """
    steps = max(1, math.ceil(rows / max(1, rows_per_group)))
    k = F.col(f"`{key}`").cast("bigint")
    at = [i / steps for i in range(1, steps)] or [0.5]
    found = df.agg(
        F.percentile_approx(k, at, max(10_000, 4 * steps)).alias("cuts"), F.count_if(k.isNull()).alias("nulls")
    ).first()
    cuts = found["cuts"] or []
    hot = {a for a, b in zip(cuts, cuts[1:], strict=False) if a == b}
    return Cuts(tuple(sorted(set(cuts))), tuple(sorted(hot)), found["nulls"] > 0)


def with_segments(df: DataFrame, key: str, cuts: Cuts) -> DataFrame:
    """Add the segment (``_bucket``, ``_place``) of every row; odd places hold one key.

    Segments follow key order. ``_bucket`` comes from a binary search over the cuts,
    ``_place`` from exact comparisons with the hot keys of the bucket. NULL keys
    come first. Quantiles and search work on doubles, which keep the order of keys;
    beyond 2^53 they tell apart steps of up to 1,024 keys, far less than a group.
    """
    k = F.col(f"`{key}`").cast("bigint")
    if cuts.points:
        points = sorted({float(c) for c in cuts.points})
        search = Bucketizer(
            splits=[-math.inf, *points, math.inf], inputCol="_double", outputCol="_bucket", handleInvalid="keep"
        )
        found = search.transform(df.withColumn("_double", k.cast("double"))).drop("_double")
    else:
        found = df.withColumn("_bucket", F.lit(0.0))
    found = found.withColumn("_bucket", F.when(k.isNull(), F.lit(-1)).otherwise(F.col("_bucket").cast("int")))
    if not cuts.hot:
        return found.withColumn("_place", F.when(k.isNull(), 1).otherwise(0))
    # One row per cut at most, so 16 bytes per group of rows.
    hot = control_rows(df.sparkSession, [{"_hot": h} for h in cuts.hot], "_hot bigint")
    hot_of = (
        with_segments(hot, "_hot", replace(cuts, hot=()))
        .groupBy("_bucket")
        .agg(F.sort_array(F.collect_list("_hot")).alias("_hots"))
    )
    joined = found.join(F.broadcast(hot_of), "_bucket", "left")
    below = F.size(F.filter("_hots", lambda h: h < k))
    place = (
        F.when(k.isNull(), 1)
        .when(F.col("_hots").isNull(), 0)
        .otherwise(2 * below + F.when(F.array_contains("_hots", k), 1).otherwise(0))
    )
    return joined.withColumn("_place", place.cast("int")).drop("_hots")


def segment_starts(segmented: DataFrame, key: str) -> DataFrame:
    """Rows and last key of every (shard, segment) and the rank its first row has.

    The running sum sees one row per segment, a few per cut.
    """
    sizes = segmented.groupBy(SHARD, *_SEGMENT).agg(
        F.count(F.lit(1)).alias("_rows"), F.max(F.col(f"`{key}`")).alias("_last_key")
    )
    before = Window.partitionBy(SHARD).orderBy(*_SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0).cast("bigint")))


def _row_hash(df: DataFrame, columns: list[str]) -> Column:
    """Content of a row as a number, to order rows that share a key the same way
    whenever a task runs again. Map columns cannot be hashed and are left out."""
    hashed = [c for c in columns if "map<" not in df.schema[c].dataType.simpleString()]
    return F.xxhash64(*[F.col(f"`{c}`") for c in hashed]) if hashed else F.lit(0).cast("bigint")


def _order(df: DataFrame, key: str) -> list[Column]:
    """Key order, made total by the other columns."""
    rest = [c for c in df.columns if c not in (key, SHARD, *_SEGMENT)]
    return [F.col(f"`{key}`"), _row_hash(df, rest)] if rest else [F.col(f"`{key}`")]


def _sorted_ranks(segmented: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """Rank in the shard of rows outside hot segments."""
    plain = segmented.where(F.col("_place") % 2 == 0)
    at = starts.where(F.col("_place") % 2 == 0).select(SHARD, *_SEGMENT, "_start")
    order = Window.partitionBy(SHARD, *_SEGMENT).orderBy(*_order(segmented, key))
    return plain.join(at, [SHARD, *_SEGMENT]).withColumn("_rank", F.col("_start") + F.row_number().over(order) - 1)


def _batch_pieces(first: Column, last: Column, df: DataFrame) -> DataFrame:
    """One row per batch number in [first, last], listed in bounded pieces."""
    step = F.lit(BATCHES_PER_PIECE).cast("bigint")
    pieces = df.withColumn("_first", first).withColumn("_last", last)
    pieces = pieces.withColumn("_piece", F.explode(F.sequence("_first", "_last", step)))
    pieces = pieces.repartition(SHARD, "_piece")
    upto = F.least(F.col("_last"), F.col("_piece") + step - 1)
    return pieces.withColumn(BATCH, F.explode(F.sequence("_piece", upto)))


def _overlap(start: Column, rows: Column, batch_size: int) -> Column:
    """Rows of the rank range [start, start + rows) that fall in the row's batch."""
    low = F.col(BATCH) * F.lit(batch_size).cast("bigint")
    return F.least(start + rows, low + F.lit(batch_size)) - F.greatest(start, low)


def _hot_rows(
    hot: DataFrame, starts: DataFrame, columns: list[str], key: str, batch_size: int, group: int
) -> DataFrame:
    """Batches of rows in hot segments, without ever gathering one key in a task.

    Equal rows collapse to one row with a count before any shuffle, distinct rows
    spread over sub-groups by hash, and counts are laid end to end. A count is
    then cut along batch borders and expanded to at most ``batch_size`` copies.
    """
    sizes = starts.where(F.col("_place") % 2 == 1)
    subs = sizes.select(SHARD, *_SEGMENT, "_start", F.ceil(F.col("_rows") / F.lit(group)).alias("_subs"))
    held = [c for c in columns if c != SHARD]
    # Grouping takes -0.0 for 0.0, so the sign of a zero is a key of its own.
    real = [c for c, kind in hot.dtypes if c in held and kind in ("float", "double")]
    signs = [F.col(f"`{c}`").cast("string").eqNullSafe("-0.0").alias(f"_zero{i}") for i, c in enumerate(real)]
    distinct = hot.groupBy(SHARD, *_SEGMENT, *[F.col(f"`{c}`") for c in held], *signs).agg(
        F.count(F.lit(1)).alias("_copies")
    )
    for i, c in enumerate(real):
        distinct = distinct.withColumn(c, F.when(F.col(f"_zero{i}"), F.lit(-0.0).cast(hot.schema[c].dataType)).otherwise(F.col(f"`{c}`")))
    distinct = distinct.withColumn("_tie", _row_hash(distinct, [c for c in held if c != key]))
    # Ranges of the hash, so that sub-groups one after the other are in the order of the hash; two rows
    # per cut and shard at most are broadcast.
    part = F.floor((F.col("_tie").cast("double") / 2.0**64 + 0.5) * F.col("_subs"))
    spread = distinct.join(F.broadcast(subs), [SHARD, *_SEGMENT]).withColumn("_sub", F.least(part, F.col("_subs") - 1))
    sub_rows = spread.groupBy(SHARD, *_SEGMENT, "_sub").agg(F.sum("_copies").alias("_sub_rows"))
    before = Window.partitionBy(SHARD, *_SEGMENT).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    sub_rows = sub_rows.withColumn("_sub_start", F.coalesce(F.sum("_sub_rows").over(before), F.lit(0)))
    inside = (
        Window.partitionBy(SHARD, *_SEGMENT, "_sub").orderBy("_tie").rowsBetween(Window.unboundedPreceding, -1)
    )
    ranked = spread.join(sub_rows, [SHARD, *_SEGMENT, "_sub"]).withColumn(
        "_rank", F.col("_start") + F.col("_sub_start") + F.coalesce(F.sum("_copies").over(inside), F.lit(0))
    )
    end = F.col("_rank") + F.col("_copies") - 1
    cut = _batch_pieces(_div(F.col("_rank"), batch_size), _div(end, batch_size), ranked)
    copies = _overlap(F.col("_rank"), F.col("_copies"), batch_size).cast("int")
    listed = cut.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), copies)))
    return listed.select(*[F.col(f"`{c}`") for c in columns], BATCH)


def _hot_pieces(starts: DataFrame, batch_size: int) -> DataFrame:
    """Rows that hot segments add to every batch: one key each, so size and start say all."""
    hot = starts.where(F.col("_place") % 2 == 1)
    start, rows, key = F.col("_start"), F.col("_rows"), F.col("_last_key")
    cut = _batch_pieces(_div(start, batch_size), _div(start + rows - 1, batch_size), hot)
    return cut.select(SHARD, BATCH, _overlap(start, rows, batch_size).alias("n"), key.alias("lo"), key.alias("hi"))


def _plan_cuts(df: DataFrame, key: str, rows: int | None, rows_per_group: int) -> Cuts | None:
    """None when one window per shard is small enough, else the cut points."""
    total = df.count() if rows is None else rows
    return None if total <= rows_per_group else key_cuts(df, key, total, rows_per_group)


def assign_batches(
    df: DataFrame, key: str, batch_size: int, *, rows_per_group: int = ROWS_PER_GROUP, rows: int | None = None
) -> DataFrame:
    """Add ``batch_id`` to a frame that has ``shard_id``. Pass ``rows`` if already counted."""
    cuts = _plan_cuts(df, key, rows, rows_per_group)
    if cuts is None:
        order = Window.partitionBy(SHARD).orderBy(*_order(df, key))
        number = (F.row_number().over(order) - 1).cast("bigint")
        return df.withColumn("_rank", number).withColumn(BATCH, _div(F.col("_rank"), batch_size)).drop("_rank")
    segmented = with_segments(df, key, cuts)
    starts = segment_starts(with_segments(df.select(SHARD, F.col(f"`{key}`")), key, cuts), key)
    plain = _sorted_ranks(segmented, starts, key).withColumn(BATCH, _div(F.col("_rank"), batch_size))
    columns = [F.col(f"`{c}`") for c in df.columns]
    out = plain.select(*columns, BATCH)
    if not cuts.hot and not cuts.nulls:
        return out
    alone = with_segments(df.where(cuts.stands_alone(F.col(f"`{key}`"))), key, cuts)
    return out.unionByName(_hot_rows(alone, starts, df.columns, key, batch_size, rows_per_group))


def batch_manifest(
    df: DataFrame, key: str, batch_size: int, *, rows_per_group: int = ROWS_PER_GROUP, rows: int | None = None
) -> DataFrame:
    """One row per batch: rows, first and last key. The last key is the checkpoint
    a run may save once the batch is delivered. Reads shard and key only."""
    keyed = df.select(SHARD, F.col(f"`{key}`").alias("_k"))
    cuts = _plan_cuts(keyed, "_k", rows, rows_per_group)
    if cuts is None:
        parts = assign_batches(keyed, "_k", batch_size, rows=0).select(
            SHARD, BATCH, F.lit(1).cast("bigint").alias("n"), F.col("_k").alias("lo"), F.col("_k").alias("hi")
        )
    else:
        segmented = with_segments(keyed, "_k", cuts)
        starts = segment_starts(segmented, "_k")
        plain = _sorted_ranks(segmented, starts, "_k").select(
            SHARD,
            _div(F.col("_rank"), batch_size).alias(BATCH),
            F.lit(1).cast("bigint").alias("n"),
            F.col("_k").alias("lo"),
            F.col("_k").alias("hi"),
        )
        parts = plain.unionByName(_hot_pieces(starts, batch_size)) if cuts.hot or cuts.nulls else plain
    return parts.groupBy(SHARD, BATCH).agg(
        F.sum("n").alias("n_rows"), F.min("lo").alias("first_key"), F.max("hi").alias("checkpoint")
    )
