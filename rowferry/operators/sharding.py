"""Cutting a table into shards on an integral key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD = "shard_id"


def shard_of(key: str | Column, shards: int, *, how: str = "pmod") -> Column:
    """Shard number of a key.

    pmod:   every key has a shard; NULL keys go to shard 0 (default)
    signed: remainder with the sign of the key; negative keys with a remainder
            and NULL keys belong to no shard (older behaviour)
    abs:    remainder of the absolute key; NULL keys belong to no shard
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    k = F.col(f"`{key}`") if isinstance(key, str) else key
    k, n = k.cast("bigint"), F.lit(shards).cast("bigint")
    if how == "pmod":
        return F.coalesce(F.pmod(k, n), F.lit(0).cast("bigint"))
    if how == "signed":
        rest = k % n
        return F.when(rest >= 0, rest)
    if how == "abs":
        return F.abs(k % n)
    raise ValueError("how must be 'pmod', 'signed' or 'abs'")


def with_shards(df: DataFrame, key: str, shards: int, *, how: str = "pmod") -> DataFrame:
    """Add ``shard_id``; rows that belong to no shard are not part of any scan."""
    out = df.withColumn(SHARD, shard_of(key, shards, how=how))
    return out if how == "pmod" else out.where(F.col(SHARD).isNotNull())


def one_shard(df: DataFrame, key: str, shards: int, shard: int, *, how: str = "pmod") -> DataFrame:
    """Rows of a single shard."""
    return with_shards(df, key, shards, how=how).where(F.col(SHARD) == F.lit(shard))


def key_order(df: DataFrame, key: str, *, partitions: int | None = None) -> DataFrame:
    """Lay rows out by (shard, key), key-ordered in every partition.

    Range partitioning instead of one hash partition per shard: a shard spans as
    many tasks as its rows need, so a hot shard does not become one task.
    """
    by = [F.col(SHARD), F.col(f"`{key}`")]
    laid = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    return laid.sortWithinPartitions(*by)


def max_key_per_shard(df: DataFrame, key: str, shards: int, *, how: str = "pmod") -> DataFrame:
    """Largest key of every shard as text; an empty shard gives the empty text."""
    found = (
        with_shards(df.select(key), key, shards, how=how)
        .groupBy(SHARD)
        .agg(F.max(key).cast("string").alias("max_key"))
    )
    every = df.sparkSession.range(shards).select(F.col("id").alias(SHARD))
    return every.join(found, SHARD, "left").select(SHARD, F.coalesce("max_key", F.lit("")).alias("max_key"))


def stride_bounds(low: int, high: int, parts: int) -> list[tuple[int | None, int | None]]:
    """Cut [low, high] into key ranges ``lower <= k < upper``; the ends are open."""
    parts = max(1, min(parts, high - low + 1))
    cuts = [low + (high - low + 1) * i // parts for i in range(1, parts)]
    return list(zip([None, *cuts], [*cuts, None], strict=True))


def stride_of(key: str, low: int, high: int, parts: int) -> Column:
    """Range-shard number of a key under :func:`stride_bounds`; NULL keys go to 0.

    Arithmetic instead of one comparison per cut, so it costs the same for any
    number of parts.
    """
    parts = max(1, min(parts, high - low + 1))
    span = high - low + 1
    kind = "decimal(38,0)" if span * parts >= 2**62 else "bigint"
    k = F.greatest(F.least(F.col(f"`{key}`"), F.lit(high)), F.lit(low)).cast(kind)
    place = (k - F.lit(low).cast(kind) + F.lit(1).cast(kind)) * F.lit(parts).cast(kind) - F.lit(1).cast(kind)
    number = F.call_function("div", place, F.lit(span).cast(kind))
    return F.coalesce(F.when(F.col(f"`{key}`").isNotNull(), number), F.lit(0).cast("bigint"))
