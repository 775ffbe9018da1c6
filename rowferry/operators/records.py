"""Latest-record views, paging, caps and row validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last record of every key by ``order`` (ascending, so the greatest wins).

    ``max_by`` combines map-side: a key with most of the rows sends one row per
    task, where a window would sort all of them in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(f"`{c}`") for c in order])
    latest = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
        F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), rank).alias("_last")
    )
    kept = [F.col(f"`{c}`") if c in keys else F.col(f"_last.`{c}`").alias(c) for c in df.columns]
    return latest.select(*kept)


def page(df: DataFrame, offset: int, limit: int, *, order: Sequence[str]) -> DataFrame:
    """One page in a defined order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def capped(df: DataFrame, cap: int, *, order: Sequence[str]) -> DataFrame:
    """Report view of at most ``cap`` rows; the table behind it stays whole."""
    return df.orderBy(*order).limit(cap)


def is_blank(col: Column) -> Column:
    """NULL, empty or only blanks."""
    return col.isNull() | (F.trim(col) == F.lit(""))


def is_empty(col: Column) -> Column:
    """NULL or empty text."""
    return col.isNull() | (col == F.lit(""))


def is_empty_map(col: Column) -> Column:
    """NULL or a map without entries."""
    return col.isNull() | (F.size(col) == F.lit(0))


def first_failure(rules: Sequence[tuple[Column, str]]) -> Column:
    """Message of the first rule whose condition holds, else NULL. Order decides."""
    if not rules:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(condition, F.lit(message)) for condition, message in rules])


def validate(df: DataFrame, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    """Add ``error`` (NULL when valid)."""
    return df.withColumn("error", first_failure(rules))


def validate_required(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add ``error`` for required text columns: column -> message, in order."""
    return validate(df, [(is_blank(F.col(f"`{c}`")), message) for c, message in columns.items()])
