"""Resuming a sync: only rows past the last checkpoint of their shard."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.operators.sharding import SHARD, shard_of


@dataclass(frozen=True)
class ResumePoint:
    """Lower key bound per shard; ``None`` means the shard starts at the beginning."""

    shards: int
    bounds: dict[int, int | None]

    @property
    def floor(self) -> int | None:
        """Bound that holds for every shard; what the scan can push down."""
        values = [self.bounds.get(s) for s in range(self.shards)]
        return None if any(v is None for v in values) else min(values)


def parse_checkpoint(text: str | None) -> int | None:
    """Blank text is no bound; anything else must be an integer."""
    return int(text.strip()) if text is not None and text.strip() else None


def _rows(checkpoints: DataFrame | Sequence[Row]) -> Sequence[Row]:
    """One row per shard, read unless that was done already."""
    if isinstance(checkpoints, DataFrame):
        return checkpoints.select(SHARD, "shard_count", "checkpoint").collect()
    return checkpoints


def resume_point(checkpoints: DataFrame | Sequence[Row], shards: int) -> ResumePoint:
    """Read the latest checkpoint per shard (``shard_id``, ``shard_count``, ``checkpoint``).

    When the shard count changed, old bounds describe other residue classes: every
    shard then starts at the smallest old bound, or at the beginning if an old
    shard has none. One row per shard reaches the driver.
    """
    rows = _rows(checkpoints)
    if rows and any(r["shard_count"] != shards for r in rows):
        old = [parse_checkpoint(r["checkpoint"]) for r in rows]
        complete = all(v is not None for v in old) and len(rows) >= max(r["shard_count"] for r in rows)
        start = min(old) if complete else None
        return ResumePoint(shards, {s: start for s in range(shards)})
    return ResumePoint(shards, {int(r[SHARD]): parse_checkpoint(r["checkpoint"]) for r in rows})


def uneven_shards(checkpoints: DataFrame | Sequence[Row]) -> int | None:
    """The stored shard count while the shards' checkpoints differ, as after a failed batch run.

    Only under that count do the bounds say which rows were delivered; one row per shard is read.
    """
    rows = _rows(checkpoints)
    if not rows:
        return None
    count = max(r["shard_count"] for r in rows)
    even = len({r["checkpoint"] for r in rows}) == 1 and len(rows) == count
    return None if even else int(count)


def _own_type(df: DataFrame, key: str) -> Column:
    """The key as it is stored where that compares with a whole number: then bounds reach the scan."""
    kind = df.select(F.col(f"`{key}`")).schema[0].dataType
    whole = isinstance(kind, T.IntegralType) or (isinstance(kind, T.DecimalType) and kind.scale == 0)
    return F.col(f"`{key}`") if whole else F.col(f"`{key}`").cast("bigint")


def _bound(df: DataFrame, key: str, value: int) -> Column:
    """A bound in the key's own type if it fits, so that no cast stands around the column."""
    kind = df.select(F.col(f"`{key}`")).schema[0].dataType
    fits = isinstance(kind, T.DecimalType) and kind.scale == 0 and abs(value) < 10**kind.precision
    return F.lit(value).cast(kind) if fits else F.lit(value)


def resume_filter(
    df: DataFrame, key: str, point: ResumePoint, *, high: int | None = None, how: str = "pmod", nulls: bool = True
) -> DataFrame:
    """Rows with ``bound < key <= high``, the bound being that of the row's shard.

    Rows without a key belong to shard 0 and are read while it has no bound, or never
    with ``nulls=False``. The common floor and ``high`` are plain literals, so they reach
    the scan as pushed filters and skip row groups; the per-shard bound refines what is left.
    """
    k = _own_type(df, key)
    out = df if nulls else df.where(k.isNotNull())
    if high is not None:
        upto = k <= _bound(df, key, high)
        out = out.where(k.isNull() | upto if nulls and point.floor is None else upto)
    if point.floor is not None:
        out = out.where(k > _bound(df, key, point.floor))
    known = {s: b for s, b in point.bounds.items() if b is not None}
    if not known or (point.floor is not None and set(known.values()) == {point.floor}):
        return out
    return out.where(_past_literal(shard_of(key, point.shards, how=how), F.col(f"`{key}`").cast("bigint"), known))


def _past_literal(shard: Column, k: Column, known: dict[int, int]) -> Column:
    """Shards grouped by bound, so a run that ended evenly costs few comparisons."""
    by_bound: dict[int, list[int]] = {}
    for s, b in known.items():
        by_bound.setdefault(b, []).append(s)
    bound = None
    for b, members in sorted(by_bound.items()):
        test = shard.isin(*[F.lit(m).cast("bigint") for m in members])
        bound = F.when(test, F.lit(b)) if bound is None else bound.when(test, F.lit(b))
    return bound.isNull() | (k > bound)
