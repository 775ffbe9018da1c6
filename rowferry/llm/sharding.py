"""Minimax contiguous partition of documents into shards, with DataFrame functions only.

Groups of equal texts are atomic and ordered by the digest of their text. The smallest
feasible shard capacity is found by search over the prefix sums of the ordered group
sizes, each candidate checked greedily; the order is then cut within that capacity.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowferry.storage import materialize

BUCKET_BITS = 12
PARTS = 256
CANDIDATES = 15


def _bucket(key: str) -> Column:
    """The leading bits of a digest: even ranges of the group order."""
    return F.conv(F.substring(key, 1, BUCKET_BITS // 4), 16, 10).cast("int")


class PrefixSums:
    """Group boundaries of the whole order, looked up many at a time by one Spark job.

    The driver holds one total per bucket (4,096 of them, whatever the input); a lookup
    reads the groups of the buckets that its targets fall into.
    """

    def __init__(self, groups: DataFrame) -> None:
        totals = {r["bucket"]: r["s"] for r in groups.groupBy("bucket").agg(F.sum("bytes").alias("s")).collect()}
        sums = list(accumulate((totals.get(b, 0) for b in range(1 << BUCKET_BITS)), initial=0))
        self.starts, self.total, self.groups = sums[:-1], sums[-1], groups

    def _start(self, bucket: Column) -> Column:
        return F.get(F.lit(self.starts), bucket)

    def ends(self) -> DataFrame:
        """Every group with the byte total up to and with it."""
        order = Window.partitionBy("bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
        return self.groups.withColumn("end", F.sum("bytes").over(order) + self._start(F.col("bucket")))

    def with_ends(self) -> PrefixSums:
        self.groups = materialize(self.ends(), "shard-groups")
        return self

    def floor(self, targets: list[int]) -> list[int]:
        """For each target the largest boundary at or below it (0 is one)."""
        return self._nearest(targets, True)

    def ceil(self, targets: list[int]) -> list[int]:
        """For each target the smallest boundary at or above it."""
        return self._nearest(targets, False)

    def _nearest(self, targets: list[int], below: bool) -> list[int]:
        inside = {t: bisect_right(self.starts, min(max(t, 0), self.total)) - 1 for t in targets}
        buckets = sorted(set(inside.values()))
        aggregates = []
        for i, t in enumerate(targets):
            end = F.col("end")
            aggregates.append((F.max(F.when(end <= t, end)) if below else F.min(F.when(end >= t, end))).alias(f"t{i}"))
        row = self.groups.where(F.col("bucket").isin(buckets)).agg(*aggregates).first()
        out = []
        for i, t in enumerate(targets):
            found, start = row[f"t{i}"], self.starts[inside[t]]
            if below:
                out.append(max(start, found or 0) if t >= 0 else 0)
            else:
                out.append(0 if t <= 0 else start if t == start else self.total if found is None else found)
        return out


def smallest_capacity(sums: PrefixSums, shards: int, largest: int) -> int:
    """The least capacity for which greedy filling needs at most ``shards`` shards.

    A search over ``[max(mean, largest group), mean + largest group]`` with several candidates
    per round, so a round is one job per shard and the rounds are few.
    """
    low = max(-(-sums.total // shards), largest)
    high = max(low, -(-sums.total // shards) + largest)
    while low < high:
        step = max(1, -(-(high - low) // (CANDIDATES + 1)))
        tries = sorted({min(high - 1, low + step * i) for i in range(CANDIDATES)})
        reach = [0] * len(tries)
        for _ in range(shards):
            reach = sums.floor([r + c for r, c in zip(reach, tries, strict=True)])
        good = [r >= sums.total for r in reach]
        if True in good:
            at = good.index(True)
            high = tries[at]
            low = tries[at - 1] + 1 if at else low
        else:
            low = tries[-1] + 1
    return low


def cut_points(sums: PrefixSums, shards: int, capacity: int) -> list[int]:
    """``shards`` ascending boundaries, none more than ``capacity`` apart, as even as that allows.

    ``latest`` (greedy from the front) and ``earliest`` (greedy from the back) bound each cut;
    in between, the boundary next to an even share of what is left is taken.
    """
    earliest = [sums.total]
    for _ in range(shards - 1):
        earliest.append(sums.ceil([earliest[-1] - capacity])[0])
    earliest = earliest[::-1]
    cuts, before = [], 0
    for shard in range(shards - 1):
        share = before + (sums.total - before) // (shards - shard)
        below, latest = sums.floor([share, before + capacity])
        above = sums.ceil([share])[0]
        near = above if above - share < share - below else below
        before = max(min(near, latest), earliest[shard], before)
        cuts.append(before)
    return [*cuts, sums.total]


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Every row with its shard and a gapless slot in it, shards of near equal bytes.

    ``docs`` needs ``doc_id`` and ``text``; other columns aren't read. A text's size is its
    UTF-8 bytes plus one, a null text counts as empty. Rows of equal texts share a shard, null
    and empty texts among them; a group larger than the mean makes a shard of its own size
    and the rest is spread evenly. Inside a group, rows are ordered by a hash of the id, then
    the id, nulls first; repeated rows get neighbouring slots. An empty table gives no rows.

    Rows are counted per (text, part of the ids) with map-side combining, and slots are numbered
    inside such cells, so a text that a third of all rows share is still split over ``PARTS``
    windows and joins. The rows carry ids, digests and sizes, never the text.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id", F.sha2(raw, 256).alias("key"), (F.octet_length(raw).cast("long") + 1).alias("size"),
        F.crc32(raw).alias("text_crc32"), F.xxhash64("doc_id").alias("place"),
    ).withColumn("part", F.pmod("place", F.lit(PARTS)).cast("int"))
    rows = materialize(rows, "shard-rows")
    cells = rows.groupBy("key", "part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    groups = cells.groupBy("key").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    groups = materialize(groups.withColumn("bucket", _bucket("key")), "shard-sums")
    sums = PrefixSums(groups).with_ends()
    largest = groups.agg(F.max("bytes")).first()[0] or 0
    cuts = cut_points(sums, shards, smallest_capacity(sums, shards, largest)) if sums.total else [0] * shards
    shard = F.size(F.filter(F.lit(cuts[:-1]), lambda c: c < F.col("end")))
    placed = sums.groups.select("bucket", "key", "n", shard.cast("int").alias("shard"))
    counts = {(r["shard"], r["bucket"]): r["n"] for r in placed.groupBy("shard", "bucket").agg(F.sum("n").alias("n")).collect()}
    # At most one row per bucket and shard border: 4,096 + shards, whatever the input.
    first, base, bases = None, 0, []
    for (s, b), n in sorted(counts.items()):
        base = 0 if s != first else base
        bases.append((b, s, base))
        first, base = s, base + n
    known = docs.sparkSession.createDataFrame(bases or [(-1, -1, 0)], "bucket int, shard int, base long")
    inside = Window.partitionBy("bucket", "shard").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(known), ["bucket", "shard"])
    starts = starts.select("key", "shard", (F.col("before") + F.col("base")).alias("start"))
    within = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumn("offset", F.coalesce(F.sum("n").over(within), F.lit(0)))
    spots = offsets.join(starts, "key").select("key", "part", "shard", (F.col("start") + F.col("offset")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("key", "part").orderBy("place", "doc_id"))
    return (
        rows.withColumn("rank", rank)
        .join(spots, ["key", "part"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("first") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
