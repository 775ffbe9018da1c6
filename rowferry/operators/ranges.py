"""Key ranges of about equal row counts, however unevenly the keys lie.

Rows are counted per bin of the key; only bins that hold too much are cut into smaller bins and
counted again. What reaches the driver is bounded by the number of ranges, not by rows or keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowferry.storage import control_rows

ROWS_PER_RANGE = 1_000_000
MOST_RANGES = 4_096
FIRST_BITS = 12  # at most 4,096 bins in the first count
NEXT_BITS = 4  # a heavy bin is cut into 16
PIECES = 4  # a bin with more than a quarter of a range's rows is heavy

# (bin width, width of the parent bins, starts of the parent bins to look into; none: all) -> (start, rows) of bins.
# Starts are distances from the smallest key.
Counter = Callable[[int, int, Sequence[int]], Iterable[tuple[int, int]]]


def ranges_for(rows: int, rows_per_range: int = ROWS_PER_RANGE) -> int:
    """Number of ranges for a table of ``rows`` rows."""
    return max(1, min(MOST_RANGES, -(-rows // rows_per_range)))


def even_cuts(low: int, high: int, rows: int, ranges: int, count: Counter) -> list[int]:
    """First keys of all ranges but the first, in order; ``rows`` is the number of rows with a key.

    A range holds at most ``rows / ranges`` rows (rounded up), or a single key that has more.
    There are at most ``2 * ranges + 1`` of them. A count looks only into bins that were heavy,
    of which there are fewer than ``PIECES * ranges``.
    """
    most = max(1, -(-rows // ranges))
    width, parent, heavy = 1 << max(0, (high - low).bit_length() - FIRST_BITS), 0, []
    pieces: dict[int, int] = {}
    while True:
        counted = dict(count(width, parent, heavy))
        heavy = sorted(start for start, n in counted.items() if width > 1 and n * PIECES > most)
        pieces.update((start, n) for start, n in counted.items() if width == 1 or n * PIECES <= most)
        if not heavy:
            break
        parent, width = width, max(1, width >> NEXT_BITS)
    cuts, held = [], 0
    for start, n in sorted(pieces.items()):
        if held and held + n > most:
            cuts.append(low + start)
            held = 0
        held += n
    return cuts


def bins_of(df: DataFrame, key: str, low: int, high: int) -> Counter:
    """Counts of a DataFrame's keys between ``low`` and ``high``, from the key column only."""
    kind = "bigint" if high - low < 2**63 else "decimal(20,0)"
    k = F.col(f"`{key}`")
    place = df.where(k.between(low, high)).select((k.cast(kind) - F.lit(low).cast(kind)).alias("place"))

    def start(width: int):
        return (F.col("place") - F.col("place") % F.lit(width).cast(kind)).cast(kind)

    def count(width: int, parent: int, parents: Sequence[int]) -> Iterable[tuple[int, int]]:
        rows = place
        if parents:
            heavy = control_rows(df.sparkSession, [{"parent": p} for p in parents], f"parent {kind}")
            rows = rows.withColumn("parent", start(parent)).join(F.broadcast(heavy), "parent", "left_semi")
        found = rows.groupBy(start(width).alias("start")).agg(F.count(F.lit(1)).alias("n"))
        return [(int(r["start"]), r["n"]) for r in found.collect()]

    return count
