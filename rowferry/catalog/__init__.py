"""Every operator as a runnable query over the given tables."""

from rowferry.catalog import conversions, mapping, reruns, shards, statistics, streams, targets, tasks  # noqa: F401
from rowferry.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
