"""Sources by name. A source is any callable ``(spark, spec, config) -> DataFrame``;
Python ``DataSource`` classes are registered with Spark and read by their own name.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from rowferry.operators.ranges import even_cuts, ranges_for
from rowferry.sources import jdbc
from rowferry.sources.files import read_files
from rowferry.spec import SyncSpec

Source = Callable[[SparkSession, SyncSpec, Mapping[str, Any]], DataFrame]

# Database kinds all read through JDBC.
DATABASES = ("jdbc", "mysql", "postgresql", "oracle", "sqlserver")
FILES = ("parquet", "json", "csv", "orc")

_sources: dict[str, Source] = {}


def register_source(name: str, source: Source) -> None:
    _sources[name.strip().lower()] = source


def register_data_source(spark: SparkSession, cls: type) -> None:
    """Make a Python ``DataSource`` class readable as a source under its own name."""
    spark.dataSource.register(cls)
    name = cls.name()
    register_source(name, lambda s, spec, config: s.read.format(name).options(**config).load())


def open_source(spark: SparkSession, kind: str, spec: SyncSpec, config: Mapping[str, Any]) -> DataFrame:
    """The source table of a task."""
    source = _sources.get((kind or "").strip().lower())
    if source is None:
        raise ValueError(f"unsupported source type: {kind}")
    return source(spark, spec, config)


def _database(spark: SparkSession, spec: SyncSpec, config: Mapping[str, Any]) -> DataFrame:
    """Scan in key ranges of about equal row counts, as many as the number of rows asks for.

    The database counts; ranges with too many rows are counted again in smaller steps.
    ``partitions`` asks for so many even strides without counting, ``shards`` for modulo shards.
    """
    config, table = dict(config), spec.source_table
    partitions, shards = int(config.pop("partitions", 0)), int(config.pop("shards", 0))
    options = jdbc.jdbc_options(config, table, fetch_size=spec.options.batch_size)
    whole, url = jdbc.read_table(spark, options), options["url"]
    key = jdbc.column_name(whole, spec.checkpoint.source)
    if shards:
        return jdbc.read_shards(spark, options, jdbc.mod_predicates(key, shards, url=url))
    if partitions == 1:
        return whole
    _, low, high, keys = jdbc.query(spark, options, jdbc.bounds_query(table, key, url)).first()
    if low is None:
        return whole
    low, high, keys = int(low), int(high), int(keys)
    if partitions:
        return jdbc.read_ranges(spark, options, key, low, high, partitions)
    if ranges_for(keys) == 1:
        return whole

    def count(width: int, parent: int, parents: Sequence[int]) -> list[tuple[int, int]]:
        rows = jdbc.query(spark, options, jdbc.bins_query(table, key, low, width, parent, parents, url)).collect()
        return [(int(start), int(n)) for start, n in rows]

    cuts = even_cuts(low, high, keys, ranges_for(keys), count)
    return jdbc.read_shards(spark, options, jdbc.range_predicates(key, cuts, url=url))


def known_counts(
    spark: SparkSession, kind: str, spec: SyncSpec, config: Mapping[str, Any]
) -> tuple[int, int | None, int] | None:
    """(rows, largest key, rows without a key) as the database itself counts them; None for other sources."""
    if _sources.get(kind.strip().lower()) is not _database:
        return None
    table = spec.source_table
    options = jdbc.jdbc_options({k: v for k, v in config.items() if k not in ("partitions", "shards")}, table)
    key = jdbc.column_name(jdbc.read_table(spark, options), spec.checkpoint.source)
    rows, _, high, keys = jdbc.query(spark, options, jdbc.bounds_query(table, key, options["url"])).first()
    return int(rows), None if high is None else int(high), int(rows) - int(keys)


def _files(fmt: str) -> Source:
    def read(spark: SparkSession, spec: SyncSpec, config: Mapping[str, Any]) -> DataFrame:
        options = {k: str(v) for k, v in config.items() if k != "path"}
        return read_files(spark, config["path"], spec, fmt=fmt, options=options)

    return read


for _name in DATABASES:
    register_source(_name, _database)
for _name in FILES:
    register_source(_name, _files(_name))
