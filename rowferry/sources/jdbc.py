"""JDBC tables as sources: full, range-strided and modulo-sharded scans.

Spark's JDBC reader does the work; this module builds its options and predicates.
Projection, ``key > bound`` and ``key <= high`` filters on the returned frame are
pushed into the database by Spark.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from rowferry.operators.resume import ResumePoint

# Rows fetched per round trip when nothing else is said, and config
# entries that belong to other kinds of target.
DEFAULT_FETCH_SIZE = 1_000
OTHER_TARGETS = ("bootstrapServers", "clusterNodes", "disableSslVerification")


def _is(url: str, *kinds: str) -> bool:
    return any(url.lower().startswith(f"jdbc:{kind}:") for kind in kinds)


def quoted(name: str, url: str = "") -> str:
    """Delimited identifier in the database's own style."""
    if _is(url, "mysql", "mariadb"):
        return "`" + name.replace("`", "``") + "`"
    return '"' + name.replace('"', '""') + '"'


def modulo(value: str, n: int, url: str = "") -> str:
    """Remainder with the sign of ``value``."""
    return f"({value} % {n})" if _is(url, "sqlserver") else f"MOD({value}, {n})"


def jdbc_options(config: Mapping[str, Any], table: str, *, fetch_size: int = DEFAULT_FETCH_SIZE) -> dict[str, str]:
    """Reader options from a source config (``url``, ``username``, ``password``, ``driver``...).

    MySQL hands out rows in fetch-size steps only through a cursor; without one its
    driver would load a whole partition into memory.
    """
    known = {"username": "user"}
    out = {known.get(k, k): str(v) for k, v in config.items() if v is not None and k not in OTHER_TARGETS}
    out["dbtable"] = table
    out.setdefault("fetchsize", str(fetch_size))
    if _is(out.get("url", ""), "mysql"):
        out.setdefault("useCursorFetch", "true")
    return out


def bounds_query(table: str, key: str, url: str = "") -> str:
    """Row count, key range and number of rows with a key in one statement."""
    k = quoted(key, url)
    return f"SELECT COUNT(*) AS n_rows, MIN({k}) AS low, MAX({k}) AS high, COUNT({k}) AS n_keys FROM {table}"


def max_key_query(table: str, key: str, shards: int, url: str = "") -> str:
    """Largest key of every shard in one grouped scan."""
    k = quoted(key, url)
    shard = modulo(k, shards, url)
    return f"SELECT {shard} AS shard_id, MAX({k}) AS max_key FROM {table} GROUP BY {shard}"


def bins_query(
    table: str, key: str, low: int, width: int, parent: int = 0, parents: Sequence[int] = (), url: str = ""
) -> str:
    """Rows per bin of the key, a bin being named by its start's distance from ``low``.

    With ``parents`` only keys whose bin of width ``parent`` is among them are counted. Remainders
    instead of divisions, which databases round in different ways; lists in parts of 1,000 entries.
    """
    k = quoted(key, url)
    place = f"({k} - ({low}))"
    start, above = (f"({place} - {modulo(place, w, url)})" for w in (width, parent or width))
    lists = [parents[i : i + 1_000] for i in range(0, len(parents), 1_000)]
    among = " OR ".join(f"{above} IN ({', '.join(map(str, part))})" for part in lists)
    where = f"{k} IS NOT NULL" + (f" AND ({among})" if among else "")
    return f"SELECT {start} AS bin_start, COUNT(*) AS n_rows FROM {table} WHERE {where} GROUP BY {start}"


def column_name(df: DataFrame, name: str) -> str:
    """The column's own spelling; names match without regard to case."""
    return next((c for c in df.columns if c.lower() == name.lower()), name)


def query(spark: SparkSession, options: Mapping[str, str], sql: str) -> DataFrame:
    """Result of a statement that runs in the database."""
    plain = {k: v for k, v in options.items() if k != "dbtable"}
    return spark.read.format("jdbc").options(**plain).option("query", sql).load()


def read_table(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    """Full scan through one connection."""
    return spark.read.format("jdbc").options(**options).load()


def range_options(key: str, low: int, high: int, partitions: int) -> dict[str, str]:
    """Options for one partition per key range. Ranges can use an index on the key,
    and rows without a key or outside [low, high] are still read."""
    return {
        "partitionColumn": key,
        "lowerBound": str(low),
        "upperBound": str(high + 1),
        "numPartitions": str(max(1, min(partitions, high - low + 1))),
    }


def read_ranges(
    spark: SparkSession, options: Mapping[str, str], key: str, low: int, high: int, partitions: int
) -> DataFrame:
    return spark.read.format("jdbc").options(**options, **range_options(key, low, high, partitions)).load()


def range_predicates(key: str, cuts: Sequence[int], url: str = "") -> list[str]:
    """One condition per key range between sorted ``cuts``, for keys that are not
    spread evenly (cuts can be quantiles). Rows without a key go to the first."""
    k = quoted(key, url)
    points = sorted(set(cuts))
    if not points:
        return ["1 = 1"]
    first = f"{k} < {points[0]} OR {k} IS NULL"
    middle = [f"{k} >= {a} AND {k} < {b}" for a, b in zip(points, points[1:], strict=False)]
    return [first, *middle, f"{k} >= {points[-1]}"]


def mod_predicates(
    key: str,
    shards: int,
    *,
    how: str = "pmod",
    point: ResumePoint | None = None,
    high: int | None = None,
    url: str = "",
) -> list[str]:
    """One condition per modulo shard, with the resume bounds of the shard.

    Every condition makes the database test each row, so prefer ranges unless
    shard numbers must line up with older checkpoints.
    """
    k, out = quoted(key, url), []
    remainders = {
        "signed": modulo(k, shards, url),
        "abs": modulo(f"ABS({k})", shards, url),
        "pmod": modulo(f"({modulo(k, shards, url)} + {shards})", shards, url),
    }
    if how not in remainders:
        raise ValueError("how must be 'pmod', 'signed' or 'abs'")
    for shard in range(shards):
        test = f"{remainders[how]} = {shard}"
        bound = point.bounds.get(shard) if point else None
        limits = [f"{k} > {bound}"] if bound is not None else []
        if high is not None:
            limits.append(f"{k} <= {high}")
        condition = " AND ".join([test, *limits])
        if shard == 0 and how == "pmod" and bound is None:
            condition = f"({condition}) OR {k} IS NULL"
        out.append(condition)
    return out


def read_shards(spark: SparkSession, options: Mapping[str, str], predicates: Sequence[str]) -> DataFrame:
    """One partition per predicate."""
    rest = {k: v for k, v in options.items() if k not in ("url", "dbtable")}
    return spark.read.jdbc(options["url"], options["dbtable"], predicates=list(predicates), properties=rest)
