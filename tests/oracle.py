"""Side-by-side comparison of a registered query with its SQL."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "smallint": "SMALLINT",
    "tinyint": "TINYINT",
    "double": "DOUBLE",
    "float": "FLOAT",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between a DataFrame and a statement; empty when nothing does."""
    names = sorted(df.columns)
    found = con.execute(sql)
    types = {d[0]: str(d[1]) for d in found.description}
    if sorted(types) != names:
        return [f"columns {names} vs {sorted(types)}"]
    out = []
    for name, kind in df.dtypes:
        wanted = TYPES.get(kind, kind.upper())
        if types[name].replace(" ", "") != wanted.replace(" ", ""):
            out.append(f"{name}: {kind} vs {types[name]}")
    order = [d[0] for d in found.description]
    theirs = Counter(tuple(row[order.index(n)] for n in names) for row in found.fetchall())
    ours = Counter(tuple(row[n] for n in names) for row in df.collect())
    if ours != theirs:
        more, less = ours - theirs, theirs - ours
        out.append(f"rows {sum(ours.values())} vs {sum(theirs.values())}")
        out.append(f"only Spark: {list(more.items())[:3]}")
        out.append(f"only SQL: {list(less.items())[:3]}")
    return out
