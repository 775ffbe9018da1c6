"""File tables as sources."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rowferry.spec import SyncSpec

TEXT_FORMATS = ("csv", "json")


def read_files(
    spark: SparkSession,
    path: str,
    spec: SyncSpec | None = None,
    *,
    fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Read a file table.

    Columnar formats bring their own types. Text formats are read as text under the
    spec's column names, without inference, so that conversion follows the package
    rules instead of the reader's.
    """
    reader = spark.read.options(**dict(options or {}))
    if fmt in TEXT_FORMATS:
        if spec is None:
            raise ValueError(f"reading {fmt} needs a spec")
        reader = reader.schema(T.StructType([T.StructField(f.source, T.StringType()) for f in spec.fields]))
    return reader.format(fmt).load(path)
