"""Where intermediate tables go: the shared folder the cluster names."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Only a local-mode session (one machine, as in tests) may fall back to a
    temporary folder; on a cluster an unset folder is an error, because executors
    would not see the driver's disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="rowferry-")
    return _local_roots[app]


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; nothing is created yet."""
    return f"{shared_root(spark)}/rowferry/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to a durable table and read it back.

    Used where a plan must not run twice (rows already delivered) or must not
    change between readers; a lost executor then costs a re-read, not a re-run.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staged(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """``df`` written once, for as long as the block lasts; the folder goes afterwards."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def control_rows(spark: SparkSession, rows: Sequence[Mapping[str, Any]], schema: str) -> DataFrame:
    """A few driver-made rows as one partition, without a Python worker."""
    text = F.lit(json.dumps([dict(r) for r in rows]))
    listed = spark.range(0, 1, 1, 1).select(F.explode(F.from_json(text, f"array<struct<{schema}>>")).alias("r"))
    return listed.select("r.*")


def no_rows(spark: SparkSession, schema: str) -> DataFrame:
    """An empty table of a schema."""
    return spark.range(0).select(F.from_json(F.lit("{}"), schema).alias("r")).select("r.*")
