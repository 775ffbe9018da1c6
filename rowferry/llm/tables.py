"""Small helpers shared by the operators: column reads, splits, Arrow rows."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from typing import Any, TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
BATCH_ROWS = 1_000
BATCH_BYTES = 8 << 20
FOLDS = 4
HELD_OUT_FOLD = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after bounding what Spark hands to Python workers at a time.

    Whole texts are long: the session's default of 10,000 rows a batch is held several times, in
    Spark and in every worker. These are settings of the session; a smaller value of the user's stays.
    """
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = conf.get(name).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(name, str(most))
    return df


def held_out(doc_id: str = "doc_id") -> Column:
    """True where the CRC-32 of the id's text leaves the held-out remainder; a null id is not held out."""
    crc = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(FOLDS)) == HELD_OUT_FOLD, F.lit(False))


def release() -> None:
    """Hands memory that this process no longer uses back to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable) -> Callable:
    """A function for ``mapInArrow`` that gives its memory back when its task ends, as workers live on."""

    def tidied(batches):
        yield from run(batches)
        release()

    return tidied


_held: dict[Hashable, Any] = {}


def worker_model(key: Hashable, build: Callable[[], T]) -> T:
    """``build()``, kept in this worker process until another model is asked for.

    Workers outlive queries; one slot for all operators keeps their memory from adding up.
    """
    if key not in _held:
        _held.clear()
        release()
        _held[key] = build()
    return _held[key]


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple[Any, ...]]:
    """Python tuples of some columns of a batch."""
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def sub_batches(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ``rows`` rows, so Python objects stay few."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)
