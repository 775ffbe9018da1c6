"""Incremental sync of file tables with Structured Streaming.

Each run takes the files that arrived since the last one, writes them and stops. The
stream's own checkpoint is the resume point. An attempt at a micro-batch writes its rows
to a partition of its own, ``stream_id``/``batch_id``/``attempt``; then one small file
beside the target, in ``<target>_files``, commits it: it lists the files whose rows the
attempt holds. Readers take committed attempts alone, so rows and record become visible
together. A stream that dies between the two, with or without its checkpoint, leaves rows
that nobody reads and delivers the files again. A batch that is committed is not written
again, and files that another batch committed are passed over, so a stream that starts
over under a new checkpoint repeats nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from rowferry.storage import no_rows

FILE = "_file"
OWN = ["stream_id", "batch_id", "attempt"]
FILES = f"{FILE} string, stream_id string, batch_id bigint, attempt string"


def _pattern(path: str) -> str:
    """``path`` as a glob that matches it alone.

    The file stream wants a folder or a glob; as a glob, a table stored as a
    single file and one stored as a folder of files both work.
    """
    head, last = path.rstrip("/")[:-1], path.rstrip("/")[-1]
    return f"{head}[{last}]"


def _recorded_files(spark: SparkSession, target: str) -> DataFrame:
    try:
        return spark.read.schema(FILES).parquet(files_path(target))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return no_rows(spark, FILES)


def files_path(target: str) -> str:
    """Where the delivered files of a target are recorded."""
    return f"{target.rstrip('/')}_files"


def write_batch(
    path: str,
    stream_id: Callable[[], str],
    transform: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    before_commit: Callable[[int], None] = lambda batch_id: None,
) -> Callable[[DataFrame, int], None]:
    """Sink for ``foreachBatch``: the batch's files, less those another batch delivered.

    Rows carry their file in ``_file``. Usually no file was seen before and the rows are
    written as they come, without a join. Otherwise the names of the batch's delivered files go
    to the rows: dealt by file, all rows of a large file would meet in one task. The driver lists
    these names for the batch anyway. ``before_commit`` is called between rows and record.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, own = batch.sparkSession, stream_id()
        record = _recorded_files(spark, path)
        mine = (F.col("stream_id") == own) & (F.col("batch_id") == F.lit(batch_id))
        if not record.where(mine).isEmpty():
            return
        files = batch.select(FILE).distinct()
        known = files.join(record.select(FILE), FILE, "left_semi")
        rows = batch if known.isEmpty() else batch.join(F.broadcast(known), FILE, "left_anti")
        # The letter keeps the id text when the folder's name is read.
        attempt = f"a{uuid.uuid4().hex}"
        place = {"stream_id": F.lit(own), "batch_id": F.lit(batch_id).cast("bigint"), "attempt": F.lit(attempt)}
        transform(rows.drop(FILE)).withColumns(place).write.mode("append").partitionBy(*OWN).parquet(path)
        before_commit(batch_id)
        # One file, so that the record is there as a whole or not at all; one row per new file.
        new = files.join(record.select(FILE), FILE, "left_anti").withColumns(place)
        new.coalesce(1).write.mode("append").parquet(files_path(path))

    return write


def sync_new_files(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    transform: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    *,
    fmt: str = "parquet",
    max_files: int | None = None,
    timeout_seconds: int | None = None,
    before_commit: Callable[[int], None] = lambda batch_id: None,
) -> None:
    """Deliver the files of ``source`` that neither ``checkpoint`` nor the target has seen, then stop.

    ``transform`` works on the rows of one micro-batch; ``before_commit`` hears of each
    batch whose rows are written and not yet visible.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.load(_pattern(source)).withColumn(FILE, F.col("_metadata.file_path"))
    name = f"sync-{uuid.uuid4().hex}"

    def stream_id() -> str:
        """The id Spark keeps in the checkpoint: a new checkpoint is a new stream."""
        return next(str(q.id) for q in spark.streams.active if q.name == name)

    query = (
        rows.writeStream.queryName(name)
        .foreachBatch(write_batch(target, stream_id, transform, before_commit))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination(timeout_seconds)
        if query.isActive:
            raise TimeoutError(f"stream did not finish within {timeout_seconds} s")
    finally:
        query.stop()


def read_target(spark: SparkSession, path: str) -> DataFrame:
    """Rows of committed micro-batches, without the columns that name them; an unfinished target may be empty.

    The record names partitions, so what no batch committed is not even opened where Spark prunes by the join.
    The names of the attempts go to the rows, one per micro-batch: dealt by attempt, a batch's rows would meet in one task.
    """
    committed = _recorded_files(spark, path).select(*OWN).distinct()
    rows = spark.read.parquet(path).withColumn("batch_id", F.col("batch_id").cast("bigint"))
    return rows.join(F.broadcast(committed), OWN, "left_semi").drop(*OWN)
