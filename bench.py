"""Time the headline queries: ``BENCH_SF_DIR`` tables on ``local[BENCH_CPUS]``.

Every query runs to the end through the ``noop`` sink (writers through their own
files); each time is the best of ``BENCH_RUNS`` after one warm-up run. Prints one
JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from rowferry.catalog import QUERIES

HEADLINE = (
    "mapped_events",
    "target_rename_cast",
    "convert_orders",
    "convert_dates",
    "convert_text_numbers",
    "convert_int_wrap",
    "dead_letter_split",
    "shard_pmod",
    "shard_ranges",
    "shard_ordered",
    "shard_max_checkpoint",
    "batch_assign",
    "batch_assign_segments",
    "batch_manifest_events",
    "batch_manifest_hot_key",
    "counters_per_shard",
    "resume_scan",
    "checkpoint_latest",
    "kafka_records",
    "es_bulk_lines",
    "file_sink",
    "fan_out_targets",
    "delivery_retry",
    "latest_record",
    "start_guard",
    "ledger_task_stats",
    "ledger_redacted",
    "stream_incremental",
    "run_task",
    "run_task_sliced",
)

# Rows a full copy run moves, for the rows-per-second figure.
COPY = "run_task"


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rowferry-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="rowferry-bench-"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in names:
        best = None
        for attempt in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if attempt and (best is None or took < best):
                best = took
        seconds[name] = round(best, 3)
    copied = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    out = {
        "metric": "rowferry headline queries, total wall clock",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }
    if COPY in seconds:
        out["rows_per_second"] = {COPY: round(copied / seconds[COPY])}
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
