"""Move large tables between systems with Spark: map, shard, batch, resume, deliver."""

from rowferry.functions.convert import Rules, convert, enum_of, try_convert
from rowferry.operators.batches import assign_batches, batch_manifest
from rowferry.operators.delivery import TargetGone
from rowferry.operators.mapping import map_columns, split_bad_rows
from rowferry.operators.resume import resume_filter, resume_point
from rowferry.operators.sharding import with_shards
from rowferry.plans.run import SyncTask, run, run_batches
from rowferry.sinks.registry import Target, fan_out, register_sender, register_sink
from rowferry.sources.registry import open_source, register_source
from rowferry.spec import FieldSpec, SpecError, SyncOptions, SyncSpec

__all__ = [
    "FieldSpec",
    "Rules",
    "SpecError",
    "SyncOptions",
    "SyncSpec",
    "SyncTask",
    "Target",
    "TargetGone",
    "assign_batches",
    "batch_manifest",
    "convert",
    "enum_of",
    "fan_out",
    "map_columns",
    "open_source",
    "register_sender",
    "register_sink",
    "register_source",
    "resume_filter",
    "resume_point",
    "run",
    "run_batches",
    "split_bad_rows",
    "try_convert",
    "with_shards",
]
