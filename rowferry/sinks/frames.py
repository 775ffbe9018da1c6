"""Rows in the shape a target takes: message records, search documents."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry.functions.encode import json_value, record_key
from rowferry.spec import SyncSpec, is_index_type

# Date formats and analyzer of index fields.
INDEX_DATE_FORMATS = "date_hour_minute_second||date_hour_minute_second_millis"
INDEX_ANALYZER = "ik_max_word"


def kafka_records(mapped: DataFrame, spec: SyncSpec, topic: str | None = None) -> DataFrame:
    """(topic, key, value): value is the mapped row as JSON with NULL fields kept."""
    key = spec.key_field.target if spec.key_field else None
    return mapped.select(
        F.lit(topic or spec.target_table).alias("topic"),
        record_key(key).alias("key"),
        json_value([f.target for f in spec.fields]).alias("value"),
    )


def index_documents(mapped: DataFrame, spec: SyncSpec, index: str | None = None) -> DataFrame:
    """(_index, _id, doc): a NULL ``_id`` leaves the choice to the index."""
    doc_id = F.col(f"`{spec.id_field.target}`").cast("string") if spec.id_field else F.lit(None).cast("string")
    return mapped.select(
        F.lit(index or spec.target_table).alias("_index"),
        doc_id.alias("_id"),
        json_value([f.target for f in spec.fields]).alias("doc"),
    )


def bulk_lines(documents: DataFrame) -> DataFrame:
    """Documents as bulk text: an action line and a document line per row."""
    action: Column = F.to_json(F.struct(F.struct("_index", "_id").alias("index")))
    return documents.select(F.concat(action, F.lit("\n"), F.col("doc")).alias("value"))


def index_mapping(spec: SyncSpec) -> dict:
    """Field types of the target index; an unknown type is left to the index."""
    properties: dict[str, dict] = {}
    for f in spec.fields:
        kind = f.target_type.lower()
        if not is_index_type(kind):
            continue
        properties[f.target] = {"type": kind}
        if kind == "date":
            properties[f.target]["format"] = INDEX_DATE_FORMATS
        elif kind == "text":
            properties[f.target]["analyzer"] = INDEX_ANALYZER
    return {"mappings": {"properties": properties}}


def index_mapping_json(spec: SyncSpec) -> str:
    return json.dumps(index_mapping(spec), sort_keys=True)
