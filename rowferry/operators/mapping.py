"""Source columns to declared fields to target columns, in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.functions.convert import DEFAULT_RULES, Rules, convert, is_bad
from rowferry.spec import FieldSpec, SpecError, SyncSpec, base_type, is_index_type, spark_type

BAD_FIELDS = "_bad_fields"


def _source_columns(df: DataFrame) -> dict[str, T.StructField]:
    """Source columns by lower-cased label: labels match without regard to case."""
    return {f.name.lower(): f for f in df.schema.fields}


def _field_type(f: FieldSpec, src: T.DataType) -> str:
    """A bare BigDecimal keeps the precision the source column already has."""
    if f.type == "BigDecimal" and isinstance(src, T.DecimalType):
        return f"BigDecimal({src.precision},{src.scale})"
    return f.type


def _target_type(f: FieldSpec, read_as: str) -> str:
    if is_index_type(f.target_type):
        return read_as
    if f.target_type == "BigDecimal" and base_type(read_as) == "BigDecimal":
        return read_as
    return f.target_type


def field_column(
    f: FieldSpec,
    columns: dict[str, T.StructField],
    *,
    missing: str = "error",
    mode: str = "strict",
    rules: Rules = DEFAULT_RULES,
    target_cast: bool = True,
) -> Column:
    """The value of one field: source value, read as ``type``, then as ``target_type``."""
    found = columns.get(f.source.lower())
    if found is None:
        if missing == "error":
            raise SpecError(f"column {f.source!r} is not in the source")
        return F.lit(None).cast(spark_type(f.value_type if target_cast else f.type))
    read_as = _field_type(f, found.dataType)
    value = convert(
        F.col(f"`{found.name}`"),
        found.dataType,
        read_as,
        mode=mode,
        rules=rules,
        primitive=f.primitive,
        label=f.name,
    )
    write_as = _target_type(f, read_as)
    if not target_cast or write_as == read_as:
        return value
    return convert(value, spark_type(read_as), write_as, mode=mode, rules=rules, label=f.name)


def map_columns(
    df: DataFrame,
    spec: SyncSpec,
    *,
    keep: tuple[str, ...] = (),
    missing: str = "error",
    mode: str = "strict",
    rules: Rules = DEFAULT_RULES,
    target_cast: bool = True,
) -> DataFrame:
    """Select the mapped fields under their target names, in spec order.

    Unmapped columns are never referenced, so the scan prunes them. ``keep``
    passes helper columns (shard, batch) through unchanged.
    """
    columns = _source_columns(df)
    mapped = [
        field_column(f, columns, missing=missing, mode=mode, rules=rules, target_cast=target_cast).alias(
            f.target, metadata={"role": f.role}
        )
        for f in spec.fields
    ]
    return df.select(*keep, *mapped)


def with_bad_fields(df: DataFrame, spec: SyncSpec, *, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Add the names of the fields whose value cannot be converted, per row."""
    columns = _source_columns(df)
    names = []
    for f in spec.fields:
        found = columns.get(f.source.lower())
        if found is None:
            continue
        col, read_as = F.col(f"`{found.name}`"), _field_type(f, found.dataType)
        bad = is_bad(col, found.dataType, read_as, rules)
        write_as = _target_type(f, read_as)
        if write_as != read_as:
            value = convert(col, found.dataType, read_as, mode="lenient", rules=rules)
            bad = bad | is_bad(value, spark_type(read_as), write_as, rules)
        names.append(F.when(bad, F.lit(f.name)))
    return df.withColumn(BAD_FIELDS, F.array_compact(F.array(*names)) if names else F.array().cast("array<string>"))


def split_bad_rows(
    df: DataFrame, spec: SyncSpec, *, missing: str = "error", rules: Rules = DEFAULT_RULES
) -> tuple[DataFrame, DataFrame]:
    """(rows that map, rows that do not): together they are the whole source.

    A bad row comes with the reason and its mapped source columns as JSON.
    """
    checked = with_bad_fields(df, spec, rules=rules)
    good = map_columns(
        checked.where(F.size(BAD_FIELDS) == 0), spec, missing=missing, mode="lenient", rules=rules
    )
    columns = _source_columns(df)
    present = [columns[f.source.lower()].name for f in spec.fields if f.source.lower() in columns]
    key = columns[spec.checkpoint.source.lower()].name
    bad = checked.where(F.size(BAD_FIELDS) > 0).select(
        F.col(f"`{key}`").cast("string").alias("record_id"),
        F.concat(F.lit("cannot convert: "), F.array_join(BAD_FIELDS, ", ")).alias("reason"),
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in present]), {"ignoreNullFields": "false"}).alias("row_json"),
    )
    return good, bad
