"""Declarative description of one table sync: fields, types, roles, knobs.

A :class:`SyncSpec` is what a user writes; everything else in the package
turns it into DataFrame expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

# The type names a field list may use.
TYPE_NAMES = {
    "String": T.StringType(),
    "Long": T.LongType(),
    "Integer": T.IntegerType(),
    "Double": T.DoubleType(),
    "BigDecimal": T.DecimalType(38, 18),
    "LocalDate": T.DateType(),
    "LocalDateTime": T.TimestampNTZType(),
    "Date": T.TimestampType(),
    "Boolean": T.BooleanType(),
    "Byte": T.ByteType(),
}

# Further types the converter understands, not allowed in specs.
EXTRA_TYPES = {
    "Float": T.FloatType(),
    "Short": T.ShortType(),
    "BigInteger": T.DecimalType(38, 0),
    "Timestamp": T.TimestampType(),
    "SqlDate": T.DateType(),
}

# The roles a field may play at the target.
ROLES = ("ID", "DATA", "TIMESTAMP", "VERSION", "KEY")

_SIZED_DECIMAL = re.compile(r"BigDecimal\(\s*(\d+)\s*,\s*(\d+)\s*\)")


class SpecError(ValueError):
    """The declared spec cannot be used."""


def base_type(name: str) -> str:
    """``BigDecimal(18,2)`` -> ``BigDecimal``; other names unchanged."""
    return "BigDecimal" if _SIZED_DECIMAL.fullmatch(name or "") else name


def spark_type(name: str, *, extra: bool = False) -> T.DataType:
    """Spark type of a declared type name; an unknown name is an error."""
    sized = _SIZED_DECIMAL.fullmatch(name or "")
    if sized:
        return T.DecimalType(int(sized.group(1)), int(sized.group(2)))
    if name in TYPE_NAMES:
        return TYPE_NAMES[name]
    if extra and name in EXTRA_TYPES:
        return EXTRA_TYPES[name]
    raise SpecError(f"unsupported type: {name}")


# Search-index field types a target type can name.
INDEX_TYPES = (
    "text keyword long integer short byte double float half_float scaled_float date date_nanos boolean binary "
    "integer_range float_range long_range double_range date_range ip_range object nested ip token_count percolator "
    "flattened search_as_you_type rank_feature rank_features wildcard dense_vector"
).split()


def is_index_type(name: str) -> bool:
    """Whether a target type is a field type of a search index: values then keep their declared type."""
    return name in INDEX_TYPES


def normalize_role(role: str | None) -> str:
    """Case-insensitive role; blank means DATA; anything else is an error."""
    if role is None or not role.strip():
        return "DATA"
    upper = role.strip().upper()
    if upper not in ROLES:
        raise SpecError(f"invalid role: {role!r}; valid roles are {', '.join(ROLES)}")
    return upper


@dataclass(frozen=True)
class FieldSpec:
    """One column on its way from source to target."""

    name: str
    type: str = "String"
    source: str = ""
    target: str = ""
    target_type: str = ""
    role: str = ""
    checkpoint: bool = False
    primitive: bool = False

    def __post_init__(self) -> None:
        if not self.name or not self.name.strip():
            raise SpecError("a field needs a name")
        object.__setattr__(self, "source", self.source.strip() if self.source else "")
        object.__setattr__(self, "target", self.target.strip() if self.target else "")
        object.__setattr__(self, "source", self.source or self.name)
        object.__setattr__(self, "target", self.target or self.name)
        object.__setattr__(self, "target_type", self.target_type or self.type)
        object.__setattr__(self, "role", normalize_role(self.role))
        spark_type(self.type)
        if not is_index_type(self.target_type):
            spark_type(self.target_type)

    @property
    def value_type(self) -> str:
        """Type of the mapped value: the target type, or the declared one under an index type."""
        return self.type if is_index_type(self.target_type) else self.target_type


@dataclass(frozen=True)
class SyncOptions:
    """Knobs that change results or sizing. Defaults are fixed values."""

    batch_size: int = 5_000
    max_retries: int = 3
    retry_initial_delay_ms: int = 1_000
    retry_backoff_factor: float = 2.0
    min_shards: int = 1
    max_shards: int = 64
    records_per_shard: int = 1_000_000
    max_failed_batches: int = 1_000
    global_timeout_s: int = 86_400


    @classmethod
    def from_config(cls, config: Mapping[str, Any] | None) -> SyncOptions:
        """From the ``syncConfig`` of a task request; other entries do not apply here."""
        given = {OPTION_NAMES[k]: v for k, v in (config or {}).items() if k in OPTION_NAMES and v is not None}
        return cls(**given)


# Entries of a request's ``syncConfig`` and the options they set.
OPTION_NAMES = {
    "batchSize": "batch_size",
    "maxRetries": "max_retries",
    "retryInitialDelay": "retry_initial_delay_ms",
    "retryBackoffFactor": "retry_backoff_factor",
    "minShards": "min_shards",
    "maxShards": "max_shards",
    "recordsPerShard": "records_per_shard",
    "globalTimeout": "global_timeout_s",
}


@dataclass(frozen=True)
class SyncSpec:
    """Field list plus table names. Exactly one field is the checkpoint."""

    fields: tuple[FieldSpec, ...]
    entity: str = "Entity"
    source_table: str = ""
    target_table: str = ""
    options: SyncOptions = field(default_factory=SyncOptions)

    def __post_init__(self) -> None:
        object.__setattr__(self, "fields", tuple(self.fields))
        marked = [f for f in self.fields if f.checkpoint]
        if len(marked) > 1:
            raise SpecError(f"multiple checkpoint fields in {self.entity}")
        if not marked:
            raise SpecError(f"no checkpoint field in {self.entity}")
        object.__setattr__(self, "source_table", (self.source_table or "").strip() or self.entity)
        object.__setattr__(self, "target_table", (self.target_table or "").strip() or self.entity)

    @property
    def checkpoint(self) -> FieldSpec:
        return next(f for f in self.fields if f.checkpoint)

    @property
    def key_field(self) -> FieldSpec | None:
        """Record-key field. The last KEY wins when several are declared."""
        keys = [f for f in self.fields if f.role == "KEY"]
        return keys[-1] if keys else None

    @property
    def id_field(self) -> FieldSpec | None:
        """Document-id field. The first ID wins when several are declared."""
        return next((f for f in self.fields if f.role == "ID"), None)

    def schema(self) -> T.StructType:
        """Declared read schema, under source column names."""
        return T.StructType([T.StructField(f.source, spark_type(f.type)) for f in self.fields])

    def target_schema(self, *, target_cast: bool = True) -> T.StructType:
        """Schema after mapping; the role travels in the field metadata."""
        return T.StructType(
            [
                T.StructField(
                    f.target,
                    spark_type(f.value_type if target_cast else f.type),
                    metadata={"role": f.role},
                )
                for f in self.fields
            ]
        )

    def with_options(self, **changes: Any) -> SyncSpec:
        return replace(self, options=replace(self.options, **changes))

    @classmethod
    def from_fields(
        cls, rows: Iterable[Mapping[str, Any]], *, any_target_type: bool = False, **kwargs: Any
    ) -> SyncSpec:
        """Build from task-request field mappings (``javaField``, ``sourceField``, ...).

        ``any_target_type`` is for search-index targets: a target type that neither the
        index nor this library knows is left to the index.
        """
        return cls(
            fields=tuple(
                FieldSpec(
                    name=r["javaField"],
                    type=r["sourceType"],
                    target_type=_target_name(r.get("targetType") or "", any_target_type),
                    source=r.get("sourceField") or "",
                    target=r.get("targetField") or "",
                    checkpoint=bool(r.get("checkpoint")),
                    role=r.get("role") or "",
                )
                for r in rows
            ),
            **kwargs,
        )


def _target_name(name: str, any_name: bool) -> str:
    """A requested target type; an index gets its own spelling, and unknown names not at all."""
    if not any_name or name in TYPE_NAMES or _SIZED_DECIMAL.fullmatch(name):
        return name
    return name.lower() if is_index_type(name.lower()) else ""
