"""Runnable examples of every operator, with the SQL that says what they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowferry.spec import FieldSpec, SyncSpec

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL counterpart if there is one."""

    def add(fn: Query) -> Query:
        if fn.__name__ in QUERIES:
            raise ValueError(f"registered twice: {fn.__name__}")
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


EVENTS = SyncSpec(
    entity="events",
    target_table="events_copy",
    fields=(
        FieldSpec("event_id", "Long", checkpoint=True, role="id"),
        FieldSpec("eventTime", "LocalDateTime", source="TS", target="event_time", role="timestamp"),
        FieldSpec("userId", "Long", source="user_id", target="user_id", role="key"),
        FieldSpec("type", "String", source="Event_Type"),
        FieldSpec("amount", "Double", source="value"),
    ),
)

ORDERS = SyncSpec(
    entity="orders",
    target_table="orders_copy",
    fields=(
        FieldSpec("id", "Long", source="o_orderkey", checkpoint=True, role="ID"),
        FieldSpec("total", "Double", source="o_totalprice", target_type="BigDecimal(18,2)"),
        FieldSpec("day", "LocalDateTime", source="o_orderdate", target="order_day", target_type="LocalDate"),
        FieldSpec("status", "String", source="o_orderstatus"),
    ),
)

# Integers and text only: their JSON is the same everywhere.
EVENT_MESSAGES = SyncSpec(
    entity="event_messages",
    fields=(
        FieldSpec("event_id", "Long", checkpoint=True, role="ID"),
        FieldSpec("user", "Long", source="user_id", role="KEY"),
        FieldSpec("type", "String", source="event_type"),
    ),
)
