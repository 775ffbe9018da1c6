"""Field mapping, roles and typed reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.catalog.registry import EVENTS, ORDERS, query, table, table_path
from rowferry.functions.encode import record_id, record_key
from rowferry.operators.mapping import map_columns
from rowferry.plans.run import source_counts
from rowferry.sources.files import read_files
from rowferry.sources.registry import open_source, register_source
from rowferry.spec import FieldSpec, SyncSpec
from rowferry.storage import control_rows, new_folder


@query("SELECT event_id, ts AS event_time, user_id, event_type AS type, value AS amount FROM events")
def mapped_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns matched regardless of case, renamed; ``props`` is not read."""
    return map_columns(table(spark, sf_dir, "events"), EVENTS)


@query("SELECT vec_id AS id, label FROM embeddings")
def unmapped_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of a type no spec can name is simply not mapped."""
    spec = SyncSpec(
        fields=(FieldSpec("id", "Long", source="vec_id", checkpoint=True), FieldSpec("label", "Integer")),
    )
    return map_columns(table(spark, sf_dir, "embeddings"), spec)


@query(
    "SELECT event_id, CAST(NULL AS VARCHAR) AS channel, CAST(NULL AS DOUBLE) AS score, value FROM events"
)
def mapped_missing_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped columns the source does not have stay NULL when asked for."""
    spec = SyncSpec(
        fields=(
            FieldSpec("event_id", "Long", checkpoint=True),
            FieldSpec("channel", "String"),
            FieldSpec("score", "Double"),
            FieldSpec("value", "Double"),
        ),
    )
    return map_columns(table(spark, sf_dir, "events"), spec, missing="null")


@query("SELECT c_custkey, c_name, c_acctbal AS balance, 'Customer' AS source_table FROM customer")
def blank_name_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank source and target names fall back to the field name, a blank table to the entity."""
    spec = SyncSpec(
        entity="Customer",
        source_table=" ",
        fields=(
            FieldSpec("c_custkey", "Long", source=" ", target="", checkpoint=True),
            FieldSpec("c_name", source="", target=" "),
            FieldSpec("c_acctbal", "Double", target="balance"),
        ),
    )
    mapped = map_columns(table(spark, sf_dir, "customer"), spec)
    return mapped.withColumn("source_table", F.lit(spec.source_table))


@query(
    "SELECT o_orderkey AS id, CAST(o_totalprice AS DECIMAL(18,2)) AS total, "
    "CAST(o_orderdate AS DATE) AS order_day, o_orderstatus AS status FROM orders"
)
def target_rename_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target names and target types applied."""
    return map_columns(table(spark, sf_dir, "orders"), ORDERS)


@query("SELECT o_orderkey AS id, o_totalprice AS total, o_orderdate AS order_day, o_orderstatus AS status FROM orders")
def target_names_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target names applied, declared target types left aside."""
    return map_columns(table(spark, sf_dir, "orders"), ORDERS, target_cast=False)


@query(
    "SELECT d.doc_id, coalesce(CAST(l.doc_id AS VARCHAR), '') AS record_id "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
)
def record_id_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row ids as text; a row without id has the empty text."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_id"))
    joined = docs.join(labels, docs.doc_id == labels.label_id, "left")
    return joined.select("doc_id", record_id(F.col("label_id")).alias("record_id"))


@query("SELECT CAST(event_id AS VARCHAR) AS doc_id, CAST(user_id AS VARCHAR) AS record_key FROM events")
def roles_key_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ID role names documents, the KEY role keys records."""
    mapped = map_columns(table(spark, sf_dir, "events"), EVENTS)
    return mapped.select(
        F.col(EVENTS.id_field.target).cast("string").alias("doc_id"),
        record_key(EVENTS.key_field.target).alias("record_key"),
    )


@query(
    "SELECT o_orderkey AS id, CAST(o_totalprice AS DECIMAL(18,2)) AS total, "
    "CAST(o_orderdate AS DATE) AS order_day, o_orderstatus AS status FROM orders"
)
def typed_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table landed as JSON text is read back through the declared types."""
    path = new_folder(spark, "typed-read")
    table(spark, sf_dir, "orders").write.json(path)
    return map_columns(read_files(spark, path, ORDERS, fmt="json"), ORDERS)


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through CSV files with a header."""
    spec = SyncSpec(
        fields=(
            FieldSpec("id", "Long", source="c_custkey", checkpoint=True),
            FieldSpec("name", source="c_name"),
            FieldSpec("balance", "Double", source="c_acctbal"),
        ),
    )
    path = new_folder(spark, "csv-scan")
    columns = [f.source for f in spec.fields]
    table(spark, sf_dir, "customer").select(*columns).write.option("header", True).csv(path)
    return map_columns(read_files(spark, path, spec, fmt="csv", options={"header": "true"}), spec)


@query("SELECT p_partkey AS id, p_name AS name, p_size AS size FROM part")
def custom_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source registered by name is opened like a built-in one."""
    spec = SyncSpec(
        fields=(
            FieldSpec("id", "Long", source="p_partkey", checkpoint=True),
            FieldSpec("name", source="p_name"),
            FieldSpec("size", "Integer", source="p_size"),
        ),
    )
    register_source("parts", lambda s, _, config: s.read.parquet(config["path"]))
    return map_columns(open_source(spark, "Parts", spec, {"path": table_path(sf_dir, "part")}), spec)


@query(
    "SELECT count(*) AS total_records, max(k) AS high, count(*) - count(k) AS without_key FROM ("
    "SELECT CASE WHEN l_linenumber <> 7 THEN l_orderkey END AS k FROM lineitem)"
)
def source_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row count, largest key and rows without a key of the whole source, as a run counts them."""
    key = F.when(F.col("l_linenumber") != 7, F.col("l_orderkey"))
    counts = source_counts(table(spark, sf_dir, "lineitem").select(key.alias("k")), "k")
    row = {"total_records": counts.total, "high": counts.high, "without_key": counts.nulls}
    return control_rows(spark, [row], "total_records bigint, high bigint, without_key bigint")
