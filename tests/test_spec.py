from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry import FieldSpec, SpecError, SyncSpec, map_columns, split_bad_rows
from rowferry.spec import normalize_role, spark_type

ID = FieldSpec("id", "Long", checkpoint=True)

# The three table shapes known from run ledgers: field, type, role, source, target.
USER_DATA = SyncSpec(
    entity="user_data",
    fields=(
        FieldSpec("id", "Long", checkpoint=True, role="id"),
        *[FieldSpec(n, "String") for n in ("username", "email", "phone", "city")],
        *[FieldSpec(n, "Integer") for n in ("gender", "age")],
        *[FieldSpec(n, "LocalDateTime", role="timestamp") for n in ("registration_date", "create_time")],
        FieldSpec("balance", "BigDecimal"),
    ),
)


@pytest.mark.parametrize("name", ["Map", "string", "", "Float", "Object"])
def test_unknown_type(name):
    with pytest.raises(SpecError, match="unsupported type"):
        spark_type(name)


def test_ten_types():
    names = "String Long Integer Double BigDecimal LocalDate LocalDateTime Date Boolean Byte".split()
    assert [spark_type(n) for n in names] == [
        T.StringType(),
        T.LongType(),
        T.IntegerType(),
        T.DoubleType(),
        T.DecimalType(38, 18),
        T.DateType(),
        T.TimestampNTZType(),
        T.TimestampType(),
        T.BooleanType(),
        T.ByteType(),
    ]
    assert spark_type("BigDecimal(18, 2)") == T.DecimalType(18, 2)


def test_exactly_one_checkpoint():
    with pytest.raises(SpecError, match="no checkpoint"):
        SyncSpec(fields=(FieldSpec("a"),))
    with pytest.raises(SpecError, match="multiple checkpoint"):
        SyncSpec(fields=(ID, FieldSpec("b", "Long", checkpoint=True)))


def test_roles():
    assert [normalize_role(r) for r in (None, "", "  ", "id", " Key ", "VERSION")] == [
        "DATA",
        "DATA",
        "DATA",
        "ID",
        "KEY",
        "VERSION",
    ]
    with pytest.raises(SpecError, match="invalid role"):
        normalize_role("primary")
    spec = SyncSpec(fields=(ID, FieldSpec("a", role="key"), FieldSpec("b", role="KEY"), FieldSpec("c", role="id")))
    assert spec.key_field.name == "b"
    assert spec.id_field.name == "c"
    assert [f.metadata["role"] for f in spec.target_schema()] == ["DATA", "KEY", "KEY", "ID"]


def test_from_request_fields():
    spec = SyncSpec.from_fields(
        [
            {"javaField": "id", "sourceType": "Long", "checkpoint": True, "role": "id"},
            {"javaField": "desc", "sourceType": "String", "targetField": "email", "targetType": "String"},
        ],
        entity="log",
        target_table="users",
    )
    assert [(f.source, f.target, f.type) for f in spec.fields] == [("id", "id", "Long"), ("desc", "email", "String")]
    assert (spec.source_table, spec.target_table) == ("log", "users")


def test_identity_mapping_keeps_types(spark):
    df = spark.range(3).select(
        "id",
        *[F.lit("x").alias(c) for c in ("username", "email", "phone", "city")],
        *[F.lit(1).alias(c) for c in ("gender", "age")],
        *[F.lit("2024-01-02T03:04:05").cast("timestamp_ntz").alias(c) for c in ("registration_date", "create_time")],
        F.lit("1.25").cast("decimal(12,2)").alias("BALANCE"),
    )
    out = map_columns(df, USER_DATA)
    assert out.schema["balance"].dataType == T.DecimalType(12, 2)
    assert out.columns == [f.target for f in USER_DATA.fields]
    assert out.schema["id"].metadata == {"role": "ID"}


def test_keyword_columns_and_renames(spark):
    spec = SyncSpec(
        fields=(
            FieldSpec("id", "Integer", checkpoint=True),
            FieldSpec("desc", target="order by"),
            FieldSpec("time", "Integer", target="group"),
        ),
    )
    df = spark.createDataFrame([(1, "a", 2)], "ID bigint, Desc string, `time` int")
    out = map_columns(df, spec)
    assert out.dtypes == [("id", "int"), ("order by", "string"), ("group", "int")]
    assert [tuple(r) for r in out.collect()] == [(1, "a", 2)]


def test_missing_column(spark):
    spec = SyncSpec(fields=(ID, FieldSpec("gone", "Double")))
    df = spark.range(1)
    with pytest.raises(SpecError, match="gone"):
        map_columns(df, spec)
    assert map_columns(df, spec, missing="null").collect() == [(0, None)]


def test_scan_reads_mapped_columns_only(spark, sf_dir):
    spec = SyncSpec(fields=(FieldSpec("event_id", "Long", checkpoint=True), FieldSpec("value", "Double")))
    df = map_columns(spark.read.parquet(f"{sf_dir}/events.parquet"), spec)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,value:double>" in plan


def test_bad_rows_complete(spark):
    spec = SyncSpec(
        fields=(ID, FieldSpec("n", "Integer", source="text"), FieldSpec("d", "LocalDate", source="day")),
    )
    df = spark.createDataFrame(
        [(1, "5", "2024-01-02"), (2, "x", "2024-01-02"), (3, "y", "no"), (4, None, None)],
        "id bigint, text string, day string",
    )
    good, bad = split_bad_rows(df, spec)
    assert sorted(r["id"] for r in good.collect()) == [1, 4]
    reasons = {r["record_id"]: (r["reason"], r["row_json"]) for r in bad.collect()}
    assert reasons == {
        "2": ("cannot convert: n", '{"id":2,"text":"x","day":"2024-01-02"}'),
        "3": ("cannot convert: n, d", '{"id":3,"text":"y","day":"no"}'),
    }
