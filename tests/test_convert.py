"""Conversion rules on literal values."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.functions.convert import Rules, convert, enum_of, is_bad, zero_of

WRAP, PATTERN = Rules(wrap=True), Rules(digits="pattern")
FAIL = object()

S, I, L, D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
DEC, NTZ, TS, DATE, B = T.DecimalType(20, 2), T.TimestampNTZType(), T.TimestampType(), T.DateType(), T.BooleanType()


def utc(ms: int) -> dt.datetime:
    return dt.datetime.fromtimestamp(ms / 1000, dt.UTC).replace(tzinfo=None)


CASES = [
    # value, source type, target, rules, expected
    (" 15 ", S, "Long", None, 15),
    ("+5", S, "Long", None, 5),
    ("\t-7\n", S, "Long", None, -7),
    ("1.5", S, "Long", None, FAIL),
    ("", S, "Long", None, FAIL),
    ("9223372036854775808", S, "Long", None, FAIL),
    (1.9, D, "Long", None, 1),
    (-1.9, D, "Long", None, -1),
    (1e30, D, "Long", None, FAIL),
    (1e30, D, "Long", WRAP, 2**63 - 1),
    (-1e30, D, "Long", WRAP, -(2**63)),
    (float("nan"), D, "Long", WRAP, 0),
    (float("nan"), D, "Long", None, FAIL),
    (Decimal("7.90"), DEC, "Long", None, 7),
    (True, B, "Long", None, FAIL),
    (3000000000, L, "Integer", None, FAIL),
    (3000000000, L, "Integer", WRAP, -1294967296),
    (-3000000000, L, "Integer", WRAP, 1294967296),
    (3.0e10, D, "Integer", None, FAIL),
    (3.0e10, D, "Integer", WRAP, 2147483647),
    (Decimal("4294967297.00"), DEC, "Integer", WRAP, 1),
    (Decimal("-1.99"), DEC, "Integer", WRAP, -1),
    ("2147483648", S, "Integer", None, FAIL),
    (200, I, "Byte", WRAP, -56),
    (-129, I, "Byte", WRAP, 127),
    (200, I, "Byte", None, FAIL),
    (300.7, D, "Byte", WRAP, 44),
    (40000, I, "Short", WRAP, -25536),
    (40000, I, "Short", None, FAIL),
    (0, I, "Boolean", None, False),
    (2, I, "Boolean", None, True),
    (0.5, D, "Boolean", None, False),
    (-1.0, D, "Boolean", None, True),
    (float("nan"), D, "Boolean", None, False),
    (float("inf"), D, "Boolean", None, True),
    (4294967296, L, "Boolean", None, False),
    (Decimal("0.99"), DEC, "Boolean", None, False),
    (" YES ", S, "Boolean", None, True),
    ("on", S, "Boolean", None, True),
    ("1", S, "Boolean", None, True),
    ("t", S, "Boolean", None, False),
    ("", S, "Boolean", None, False),
    (7, I, "Double", None, 7.0),
    (" 1.5e3 ", S, "Double", None, 1500.0),
    ("NaN?", S, "Double", None, FAIL),
    ("inf", S, "Double", None, FAIL),
    ("Infinity", S, "Double", None, float("inf")),
    (0.1, D, "Float", None, pytest.approx(0.1, rel=1e-6)),
    (1.1, D, "BigDecimal", None, Decimal("1.1")),
    (" 1.10 ", S, "BigDecimal", None, Decimal("1.10")),
    ("12.345", S, "BigDecimal(10,2)", None, Decimal("12.35")),
    ("abc", S, "BigDecimal", None, FAIL),
    (12345, I, "BigDecimal(4,2)", None, FAIL),
    (Decimal("7.90"), DEC, "BigInteger", None, Decimal(7)),
    (Decimal("-7.90"), DEC, "BigInteger", None, Decimal(-7)),
    ("7.9", S, "BigInteger", None, FAIL),
    ("123456789012345678901234567890", S, "BigInteger", None, Decimal("123456789012345678901234567890")),
    (1e30, D, "BigInteger", None, Decimal(2**63 - 1)),
    (12, I, "String", None, "12"),
    (True, B, "String", None, "true"),
    ("20240101", S, "Date", None, utc(20240101)),
    ("20240101", S, "Date", PATTERN, dt.datetime(2024, 1, 1)),
    ("20240101020304", S, "Date", PATTERN, dt.datetime(2024, 1, 1, 2, 3, 4)),
    (1704067200000, L, "Date", None, dt.datetime(2024, 1, 1)),
    (-1, L, "Date", None, utc(-1)),
    (5, I, "Date", None, FAIL),
    (dt.datetime(2024, 1, 1), NTZ, "Date", None, FAIL),
    (dt.date(2024, 1, 2), DATE, "Date", None, dt.datetime(2024, 1, 2)),
    (dt.datetime(2024, 1, 1, 0, 0, 0, 123456), TS, "Date", None, dt.datetime(2024, 1, 1, 0, 0, 0, 123000)),
    ("2024/01/02", S, "Date", None, dt.datetime(2024, 1, 2)),
    ("2024-1-2", S, "Date", None, dt.datetime(2024, 1, 2)),
    ("2024-01-02 03:04:05 tail", S, "Date", None, dt.datetime(2024, 1, 2, 3, 4, 5)),
    ("2024-01-02  03:04:05", S, "Date", None, dt.datetime(2024, 1, 2, 3, 4, 5)),
    ("2024/1/2 3:4:5", S, "Date", None, dt.datetime(2024, 1, 2, 3, 4, 5)),
    ("2024-01-02 tail", S, "Date", None, dt.datetime(2024, 1, 2)),
    ("2024-13-45", S, "Date", None, FAIL),
    ("soon", S, "Date", None, FAIL),
    ("2024-01-02T03:04", S, "LocalDateTime", None, dt.datetime(2024, 1, 2, 3, 4)),
    ("2024-01-02T03:04:05.678", S, "LocalDateTime", None, dt.datetime(2024, 1, 2, 3, 4, 5, 678000)),
    ("2024-01-02T03:04:05+09:00", S, "LocalDateTime", None, dt.datetime(2024, 1, 2, 3, 4, 5)),
    ("2024-01-02 03:04:05", S, "LocalDateTime", None, dt.datetime(2024, 1, 2, 3, 4, 5)),
    ("2024-01-02", S, "LocalDateTime", None, FAIL),
    ("1704067200000", S, "LocalDateTime", None, dt.datetime(2024, 1, 1)),
    (1704067200000, L, "LocalDateTime", None, dt.datetime(2024, 1, 1)),
    (5, I, "LocalDateTime", None, FAIL),
    (dt.date(2024, 1, 2), DATE, "LocalDateTime", None, dt.datetime(2024, 1, 2)),
    ("2024-01-02 10:00:00", S, "LocalDate", None, dt.date(2024, 1, 2)),
    ("2024-01-02", S, "LocalDate", None, dt.date(2024, 1, 2)),
    ("2024-01-02+01:00", S, "LocalDate", None, dt.date(2024, 1, 2)),
    ("2024/01/02", S, "LocalDate", None, FAIL),
    (dt.datetime(2024, 1, 2, 23), NTZ, "LocalDate", None, dt.date(2024, 1, 2)),
    (1704067200000, L, "LocalDate", None, dt.date(2024, 1, 1)),
    ("1704067200000", S, "LocalDate", None, dt.date(2024, 1, 1)),
    ("2024-01-02", S, "Timestamp", None, dt.datetime(2024, 1, 2)),
    ("2024-01-02 10:00:00", S, "SqlDate", None, dt.date(2024, 1, 2)),
]


def test_values(spark):
    """All cases in one frame, lenient, so a failing one shows as NULL."""
    schema = T.StructType([T.StructField(f"c{i}", c[1]) for i, c in enumerate(CASES)])
    df = spark.createDataFrame([tuple(c[0] for c in CASES)], schema)
    got = df.select(
        *[
            convert(F.col(f"c{i}"), c[1], c[2], mode="lenient", rules=c[3] or Rules()).alias(f"v{i}")
            for i, c in enumerate(CASES)
        ],
        *[is_bad(F.col(f"c{i}"), c[1], c[2], c[3] or Rules()).alias(f"b{i}") for i, c in enumerate(CASES)],
    ).first()
    problems = []
    for i, case in enumerate(CASES):
        value = got[f"v{i}"]
        if isinstance(value, dt.datetime) and value.tzinfo is not None:
            value = value.astimezone(dt.UTC).replace(tzinfo=None)
        wanted = None if case[4] is FAIL else case[4]
        if value != wanted or got[f"b{i}"] != (case[4] is FAIL):
            problems.append((case[0], case[2], value, wanted))
    assert problems == []


@pytest.mark.parametrize(("value", "src", "to"), [("1.5", S, "Long"), (3000000000, L, "Integer"), (5, I, "Date")])
def test_strict_fails_the_job(spark, value, src, to):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("c", src)]))
    with pytest.raises(PySparkException, match="cannot convert"):
        df.select(convert(F.col("c"), src, to)).collect()


def test_strict_keeps_nulls(spark):
    df = spark.createDataFrame([(None,)], "c string")
    row = df.select(*[convert(F.col("c"), S, t).alias(t) for t in ("Long", "Date", "Double", "LocalDate")]).first()
    assert list(row) == [None] * 4


def test_primitive_nulls(spark):
    df = spark.createDataFrame([(None, None)], "i int, s string")
    row = df.select(
        convert(F.col("i"), I, "Integer", primitive=True).alias("i"),
        convert(F.col("s"), S, "Boolean", primitive=True).alias("b"),
        convert(F.col("s"), S, "Double", primitive=True).alias("d"),
        zero_of("LocalDate").alias("n"),
    ).first()
    assert list(row) == [0, False, 0.0, None]


def test_enum(spark):
    df = spark.createDataFrame([("A",), (None,), ("a",)], "c string")
    out = [r[0] for r in df.select(enum_of(F.col("c"), ["A", "B"], mode="lenient")).collect()]
    assert out == ["A", None, None]
    with pytest.raises(PySparkException, match="no such value"):
        df.select(enum_of(F.col("c"), ["A", "B"])).collect()


def test_independent_of_ansi_flag(spark):
    df = spark.createDataFrame([("x", 3000000000)], "s string, n bigint")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        row = df.select(
            convert(F.col("s"), S, "Long", mode="lenient").alias("s"),
            convert(F.col("n"), L, "Integer", mode="lenient").alias("n"),
        ).first()
        assert list(row) == [None, None]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def wrapped(n: int, bits: int) -> int:
    n &= (1 << bits) - 1
    return n - (1 << bits) if n >> (bits - 1) else n


def clamped(d: float, bits: int) -> int:
    if d != d:
        return 0
    top = (1 << (bits - 1)) - 1
    return max(-top - 1, min(top, int(d))) if abs(d) != float("inf") else (top if d > 0 else -top - 1)


def test_narrowing_against_plain_integers(spark):
    rng = random.Random(5)
    edges = [s * (2**b + d) for b in (7, 8, 15, 16, 31, 32, 62) for d in (-1, 0, 1) for s in (1, -1)]
    longs = edges + [rng.randrange(-(2**63), 2**63) for _ in range(300)]
    doubles = [float(n) * f for n in edges for f in (1, 0.3, 1e4)] + [float("nan"), float("inf"), float("-inf"), -0.0, 0.99]
    exact = [Decimal(n) + Decimal("0.75") * (1 if n >= 0 else -1) for n in longs]
    targets = {"Byte": 8, "Short": 16, "Integer": 32, "Long": 64}
    for values, src in [(longs, L), (doubles, D), (exact, T.DecimalType(22, 2))]:
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], T.StructType([T.StructField("i", I), T.StructField("v", src)]))
        rows = df.select("i", *[convert(F.col("v"), src, t, rules=WRAP).alias(t) for t in targets]).collect()
        for r in rows:
            v = values[r["i"]]
            for t, bits in targets.items():
                if isinstance(v, float):
                    want = clamped(v, 64) if bits == 64 else wrapped(clamped(v, 32), bits)
                else:
                    want = wrapped(int(v), bits)
                assert r[t] == want, (v, t)


def test_strict_and_lenient_agree_on_good_values(spark):
    texts = ["1", " 2 ", "3.5", "x", "2024-01-02", "2024-01-02 03:04:05", "2024-01-02T03:04:05", "true", "", "1e3"]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    for to in ("Long", "Integer", "Double", "BigDecimal", "Date", "LocalDate", "LocalDateTime", "Boolean", "Byte"):
        kept = df.where(~is_bad(F.col("c"), S, to))
        strict = kept.select(convert(F.col("c"), S, to)).collect()
        lenient = kept.select(convert(F.col("c"), S, to, mode="lenient")).collect()
        assert [r[0] for r in strict] == [r[0] for r in lenient]
        assert all(r[0] is not None for r in strict)
