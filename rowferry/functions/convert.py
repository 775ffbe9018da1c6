"""Value conversion as native Column expressions.

``try_convert`` gives NULL for a value that has no counterpart in the target
type. ``convert`` adds the policy: *strict* fails the job on such a value,
*lenient* keeps the NULL so the caller can route the row to a dead-letter
table. Nothing here depends on ``spark.sql.ansi.enabled``: every narrowing
cast is an explicit ``try_cast``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.functions import dates
from rowferry.spec import base_type, spark_type

# Text that reads as true, after trimming and lower-casing.
TRUE_TEXT = ("1", "true", "yes", "on")

# Bits of the wrapping integer types.
_BITS = {"Byte": 8, "Short": 16, "Integer": 32, "Long": 64}

_INT_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOAT_TYPES = (T.FloatType, T.DoubleType)
_NUMERIC = (*_INT_TYPES, *_FLOAT_TYPES, T.DecimalType)
_WIDTH = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


@dataclass(frozen=True)
class Rules:
    """How to read doubtful values.

    wrap:   out-of-range numbers keep their low bits / saturate instead of failing
    digits: digit-only text is ``epoch_ms`` or follows the compact date ``pattern``
    """

    wrap: bool = False
    digits: str = "epoch_ms"

    def __post_init__(self) -> None:
        if self.digits not in ("epoch_ms", "pattern"):
            raise ValueError("digits must be 'epoch_ms' or 'pattern'")


DEFAULT_RULES = Rules()


def _null(to: T.DataType) -> Column:
    return F.lit(None).cast(to)


def _low_bits(col: Column, bits: int) -> Column:
    """Two's-complement low bits of a bigint column."""
    mask, sign = (1 << bits) - 1, 1 << (bits - 1)
    return col.bitwiseAND(F.lit(mask).cast("bigint")).bitwiseXOR(F.lit(sign).cast("bigint")) - F.lit(
        sign
    ).cast("bigint")


def _decimal_low_bits(col: Column, bits: int) -> Column:
    """Two's-complement low bits of the integer part of a decimal column."""
    span = F.lit(str(1 << bits)).cast("decimal(38,0)")
    half = F.lit(str(1 << (bits - 1))).cast("decimal(38,0)")
    rest = F.pmod(truncate(col), span)
    return F.when(rest >= half, rest - span).otherwise(rest).cast("decimal(38,0)")


def truncate(col: Column) -> Column:
    """Integer part of a decimal, toward zero (a plain cast would round)."""
    return (col - col % F.lit(1)).cast("decimal(38,0)")


def _saturated(col: Column, bits: int) -> Column:
    """Float to a 32- or 64-bit integer: NaN is 0, out-of-range values clamp."""
    top, to = (1 << (bits - 1)) - 1, "int" if bits == 32 else "bigint"
    d = col.cast("double")
    return (
        F.when(F.isnan(d), F.lit(0).cast(to))
        .when(d >= F.lit(float(top)), F.lit(top).cast(to))
        .when(d <= F.lit(-float(top + 1)), F.lit(-top - 1).cast(to))
        .otherwise(d.try_cast(to))
    )


def _to_integral(col: Column, src: T.DataType, name: str, rules: Rules) -> Column:
    to = spark_type(name, extra=True)
    bits = _BITS[name]
    if isinstance(src, T.StringType):
        return dates.number_text(col, dates.WHOLE, to.simpleString())
    if isinstance(src, _INT_TYPES):
        if _WIDTH[type(src)] <= bits:
            return col.cast(to)
        return _low_bits(col.cast("bigint"), bits).cast(to) if rules.wrap else col.try_cast(to)
    if isinstance(src, _FLOAT_TYPES):
        if not rules.wrap:
            return col.try_cast(to)
        if bits >= 32:
            return _saturated(col, bits)
        return _low_bits(_saturated(col, 32).cast("bigint"), bits).cast(to)
    if isinstance(src, T.DecimalType):
        return _decimal_low_bits(col, bits).cast(to) if rules.wrap else truncate(col).try_cast(to)
    return _null(to)


def _to_boolean(col: Column, src: T.DataType) -> Column:
    if isinstance(src, T.LongType):
        return col.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")) != F.lit(0)
    if isinstance(src, _INT_TYPES):
        return col != F.lit(0)
    if isinstance(src, _FLOAT_TYPES):
        return (F.abs(col) >= F.lit(1)) & ~F.isnan(col)
    if isinstance(src, T.DecimalType):
        return _decimal_low_bits(col, 32) != F.lit(0)
    return F.lower(dates.java_trim(col.cast("string"))).isin(*TRUE_TEXT)


def _to_floating(col: Column, src: T.DataType, to: T.DataType) -> Column:
    if isinstance(src, _NUMERIC):
        return col.cast(to)
    if isinstance(src, T.StringType):
        return dates.number_text(col, dates.FLOATING, to.simpleString())
    return _null(to)


def _to_decimal(col: Column, src: T.DataType, to: T.DataType) -> Column:
    if isinstance(src, T.StringType):
        return dates.number_text(col, dates.DECIMAL, to.simpleString())
    if isinstance(src, _NUMERIC):
        return col.try_cast(to)
    return _null(to)


def _to_big_integer(col: Column, src: T.DataType) -> Column:
    to = spark_type("BigInteger", extra=True)
    if isinstance(src, T.DecimalType):
        return truncate(col)
    if isinstance(src, _FLOAT_TYPES):
        return _saturated(col, 64).cast(to)
    if isinstance(src, _INT_TYPES):
        return col.cast(to)
    if isinstance(src, T.StringType):
        return dates.number_text(col, dates.WHOLE, to.simpleString())
    return _null(to)


def try_convert(col: Column, src: T.DataType, to: str, rules: Rules = DEFAULT_RULES) -> Column:
    """``col`` of Spark type ``src`` as declared type ``to``; NULL where impossible."""
    name, target = base_type(to), spark_type(to, extra=True)
    if src == target and name != "Date":
        return col
    if name in _BITS:
        return _to_integral(col, src, name, rules)
    if name == "String":
        return col.cast("string")
    if name == "Boolean":
        return _to_boolean(col, src)
    if name in ("Double", "Float"):
        return _to_floating(col, src, target)
    if name == "BigDecimal":
        return _to_decimal(col, src, target)
    if name == "BigInteger":
        return _to_big_integer(col, src)
    if name in ("Date", "Timestamp"):
        return dates.to_instant(col, src, rules.digits, millis=name == "Date")
    if name == "LocalDateTime":
        return dates.to_local_datetime(col, src, rules.digits)
    if name == "SqlDate":
        return dates.to_instant(col, src, rules.digits).cast("date")
    return dates.to_local_date(col, src, rules.digits)


def never_fails(src: T.DataType, to: str, rules: Rules = DEFAULT_RULES) -> bool:
    """True when every non-null value of ``src`` converts, so no check is needed."""
    name, target = base_type(to), spark_type(to, extra=True)
    if src == target or name in ("String", "Boolean"):
        return True
    if name in _BITS:
        if isinstance(src, _INT_TYPES):
            return rules.wrap or _WIDTH[type(src)] <= _BITS[name]
        return rules.wrap and isinstance(src, _NUMERIC)
    if name in ("Double", "Float"):
        return isinstance(src, _NUMERIC)
    if name in ("LocalDate", "LocalDateTime"):
        return isinstance(src, (T.DateType, T.TimestampType, T.TimestampNTZType))
    return False


def is_bad(col: Column, src: T.DataType, to: str, rules: Rules = DEFAULT_RULES) -> Column:
    """True where a present value cannot be converted."""
    if never_fails(src, to, rules):
        return F.lit(False)
    return col.isNotNull() & try_convert(col, src, to, rules).isNull()


def convert(
    col: Column,
    src: T.DataType,
    to: str,
    *,
    mode: str = "strict",
    rules: Rules = DEFAULT_RULES,
    primitive: bool = False,
    label: str = "value",
) -> Column:
    """Convert under a policy: ``strict`` raises on a bad value, ``lenient`` gives NULL.

    ``primitive=True`` turns a NULL input into the zero of the target type.
    """
    if mode not in ("strict", "lenient"):
        raise ValueError("mode must be 'strict' or 'lenient'")
    target = spark_type(to, extra=True)
    out = try_convert(col, src, to, rules)
    if mode == "strict" and not never_fails(src, to, rules):
        message = F.concat(
            F.lit(f"cannot convert {label} '"), col.cast("string"), F.lit(f"' from {src.simpleString()} to {to}")
        )
        out = F.coalesce(out, F.when(col.isNotNull(), F.raise_error(message).cast(target)))
    if primitive:
        out = F.when(col.isNull(), zero_of(to)).otherwise(out)
    return out


def zero_of(to: str) -> Column:
    """Default value of a primitive: 0, 0.0 or false."""
    target = spark_type(to, extra=True)
    if isinstance(target, T.BooleanType):
        return F.lit(False)
    if isinstance(target, _NUMERIC):
        return F.lit(0).cast(target)
    return _null(target)


def enum_of(col: Column, values: Sequence[str], *, mode: str = "strict") -> Column:
    """Keep text that is one of ``values`` (exact match); anything else is bad."""
    known = F.when(col.isin(*values), col)
    if mode == "lenient":
        return known
    message = F.concat(F.lit("no such value: '"), col, F.lit("'"))
    return F.coalesce(known, F.when(col.isNotNull(), F.raise_error(message).cast("string")))
