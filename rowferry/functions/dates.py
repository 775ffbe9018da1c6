"""Date and time conversion as native Column expressions.

Epoch numbers and zone-less text are read in the session time zone; pin
``spark.sql.session.timeZone`` where results must not depend on the machine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Blanks that do not count at either end of a text: code points up to 32.
_BLANK = r"[\x00-\x20]*"
_BLANKS = "".join(map(chr, range(33)))

# Accepted date texts, with ``-`` or ``/``, with or without a time.
# Only the start of the text has to match; trailing text is ignored.
_DASHED = r"\d{4}-\d{1,2}-\d{1,2}"
_SLASHED = r"\d{4}/\d{1,2}/\d{1,2}"
_CLOCK = r"\d{1,2}:\d{1,2}:\d{1,2}"
_PARSE = "[yyyy-M-d][yyyy/M/d][ H:m:s][ ]"
_COMPACT = ((r"\d{14}", "yyyyMMddHHmmss"), (r"\d{8}", "yyyyMMdd"))

_ZONE = r"(?:Z|[+-]\d{2}:\d{2}(?::\d{2})?)?"
_ISO_LOCAL = rf"^{_BLANK}({_DASHED}T\d{{2}}:\d{{2}}(?::\d{{2}}(?:\.\d{{1,9}})?)?){_ZONE}(?:\[[^\]]*\])?{_BLANK}$"
_ISO_DATE = rf"^{_BLANK}(\d{{4}}-\d{{2}}-\d{{2}}){_ZONE}{_BLANK}$"

# Texts that are numbers.
_MANTISSA = r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
WHOLE = rf"^{_BLANK}[+-]?[0-9]+{_BLANK}$"
DECIMAL = rf"^{_BLANK}[+-]?{_MANTISSA}{_BLANK}$"
FLOATING = rf"^{_BLANK}[+-]?(?:{_MANTISSA}[dDfF]?|NaN|Infinity){_BLANK}$"

# Up to 15 digits of milliseconds always fit an instant.
_SHORT_EPOCH = rf"^{_BLANK}[+-]?[0-9]{{1,15}}{_BLANK}$"
_MAX_MILLIS = (2**63 - 1) // 1000


def java_trim(col: Column) -> Column:
    """Strip control characters and blanks (code points up to 32) from both ends."""
    return F.btrim(col, F.lit(_BLANKS))


def number_text(col: Column, pattern: str, to: str) -> Column:
    """Text of a number pattern as a number. The pattern is checked first: a failing
    ``try_cast`` costs far more than a match. The cast itself skips blanks."""
    return F.when(col.rlike(pattern), col.try_cast(to))


def from_millis(col: Column) -> Column:
    """Epoch milliseconds to an instant; NULL beyond the representable range."""
    ms = col.cast("bigint")
    return F.when(ms.between(-_MAX_MILLIS, _MAX_MILLIS), F.timestamp_millis(ms))


def _epoch_text(col: Column) -> Column:
    ms = col.try_cast("bigint")
    return F.when(col.rlike(_SHORT_EPOCH), F.timestamp_millis(ms)).when(col.rlike(WHOLE), from_millis(ms))


def _date_text(col: Column, dates: str, clock: str) -> Column:
    """Date at the start of a text, its clock after blanks if there is one."""
    head = rf"^{_BLANK}({dates}){clock}"
    start = F.regexp_replace(col, rf"(?s){head}.*$", "$1 $2")
    return F.when(col.rlike(head), F.try_to_timestamp(start, F.lit(_PARSE)).cast("timestamp"))


def _iso(col: Column, pattern: str, to: str) -> Column:
    return F.when(col.rlike(pattern), F.regexp_extract(col, pattern, 1).try_cast(to))


def _compact(col: Column, digits: str) -> list[Column]:
    if digits != "pattern":
        return []
    return [
        F.when(col.rlike(rf"^{_BLANK}{p}{_BLANK}$"), F.try_to_timestamp(java_trim(col), F.lit(fmt)).cast("timestamp"))
        for p, fmt in _COMPACT
    ]


def text_to_instant(col: Column, digits: str) -> Column:
    """Text to an instant: digit-only text first, then the known formats."""
    found = _date_text(col, f"{_DASHED}|{_SLASHED}", f"(?: +({_CLOCK}))?")
    return F.coalesce(*_compact(col, digits), _epoch_text(col), found)


def to_instant(col: Column, src: T.DataType, digits: str, *, millis: bool = False) -> Column:
    """To an instant; ``millis`` drops what a millisecond clock cannot hold."""
    if isinstance(src, T.TimestampType):
        return F.date_trunc("millisecond", col) if millis else col
    if isinstance(src, T.DateType):
        return col.cast("timestamp")
    if isinstance(src, T.LongType):
        return from_millis(col)
    if isinstance(src, T.StringType):
        return text_to_instant(col, digits)
    return F.lit(None).cast("timestamp")


def to_local_datetime(col: Column, src: T.DataType, digits: str) -> Column:
    if isinstance(src, (T.TimestampType, T.DateType, T.TimestampNTZType)):
        return col.cast("timestamp_ntz")
    if isinstance(src, T.LongType):
        return from_millis(col).cast("timestamp_ntz")
    if isinstance(src, T.StringType):
        found = _date_text(col, _DASHED, f"(?: +({_CLOCK}))")
        instants = F.coalesce(*_compact(col, digits), _epoch_text(col), found)
        return F.coalesce(_iso(col, _ISO_LOCAL, "timestamp_ntz"), instants.cast("timestamp_ntz"))
    return F.lit(None).cast("timestamp_ntz")


def to_local_date(col: Column, src: T.DataType, digits: str) -> Column:
    if isinstance(src, (T.TimestampType, T.DateType, T.TimestampNTZType)):
        return col.cast("date")
    if isinstance(src, T.LongType):
        return from_millis(col).cast("date")
    if isinstance(src, T.StringType):
        found = _date_text(col, _DASHED, "()")
        instants = F.coalesce(*_compact(col, digits), _epoch_text(col), found)
        return F.coalesce(_iso(col, _ISO_DATE, "date"), instants.cast("date"))
    return F.lit(None).cast("date")


def local_millis(col: Column) -> Column:
    """Milliseconds since 1970-01-01T00:00 of a zone-less date-time, whatever the session zone."""
    day = F.unix_date(col.cast("date")).cast("bigint") * F.lit(86_400_000)
    clock = F.hour(col) * F.lit(3_600_000) + F.minute(col) * F.lit(60_000)
    return day + clock + F.floor(F.date_part(F.lit("SECOND"), col) * F.lit(1000)).cast("bigint")
