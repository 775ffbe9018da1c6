"""Text encodings of rows: JSON values, record keys, ledger times, redaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Config keys whose value is never stored, and the mask.
SECRET_KEYS = r"(?i)password|passwd|pwd|passphrase|secret|token|jaas|credential|(api|access|private|account)_?key"
MASK = "***"

# Fixed value: date-time text used in ledger lines.
LEDGER_TIME = "yyyy-MM-dd HH:mm:ss"


def json_value(cols: Sequence[str]) -> Column:
    """Columns as one JSON object in the given order; NULL fields are kept."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in cols]), {"ignoreNullFields": "false"})


def record_key(key: str | None) -> Column:
    """Key text of a record: no key column gives NULL, a NULL value the text ``null``."""
    if key is None:
        return F.lit(None).cast("string")
    return F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))


def record_id(key: Column) -> Column:
    """Row id as text; a NULL id is the empty text."""
    return F.coalesce(key.cast("string"), F.lit(""))


def ledger_time(col: Column) -> Column:
    return F.date_format(col, LEDGER_TIME)


def redact_url(value: Column) -> Column:
    """Mask user info and parameter values in a URL.

    Covers ``//user:pw@host``, ``:user/pw@`` and ``?k=v``, ``&k=v``, ``;k=v``.
    """
    out = F.regexp_replace(value, r"//[^/\s?#]*@", f"//{MASK}@")
    out = F.regexp_replace(out, r":[^:/\s]+/[^/\s]+@", f":{MASK}@")
    return F.regexp_replace(out, r"([?&;][^=&;?#]+)=[^&;#]*", f"$1={MASK}")


def redact_text(value: Column) -> Column:
    """Mask secrets anywhere in a message: URLs, and values after a secret's name and ``=`` or ``:``.

    The name may be part of a longer one or quoted (``db.password=x``, ``"apiKey": "x"``). A quoted value goes up to
    its closing quote, any other up to a blank or one of ``, ; & ) ] }``; after ``Bearer`` or ``Basic`` the next word goes too.
    """
    name = r"""[\w.\-]*(?:password|passwd|pwd|passphrase|secret|token|jaas|credential|(?:api|access|private|account)[_\-]?key)[\w.\-]*"""
    said = r"""(?:"[^"]*"|'[^']*'|(?:(?:bearer|basic)\s+)?[^\s,;&)\]}"']+)"""
    return F.regexp_replace(redact_url(value), rf"""(?i)(\b{name}["']?\s*[=:]\s*){said}""", f"$1{MASK}")


def redact_map(config: Column) -> Column:
    """Mask secrets in a map<string,string> of connection options."""
    return F.transform_values(
        config, lambda k, v: F.when(k.rlike(SECRET_KEYS), F.lit(MASK)).otherwise(redact_url(v))
    )
