"""Read legacy ARC archives: version-specific header lines and declared lengths.

An ARC file starts with a ``filedesc://`` record whose body names the version and the
fields of every later header line. Files may be gzip (one member or one per record) or
plain; concatenated archives switch fields at each ``filedesc://`` record.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: header fields by version.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}

ARC_SCHEMA = (
    "file string, offset long, version int, url string, ip string, archive_date string, mime string, "
    "record_id string, warc_date string, warc_type string, content_type string, "
    "head binary, block binary, block_digest string, payload_digest string, payload_bytes long, error string"
)
BATCH_BYTES = 8 << 20


def open_archive(content: bytes) -> BinaryIO:
    """A stream over the archive's bytes; gzip members are unpacked piece by piece."""
    raw = io.BytesIO(content)
    return gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw  # type: ignore[return-value]


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def warc_date(digits: str) -> str | None:
    """ARC date digits (4 to 14 of them) as an ISO time; missing parts start the period, others give None."""
    if not re.fullmatch(r"\d{4}(\d\d){0,5}", digits):
        return None
    d = digits + "00000101000000"[len(digits):]
    if not ("01" <= d[4:6] <= "12" and "01" <= d[6:8] <= "31" and d[8:10] < "24" and d[10:12] < "60" and d[12:14] <= "60"):
        return None
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_urn(*parts: object) -> str:
    """A UUID (version 3 form) that depends on the parts alone, so a repeated task names the record alike."""
    h = hashlib.md5("\x00".join(map(str, parts)).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-3{h[13:16]}-{'89ab'[int(h[16], 16) % 4]}{h[17:20]}-{h[20:]}>"


def http_head(block: bytes) -> int:
    """Length of the HTTP status line and headers with their empty line; 0 if there are none."""
    if not block.startswith(b"HTTP/"):
        return 0
    ends = [at + len(mark) for mark in (b"\r\n\r\n", b"\n\n") if (at := block.find(mark)) >= 0]
    return min(ends, default=len(block))


def _converted(file: str, offset: int, version: int, fields: dict[str, str], block: bytes, error: str | None) -> dict[str, Any]:
    url, date = fields.get("URL", ""), fields.get("Archive-date", "")
    head = http_head(block)
    if url.startswith("filedesc://"):
        kind, mime = "warcinfo", "text/plain"
    elif head:
        kind, mime = "response", "application/http;msgtype=response"
    else:
        kind, mime = "resource", fields.get("Content-type") or "application/octet-stream"
    payload = block[head:]
    if error is None and warc_date(date) is None:
        error = f"date {date!r}"
    return {
        "file": file, "offset": offset, "version": version, "url": url, "ip": fields.get("IP-address"),
        "archive_date": date, "mime": fields.get("Content-type"), "record_id": record_urn(file, offset, url, date),
        "warc_date": warc_date(date), "warc_type": kind, "content_type": mime, "head": block[:head], "block": block,
        "block_digest": hashlib.sha256(block).hexdigest(), "payload_digest": hashlib.sha256(payload).hexdigest(),
        "payload_bytes": len(payload), "error": error,
    }


def arc_records(file: str, content: bytes) -> Iterator[dict[str, Any]]:
    """The records of one archive, in order.

    A record cut short, or with an impossible date, is returned with ``error``; a header line
    without a length ends the file with an error row, because the next record can't be found.
    """
    stream, version, names = open_archive(content), 1, ARC_FIELDS[1].split()
    while True:
        offset = stream.tell()
        line = stream.readline()
        if not line:
            return
        words = line.rstrip(b"\r\n").split(b" ")
        if words == [b""]:
            continue
        own = ARC_FIELDS[1].split() if words[0].startswith(b"filedesc://") else names
        spare = len(words) - len(own) + 1  # a URL with blanks takes what is left over
        parts = [b" ".join(words[:spare]), *words[spare:]] if spare > 1 else words
        fields = dict(zip(own, map(_text, parts), strict=False))
        length = fields.get("Archive-length", "")
        if not re.fullmatch(r"\d{1,18}", length):
            yield _converted(file, offset, version, fields, b"", "header line without a length")
            return
        block = stream.read(int(length))
        error = None if len(block) == int(length) else f"{len(block)} of {length} bytes"
        if words[0].startswith(b"filedesc://"):
            lines = block.split(b"\n")
            version = int(lines[0].split()[0]) if re.match(rb"\d{1,4}\b", lines[0]) else 1
            names = _text(lines[1]).split() if len(lines) > 1 and lines[1].strip() else ARC_FIELDS.get(version, ARC_FIELDS[1]).split()
        yield _converted(file, offset, version, fields, block, error)


def archive_rows(records, schema: pa.Schema):
    """Turns ``records(name, content)`` into a function for ``mapInArrow`` over archive files."""

    def run(batches):
        held: list[dict[str, Any]] = []
        size = 0
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                name = path.as_py().rsplit("/", 1)[-1]
                for row in records(name, content.as_py()):
                    held.append(row)
                    size += 500 + len(row.get("block") or b"")
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return run


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Archive files as ``(path, content)``; a file is the unit of work, so writers bound its size."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the ARC files in a folder with its equivalent WARC fields (``ARC_SCHEMA``)."""
    return read_files(spark, path).mapInArrow(archive_rows(arc_records, arrow_schema(spark, ARC_SCHEMA)), ARC_SCHEMA)


def header_text(value: Column, empty: str) -> Column:
    """A value for a header line: white space and control characters become ``%20``, null and blank ``empty``."""
    clean = F.regexp_replace(value, r"[\x00-\x20\x7F\u0085   ]", "%20")
    return F.when(F.coalesce(F.length(clean), F.lit(0)) > 0, clean).otherwise(F.lit(empty))


def write_records(values: DataFrame, path: str) -> None:
    """Write finished records as gzip files; the line feed after each value is the record's own last byte."""
    out = values.write.option("lineSep", "\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
    out.text(path)


def write_arc(records: DataFrame, path: str, versions: tuple[int, ...] = (1, 2)) -> None:
    """Write ``(url, ip, archive_date, mime, block)`` as gzip ARC files, one per partition, versions by turns.

    The first row of a partition carries the version block. The text writer ends each row
    with the line feed that separates ARC records, and commits whole files only.
    """
    size = F.octet_length("block").cast("string")
    lead = [header_text(F.col("url"), "urn:none"), header_text(F.col("ip"), "0.0.0.0"), F.col("archive_date"), header_text(F.col("mime"), "no-type")]
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    turn = F.pmod(F.spark_partition_id(), F.lit(len(versions)))
    line, intro = None, None
    for n, version in enumerate(versions):
        more = [F.lit("200"), F.lit("-"), F.lit("-"), F.lit("0"), F.lit("-")] if version == 2 else []
        own = F.concat_ws(" ", *lead, *more, size)
        body = f"{version} 0 rowferry\n{ARC_FIELDS[version]}\n"
        block = F.lit(f"filedesc://rowferry.arc 0.0.0.0 20000101000000 text/plain {len(body)}\n{body}\n")
        line = own if line is None else F.when(turn == n, own).otherwise(line)
        intro = block if intro is None else F.when(turn == n, block).otherwise(intro)
    head = F.concat(F.when(first, intro).otherwise(F.lit("")), line, F.lit("\n"))
    value = F.concat(head.cast("binary"), F.col("block")).cast("string")
    write_records(records.select(value.alias("value")), path)
