"""Legacy archive converter: ARC records as WARC response, revisit and resource records."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.llm.arc_files import archive_rows, arrow_schema, http_head, open_archive, read_arc, read_files, write_arc, write_records
from rowferry.storage import materialize, new_folder

# Fixed value of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

WARC_SCHEMA = (
    "file string, record_id string, warc_type string, warc_date string, url string, refers_to_id string, "
    "head string, payload_bytes long, payload_digest string, declared_digest string, digest_ok boolean"
)


def mark_revisits(records: DataFrame, order: Column, min_bytes: int = 100) -> DataFrame:
    """Adds ``warc_type`` revisit and the ``refers_*`` fields to responses whose payload came before.

    Of responses with equal payload digests of at least ``min_bytes``, the first by ``order``
    (nulls last, then record id) stays a response. Only ids and digests are grouped, with
    map-side combining, and only digests that repeat are joined back; that table is written
    first, so its size is known when Spark picks the join, and a hot digest is split by AQE.
    """
    place = F.struct(order.isNull().alias("last"), order.alias("order"), "record_id", "url", "warc_date")
    known = records.where((F.col("warc_type") == "response") & (F.col("payload_bytes") >= min_bytes) & F.col("error").isNull())
    firsts = known.groupBy("payload_digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = materialize(
        firsts.select(
            "payload_digest", F.col("first.record_id").alias("refers_to_id"), F.col("first.url").alias("refers_to_url"),
            F.col("first.warc_date").alias("refers_to_date"),
        ),
        "warc-firsts",
    )
    again = (F.col("warc_type") == "response") & (F.col("payload_bytes") >= min_bytes) & F.col("error").isNull()
    again = again & F.col("refers_to_id").isNotNull() & (F.col("refers_to_id") != F.col("record_id"))
    joined = records.join(firsts, "payload_digest", "left").withColumn("again", F.coalesce(again, F.lit(False)))
    keep = [F.when(F.col("again"), F.col(c)).alias(c) for c in ("refers_to_id", "refers_to_url", "refers_to_date")]
    return joined.select(
        *[c for c in records.columns if c != "warc_type"],
        F.when(F.col("again"), F.lit("revisit")).otherwise(F.col("warc_type")).alias("warc_type"),
        *keep,
    )


def write_warc(records: DataFrame, path: str) -> None:
    """Write converted records as gzip WARC/1.1 files, one per partition.

    A revisit holds the HTTP headers only. Rows with ``error`` aren't written; they stay
    in the table of records. The text writer's line feed is the last byte of each record.
    """
    body = F.when(F.col("warc_type") == "revisit", F.col("head")).otherwise(F.col("block"))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    info = F.col("warc_type") == "warcinfo"
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("warc_type")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("warc_date")),
        line("WARC-Target-URI", F.when(~info, F.col("url"))),
        line("WARC-IP-Address", F.when(~info & (F.col("ip") != "0.0.0.0"), F.col("ip"))),
        line("WARC-Profile", F.when(F.col("warc_type") == "revisit", F.lit(REVISIT_PROFILE))),
        line("WARC-Refers-To", F.col("refers_to_id")),
        line("WARC-Refers-To-Target-URI", F.col("refers_to_url")),
        line("WARC-Refers-To-Date", F.col("refers_to_date")),
        line("Content-Type", F.col("content_type")),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(body, 256))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
    )
    value = F.concat(head.cast("binary"), body, F.lit(b"\r\n\r")).cast("string")
    write_records(records.where(F.col("error").isNull()).select(value.alias("value")), path)


def warc_records(file: str, content: bytes) -> Iterator[dict[str, Any]]:
    """The records of one WARC file; digests and sizes are those of the bytes read."""
    stream = open_archive(content)
    while line := stream.readline():
        if not line.strip():
            continue
        if not re.match(rb"WARC/\d+\.\d+\r?\n", line):
            raise ValueError(f"{file}: no record at {stream.tell() - len(line)}")
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError(f"{file}: {len(block)} of {length} bytes")
        head = http_head(block)
        payload = block[head:]
        digest = hashlib.sha256(payload).hexdigest()
        declared = fields.get("warc-payload-digest", "").removeprefix("sha256:")
        whole = fields.get("warc-block-digest") in (None, f"sha256:{hashlib.sha256(block).hexdigest()}")
        yield {
            "file": file, "record_id": fields.get("warc-record-id"), "warc_type": fields.get("warc-type"),
            "warc_date": fields.get("warc-date"), "url": fields.get("warc-target-uri"),
            "refers_to_id": fields.get("warc-refers-to"), "head": block[:head].decode("utf-8", "replace"),
            "payload_bytes": len(payload), "payload_digest": digest, "declared_digest": declared,
            "digest_ok": whole and (fields.get("warc-type") == "revisit" or declared in ("", digest)),
        }


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the WARC files in a folder (``WARC_SCHEMA``)."""
    return read_files(spark, path).mapInArrow(archive_rows(warc_records, arrow_schema(spark, WARC_SCHEMA)), WARC_SCHEMA)


def resolve_revisits(read: DataFrame) -> DataFrame:
    """Gives each revisit the payload size and digest of the response it names, and that response's ``head``.

    Only revisits are joined; all other records name no response and stay where they are. A response that most
    revisits name is one row of the smaller side, which AQE sends to all, or the split side of its skew join.
    """
    origin = read.where("warc_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.col("head").alias("origin_head"),
        F.col("payload_bytes").alias("origin_bytes"), F.col("payload_digest").alias("origin_digest"),
    )
    again = F.coalesce(F.col("warc_type") == "revisit", F.lit(False))
    plain = read.where(~again).withColumn("origin_head", F.lit(None).cast("string"))
    revisits = read.where(again).drop("payload_bytes", "payload_digest").join(origin, "refers_to_id", "left")
    revisits = revisits.withColumnsRenamed({"origin_bytes": "payload_bytes", "origin_digest": "payload_digest"})
    return plain.unionByName(revisits)


def convert_archives(spark: SparkSession, arc_path: str, warc_path: str, order: Column, min_bytes: int = 100) -> DataFrame:
    """ARC folder to WARC folder; returns the records of the new archives, read back."""
    records = read_arc(spark, arc_path)
    write_warc(mark_revisits(records, order, min_bytes), warc_path)
    return read_warc(spark, warc_path)


def page_header(head: str) -> Column:
    """The page id that a record's HTTP headers carry; null where there is none."""
    return F.regexp_extract(F.col(head).cast("string"), r"(?m)^X-Page-Id: (-?\d+)\r?$", 1).try_cast("long")


def pages_round_trip(pages: DataFrame) -> DataFrame:
    """Pages as legacy archives of both versions, converted to WARC and read back; one row per page row.

    Null html is an empty payload, a null url the placeholder ``urn:none``, a null page id
    stays null and comes last among equal payloads. Repeated rows are separate records.
    Other columns of ``pages`` aren't read. An empty table gives no rows.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        F.coalesce(F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("")),
        F.lit("Content-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"),
    )
    second = F.coalesce(F.pmod("page_id", F.lit(10**8)), F.lit(0)) + 978307200
    rows = pages.select(
        "url", F.lit(None).cast("string").alias("ip"),
        F.date_format(F.timestamp_seconds(second), "yyyyMMddHHmmss").alias("archive_date"),
        F.lit("text/html").alias("mime"), F.concat(head.cast("binary"), payload).alias("block"),
    )
    arc, warc = new_folder(spark, "arc"), new_folder(spark, "warc")
    write_arc(rows, arc)
    read = materialize(convert_archives(spark, arc, warc, page_header("head")).where("warc_type != 'warcinfo'"), "warc-read")
    found = resolve_revisits(read)
    return found.select(
        page_header("head").alias("page_id"), "payload_bytes", "payload_digest",
        F.col("warc_type").alias("record_type"),
        F.when(F.col("warc_type") == "revisit", page_header("origin_head")).alias("refers_to"),
        "digest_ok", "record_id", "warc_date",
    )
