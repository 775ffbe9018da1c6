"""Value conversion on table columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.catalog.registry import query, table
from rowferry.functions.convert import Rules, convert, enum_of
from rowferry.functions.encode import ledger_time
from rowferry.operators.mapping import split_bad_rows
from rowferry.spec import FieldSpec, SyncSpec

WRAP = Rules(wrap=True)


def _to(df: DataFrame, column: str, to: str, **how) -> Column:
    return convert(F.col(column), df.schema[column].dataType, to, **how)


@query(
    "SELECT o_orderkey, CAST(o_orderkey AS INTEGER) AS key_int, CAST(o_orderkey AS VARCHAR) AS key_text, "
    "CAST(o_totalprice AS DECIMAL(18,2)) AS total, CAST(trunc(o_totalprice) AS BIGINT) AS total_long, "
    "CAST(o_orderdate AS DATE) AS order_day, CAST(o_totalprice AS FLOAT) AS total_float, "
    "CAST(o_orderkey AS DOUBLE) AS key_double FROM orders"
)
def convert_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, text and date conversions between column types."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey",
        _to(o, "o_orderkey", "Integer").alias("key_int"),
        _to(o, "o_orderkey", "String").alias("key_text"),
        _to(o, "o_totalprice", "BigDecimal(18,2)").alias("total"),
        _to(o, "o_totalprice", "Long").alias("total_long"),
        _to(o, "o_orderdate", "LocalDate").alias("order_day"),
        _to(o, "o_totalprice", "Float").alias("total_float"),
        _to(o, "o_orderkey", "Double").alias("key_double"),
    )


@query(
    "SELECT k, CAST(xor(k & 4294967295, 2147483648) - 2147483648 AS INTEGER) AS as_int, "
    "CAST(xor(k & 65535, 32768) - 32768 AS SMALLINT) AS as_short, "
    "CAST(xor(k & 255, 128) - 128 AS TINYINT) AS as_byte "
    "FROM (SELECT (o_orderkey - 7000) * 1000000 AS k FROM orders)"
)
def convert_int_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers that do not fit keep their low bits when wrapping is asked for."""
    o = table(spark, sf_dir, "orders").select(((F.col("o_orderkey") - 7000) * 1000000).alias("k"))
    return o.select(
        "k",
        _to(o, "k", "Integer", rules=WRAP).alias("as_int"),
        _to(o, "k", "Short", rules=WRAP).alias("as_short"),
        _to(o, "k", "Byte", rules=WRAP).alias("as_byte"),
    )


@query(
    "SELECT c_custkey, CAST(least(greatest(trunc(d), -2147483648), 2147483647) AS INTEGER) AS as_int, "
    "CAST(trunc(d) AS BIGINT) AS as_long FROM (SELECT c_custkey, c_acctbal * 1000000 AS d FROM customer)"
)
def convert_saturate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floating numbers beyond the integer range stop at its ends when wrapping."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") * 1000000).alias("d"))
    return c.select(
        "c_custkey",
        _to(c, "d", "Integer", rules=WRAP).alias("as_int"),
        _to(c, "d", "Long", rules=WRAP).alias("as_long"),
    )


@query(
    "SELECT c_custkey, CASE WHEN abs(d) <= 2147483647 THEN CAST(trunc(d) AS INTEGER) END AS as_int "
    "FROM (SELECT c_custkey, c_acctbal * 1000000 AS d FROM customer)"
)
def convert_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without wrapping such a number is bad: NULL in lenient mode."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") * 1000000).alias("d"))
    return c.select("c_custkey", _to(c, "d", "Integer", mode="lenient").alias("as_int"))


_BOOL = (
    "SELECT event_id, user_id, value, CASE user_id % 6 WHEN 0 THEN ' YES ' WHEN 1 THEN 'on' WHEN 2 THEN '1' "
    "WHEN 3 THEN 't' WHEN 4 THEN '' ELSE 'True' END AS word, (event_id % 3) * 4294967296 + event_id % 2 AS big FROM events"
)


@query(
    "SELECT event_id, word, lower(trim(word)) IN ('1', 'true', 'yes', 'on') AS from_text, "
    f"abs(value) >= 1 AS from_double, (big & 4294967295) <> 0 AS from_long FROM ({_BOOL})"
)
def convert_bool_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth of texts, fractions (0.5 is false) and longs (low 32 bits count)."""
    which = F.col("user_id") % 6
    word = F.when(which == 0, " YES ").when(which == 1, "on").when(which == 2, "1").when(which == 3, "t")
    e = table(spark, sf_dir, "events").select(
        "event_id",
        "value",
        word.when(which == 4, "").otherwise("True").alias("word"),
        ((F.col("event_id") % 3) * 4294967296 + F.col("event_id") % 2).alias("big"),
    )
    return e.select(
        "event_id",
        "word",
        _to(e, "word", "Boolean").alias("from_text"),
        _to(e, "value", "Boolean").alias("from_double"),
        _to(e, "big", "Boolean").alias("from_long"),
    )


@query(
    "SELECT o_orderkey, o_orderkey AS as_long, CAST(o_orderkey AS INTEGER) AS as_int, o_totalprice AS as_double, "
    "CAST(o_totalprice AS DECIMAL(18,2)) AS as_decimal, CAST(NULL AS BIGINT) AS bad_long, "
    "CAST(o_orderkey AS BIGINT) AS as_big FROM orders"
)
def convert_text_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers out of padded text; ``1.5`` is no integer."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.lit(" \t"), F.col("o_orderkey").cast("string"), F.lit(" ")).alias("whole"),
        F.concat(F.lit(" "), F.col("o_totalprice").cast("string"), F.lit("\n")).alias("price"),
        F.concat(F.col("o_orderkey").cast("string"), F.lit(".5")).alias("broken"),
    )
    return o.select(
        "o_orderkey",
        _to(o, "whole", "Long").alias("as_long"),
        _to(o, "whole", "Integer").alias("as_int"),
        _to(o, "price", "Double").alias("as_double"),
        _to(o, "price", "BigDecimal(18,2)").alias("as_decimal"),
        _to(o, "broken", "Long", mode="lenient").alias("bad_long"),
        _to(o, "whole", "BigInteger").cast("bigint").alias("as_big"),
    )


@query(
    "SELECT event_id, date_trunc('second', ts) AS from_dash, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS from_slash, "
    "date_trunc('second', ts) AS from_iso, CAST(ts AS DATE) AS as_day, CAST(ts AS DATE) AS day_of_compact, "
    "CAST(NULL AS DATE) AS bad_day FROM events"
)
def convert_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates out of the known text formats; trailing text is ignored."""
    e = table(spark, sf_dir, "events")
    e = e.select(
        "event_id",
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" tail")).alias("dash"),
        F.date_format("ts", "yyyy/M/d").alias("slash"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
        F.date_format("ts", "yyyy-MM-dd HH:mm").alias("day"),
        F.date_format("ts", "yyyyMMdd").alias("compact"),
        F.date_format("ts", "dd.MM.yyyy").alias("other"),
    )
    return e.select(
        "event_id",
        _to(e, "dash", "Date").cast("timestamp_ntz").alias("from_dash"),
        _to(e, "slash", "Date").cast("timestamp_ntz").alias("from_slash"),
        _to(e, "iso", "LocalDateTime").alias("from_iso"),
        _to(e, "day", "LocalDate").alias("as_day"),
        _to(e, "compact", "LocalDate", rules=Rules(digits="pattern")).alias("day_of_compact"),
        _to(e, "other", "LocalDate", mode="lenient").alias("bad_day"),
    )


@query("SELECT event_id, ms AS from_long, ms AS from_text FROM (SELECT event_id, event_id * 86400123 AS ms FROM events)")
def convert_epoch_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and digit-only text are epoch milliseconds."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 86400123).alias("ms"))
    e = e.withColumn("text", F.col("ms").cast("string"))
    return e.select(
        "event_id",
        F.unix_millis(_to(e, "ms", "Date")).alias("from_long"),
        F.unix_millis(_to(e, "text", "Date")).alias("from_text"),
    )


@query(
    "SELECT c_custkey, CAST(trunc(c_acctbal) AS BIGINT) AS whole, CAST(trunc(c_acctbal) AS BIGINT) AS whole_of_double "
    "FROM customer"
)
def convert_big_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractions are cut toward zero, not rounded."""
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_acctbal").cast("decimal(18,2)").alias("exact"), "c_acctbal"
    )
    return c.select(
        "c_custkey",
        _to(c, "exact", "BigInteger").cast("bigint").alias("whole"),
        _to(c, "c_acctbal", "BigInteger").cast("bigint").alias("whole_of_double"),
    )


@query(
    "SELECT d.doc_id, coalesce(l.quality, 0) AS quality, coalesce(l.toxic <> 0, false) AS toxic, l.quality AS raw "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
)
def convert_primitive_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A NULL becomes zero or false for a primitive field, and stays NULL otherwise."""
    j = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return j.select(
        "doc_id",
        _to(j, "quality", "Integer", primitive=True).alias("quality"),
        _to(j, "toxic", "Boolean", primitive=True).alias("toxic"),
        _to(j, "quality", "Integer").alias("raw"),
    )


@query(
    "SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority END AS priority FROM orders"
)
def enum_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text limited to the names of an enumeration."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", enum_of(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"], mode="lenient").alias("priority"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS logged_at FROM events")
def ledger_time_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date-times the way ledger lines hold them."""
    return table(spark, sf_dir, "events").select("event_id", ledger_time(F.col("ts")).alias("logged_at"))


@query(
    "SELECT event_id, user_id % 7 = 0 AS dead, CASE WHEN user_id % 7 <> 0 THEN value END AS amount, "
    "CASE WHEN user_id % 7 = 0 THEN 'cannot convert: amount' END AS reason FROM events"
)
def dead_letter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that convert and rows that do not: together the whole table."""
    spec = SyncSpec(
        fields=(FieldSpec("event_id", "Long", checkpoint=True), FieldSpec("amount", "Double", source="text")),
    )
    text = F.when(F.col("user_id") % 7 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    good, bad = split_bad_rows(table(spark, sf_dir, "events").withColumn("text", text), spec)
    return good.select("event_id", F.lit(False).alias("dead"), "amount", F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select(
            F.col("record_id").cast("bigint").alias("event_id"),
            F.lit(True).alias("dead"),
            F.lit(None).cast(T.DoubleType()).alias("amount"),
            "reason",
        )
    )
