"""Rows that cannot be told apart by a key: which of them are new, by content and number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGEST = "digest"
COUNTS = f"{DIGEST} string, n bigint"
COPIES = 10_000  # copies of a row that one row of the shuffle stands for


def row_digest(df: DataFrame) -> Column:
    """Equal for rows whose columns all have equal values; nulls are equal to each other."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def row_counts(df: DataFrame) -> DataFrame:
    """``digest, n``: how often each row occurs. Equal rows are counted map-side."""
    return df.select(row_digest(df).alias(DIGEST)).groupBy(DIGEST).agg(F.count(F.lit(1)).alias("n"))


def surplus(df: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows of ``df`` beyond those in ``counts`` (``digest, n``; several lines of a digest add up).

    A row that occurs five times and was counted three times comes out twice; one that was counted
    more often than it occurs does not come out. Equal rows meet as one row with a count and are
    copied afterwards, ``COPIES`` at a time, so that a row that fills the table fills no single task.
    """
    each = df.withColumn("_digest", row_digest(df)).groupBy("_digest").agg(
        F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("_row")
    )
    had = counts.groupBy(F.col(DIGEST).alias("_digest")).agg(F.sum("n").alias("_had"))
    left = each.join(had, "_digest", "left").withColumn("_more", F.col("_n") - F.coalesce("_had", F.lit(0)))
    parts = left.where("_more > 0").select("_digest", "_row", "_more", F.expr(f"explode(sequence(0, (_more - 1) div {COPIES}))").alias("_part"))
    copies = F.expr(f"explode(sequence(1, least({COPIES}, _more - _part * {COPIES})))")
    return parts.repartition("_digest", "_part").select("_row", copies.alias("_copy")).select("_row.*")
