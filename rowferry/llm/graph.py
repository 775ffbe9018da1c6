"""Connected components of a link table, as alternating star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowferry.storage import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than ``u`` is linked to the smallest of ``u`` and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    pairs = edges.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return pairs.union(low.select("a", F.col("m").alias("b")))


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``(node, root)`` for every node of ``links``; ``root`` is the smallest node it reaches.

    Two star rounds per pass until the link table stays the same, each pass written to
    the shared folder, so the lineage stays short and a lost executor costs a re-read.
    Nodes are compared by their own order; rows with a null end are ignored, repeated
    links and loops are harmless, an empty table gives no rows. Only two totals per
    pass reach the driver.
    """
    pairs = links.select(
        F.greatest(left, right).alias("a"), F.least(left, right).alias("b")
    ).where("a is not null and b is not null and a != b")
    pairs = materialize(pairs.distinct(), "links")
    before = None
    while True:
        now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
        if now["n"] == 0:
            break
        pairs = materialize(_small_star(_large_star(pairs).distinct()).distinct(), "links")
    rooted = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return rooted.union(roots)
