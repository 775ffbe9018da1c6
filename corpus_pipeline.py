"""Training-data pipeline over ``documents``: five stages, each a table of its own.

Documents without a known language go, toxic ones go, one document of each near-duplicate
group stays, documents with a benchmark item go; what is left is encoded and decoded again:
the last table has each document's token ids and the bytes they decode to.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.llm.byte_bpe import encode_texts
from rowferry.llm.decontaminate import keep_uncontaminated
from rowferry.llm.language import keep_known_language
from rowferry.llm.queries import BYTE_RANKS
from rowferry.llm.simhash import keep_one_per_component
from rowferry.llm.tables import table
from rowferry.llm.toxicity import keep_clean
from rowferry.storage import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_known_language(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_per_component(docs, shingle=4, distance=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = encode_texts(docs, public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language", language),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

# Hashing, learning and merging have no SQL form; tests/llm holds the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
