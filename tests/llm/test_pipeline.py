"""The pipeline against its operators' plain forms, and odd rows through every stage."""

from __future__ import annotations

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from rowferry.llm import byte_bpe, decontaminate, language, simhash, toxicity
from rowferry.llm.tables import table

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_its_stages_done_plainly(spark):
    docs, labels, bench = (table(spark, SF, t) for t in ("documents", "labels", "benchmark"))
    known = {r["doc_id"] for r in language.predict_language(docs).where("lang_pred != 'und'").collect()}
    docs = docs.where(F.col("doc_id").isin(list(known)))
    clean = {r["doc_id"] for r in toxicity.score_toxicity(docs, labels).where("predicted = 0").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in clean}
    prints = {i: simhash.fingerprint(t, 4) & (2**64 - 1) for i, t in texts.items()}
    group = {i: i for i in prints}
    for _ in prints:
        new = {i: min(group[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4) for i in prints}
        if new == group:
            break
        group = new
    items = [decontaminate.normal(r["text"]) for r in bench.collect()]
    left = {i for i in group if group[i] == i}
    left = {i for i in left if not any(t in decontaminate.normal(texts[i]) for t in items)}
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {i: len(library.encode_ordinary(texts[i])) for i in left}


def test_stages_take_odd_rows_and_keep_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, score double"
    rows = [(None, "no id", None, None, None, None, None), (1, None, "en", "", 0, "", 0.0), (2, "", "en", "", 0, "", 0.0), (3, "a b", "en", "", 0, "", 0.0), (3, "a b", "en", "", 0, "", 0.0)]
    docs = spark.createDataFrame(rows, schema)
    for count, made in ((5, docs), (0, docs.limit(0))):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            made = corpus_pipeline.materialize(stage(spark, made, SF), "t")
            assert made.columns == docs.columns, name
        done = corpus_pipeline.STAGES[-1][1](spark, made, SF)
        assert done.count() == (2 if count else 0)
