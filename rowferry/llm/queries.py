"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rowferry.llm.byte_bpe import encode_texts, token_digests
from rowferry.llm.collocations import collocations
from rowferry.llm.decontaminate import contaminations
from rowferry.llm.ego_join import near_duplicates
from rowferry.llm.language import predict_language
from rowferry.llm.license_scan import scan_licenses
from rowferry.llm.piece_bpe import encode_pieces, piece_digests
from rowferry.llm.sharding import shard_documents
from rowferry.llm.simhash import simhash_components
from rowferry.llm.tables import table
from rowferry.llm.token_alignment import align_documents
from rowferry.llm.token_counts import count_tokens
from rowferry.llm.toxicity import score_toxicity
from rowferry.llm.warc_convert import pages_round_trip

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_RANKS = "byte_bpe_50k.tiktoken"
BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def op1_epsilon_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op2_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_legacy_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages_round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), shingle=4, distance=4)


def op5_language_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_language(table(spark, sf_dir, "documents"))


def op6_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY), limit=2048)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_digests(encode_texts(docs, public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN, packed=True))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabularies = public_tokenizers.path(BYTE_VOCABULARY), public_tokenizers.PATTERN, public_tokenizers.path(PIECE_MODEL)
    return align_documents(table(spark, sf_dir, "documents"), *vocabularies)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), first=2_000, fewest=100)


def op13_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_epsilon_grid_join, op2_toxicity_neighbours, op3_legacy_archives, op4_simhash_balls, op5_language_cross_parsing,
        op6_qgram_decontamination, op7_whole_token_counts, op8_byte_bpe, op9_license_scan, op10_minimax_shards,
        op11_token_alignment, op12_phrase_collocations, op13_piece_bpe,
    )
}

SQL: dict[str, str] = {
    "op1_epsilon_grid_join": """
        with recursive v as (
            select vec_id, label, embedding::double[] as e, (
                embedding is not null and label is not null and len(embedding) > 0
                and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
                and len(list_filter(embedding, lambda x: x <> 0)) > 0) as live
            from embeddings
        ), links as (
            select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
            where a.live and b.live and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.98
        ), reach as (
            select vec_id as a, vec_id as b from v
            union
            select r.a, l.b from reach r join links l on r.b = l.a
        ), root as (select a, min(b) as component_id from reach group by a),
        degree as (select a, count(*) as n from links group by a)
        select v.vec_id, coalesce(d.n, 0)::bigint as n_links, r.component_id, v.vec_id = r.component_id as kept
        from v join root r on v.vec_id = r.a left join degree d on v.vec_id = d.a
    """,
    "op3_legacy_archives": """
        with p as (
            select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest
            from pages
        ), f as (select *, min(page_id) over (partition by payload_digest) as first_id from p)
        select page_id, payload_bytes, payload_digest,
            case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
            case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to
        from f
    """,
    "op12_phrase_collocations": """
        with pieces as (
            select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
            from documents
        ), lists as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from pieces),
        totals as (select lang, sum(len(w))::bigint as n from lists group by lang),
        runs as (
            select lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) as phrase
            from lists, range(1, 6) as s(size) where len(w) >= size
        ), f as (select lang, phrase, size, count(*) as n from runs group by lang, phrase, size),
        candidates as (select lang, phrase, size, n as a, string_split(phrase, ' ') as w from f where size > 1 and n >= 100),
        inner_runs as (
            select lang, a, unnest(list_transform(range(1, size - many + 2), lambda i: array_to_string(w[i:i + many - 1], ' '))) as phrase
            from candidates, range(2, 5) as m(many) where many < size
        ), around as (select lang, phrase, max(a) as longer from inner_runs group by lang, phrase),
        cuts as (
            select c.lang, c.phrase, c.a, k, x.n as l, y.n as r, t.n as n, ((1000::hugeint * c.a * t.n) // (x.n::hugeint * y.n))::bigint as score
            from candidates c join range(1, 5) as p(k) on k < c.size join totals t on t.lang = c.lang
            join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:k], ' ')
            join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[k + 1:], ' ')
        ), weakest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
        ranked as (
            select w.*, row_number() over (partition by w.lang order by score desc, a desc, w.phrase) as rank
            from weakest w left join around o on o.lang = w.lang and o.phrase = w.phrase
            where o.longer is null or 100 * o.longer < 100 * w.a
        )
        select lang, rank::bigint as rank, phrase, a, l, r, n, score from ranked where rank <= 2000
    """,
}
