"""The operators' own outputs: ids, decoded bytes and places, from which the queries' columns are derived."""

from __future__ import annotations

import itertools
import re
from re import _parser

import public_tokenizers
import tiktoken

import corpus_pipeline
from rowferry.llm import byte_bpe, license_scan
from rowferry.llm.license_rules import ANCHORS, rules
from rowferry.llm.tables import table

SF = "/root/testdata/sf0.001"


def test_encoding_keeps_ids_and_decoded_bytes(spark, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    docs = table(spark, SF, "documents").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "a" * 500), (-4, "x\u00e9 \u65e5\u672c")], "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.union(odd).collect()}
    found = byte_bpe.encode_texts(docs.union(odd), path, public_tokenizers.PATTERN).collect()
    assert {r["doc_id"]: r["ids"] for r in found} == {i: library.encode_ordinary(t) for i, t in texts.items()}
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in found} == texts
    last = corpus_pipeline.STAGES[-1][1](spark, docs.union(odd), SF).collect()
    assert {r["doc_id"]: r["ids"] for r in last} == {i: library.encode_ordinary(t) for i, t in texts.items()}
    assert all(r["n_tokens"] == len(r["ids"]) for r in last)


def test_pipeline_decodes_what_it_encoded(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").limit(50)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "a" * 500), (-4, "x\u00e9 \u65e5\u672c")], "doc_id long, text string")
    last = corpus_pipeline.STAGES[-1][1](spark, docs.union(odd), SF).collect()
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in last} == {r["doc_id"]: r["text"] or "" for r in docs.union(odd).collect()}


def test_license_matches_are_places(spark):
    rows = [(1, "Foo: under the MIT License, or the Apache License, Version 2.0; MIT license"), (2, None), (3, "mit license " * 700)]
    found = {r["doc_id"]: r for r in license_scan.license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(p) for p in found[1]["base"]] == [("mit", 1, 4), ("apache-2", 7, 10)]
    assert [tuple(m)[:3] for m in found[1]["matches"]] == [("mit", 2, 4), ("apache-2", 7, 11), ("mit", 12, 13)]
    assert found[2]["n_words"] == 0 and found[2]["base"] == found[2]["matches"] == []
    assert [tuple(m)[:3] for m in found[3]["matches"]] == [("mit", 2 * i, 2 * i + 1) for i in range(700)]


def wordings(parsed):
    """Every choice of a parsed pattern's branches and optional parts, with one stand-in per open character."""
    out = [""]
    for kind, value in parsed:
        name = str(kind)
        if name == "LITERAL":
            more = [chr(value)]
        elif name == "IN":
            more = [chr(v) for k, v in value if str(k) == "LITERAL"] or ["7"]
            more = ["z"] if str(value[0][0]) == "NEGATE" else more
        elif name in ("ANY", "NOT_LITERAL"):
            more = ["z"]
        elif name == "SUBPATTERN":
            more = wordings(value[-1])
        elif name == "BRANCH":
            more = [w for branch in value[1] for w in wordings(branch)]
        else:
            assert name in ("MAX_REPEAT", "MIN_REPEAT"), name
            least, most, part = value
            more = [w * n for n in {least, 1 if least == 0 else least} for w in wordings(part)]
            assert most == 1 or all(len(w) == 1 for w in wordings(part))
        out = [a + b for a, b in itertools.product(out, more)]
    return out


def test_license_gates_lose_no_match(spark):
    known = rules()
    made = [(k, r, {re.sub(r"[()+]", "", w) for w in wordings(_parser.parse(r.pattern))}) for k, r in enumerate(known)]
    for _, rule, texts in made:
        assert all(rule.keyword in f" {t} " and any(a in rule.keyword for a in ANCHORS) for t in texts), rule
    texts = sorted({t for _, _, all_of in made for t in sorted(all_of, key=len)[:: max(1, len(all_of) - 1)]})
    texts += ["you can redistribute it and or modify it under the same terms as perl itself", "no part may be reproduced or distributed"]
    patterns = [re.compile(rf"(?<![^ ])(?:{r.pattern})(?![^ ])") for r in known]
    want = {}
    for n, text in enumerate(texts):
        found = []
        for k, pattern in enumerate(patterns):
            for m in pattern.finditer(text):
                start = text[: m.start()].count(" ")
                found.append((start, -start - m[0].count(" "), -known[k].priority, k))
        kept = [d for d in sorted(found) if not any(e < d and e[0] <= d[0] and e[1] <= d[1] and e[2] <= d[2] for e in found)]
        want[n] = [(known[d[3]].label, d[0], -d[1], -d[2], known[d[3]].confidence) for d in kept]
    assert all(want.values())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [tuple(m) for m in r["matches"]] for r in license_scan.license_matches(df).collect()}
    assert got == want
