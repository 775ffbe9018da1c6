"""The training-data operators against brute force, libraries and edge rows."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from rowferry.llm import arc_files, byte_bpe, decontaminate, language, license_scan, simhash, token_counts, toxicity
from rowferry.llm.ego_join import near_duplicates
from rowferry.llm.graph import components
from rowferry.llm.license_rules import ANCHORS, rules
from rowferry.llm.sharding import shard_documents
from rowferry.llm.tables import table
from rowferry.llm.warc_convert import pages_round_trip, read_warc, write_warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, line string, key string"
ODD = [
    (None, "no id here", "en", None, None, 0.5, "x", "k"),
    (1, None, None, "s", 0, None, None, None),
    (2, "", "en", "s", 0, None, None, None),
    (3, "one", "en", "s", 3, None, None, None),
    (3, "one", "en", "s", 3, None, None, None),
    (4, "\x00\x1f .. 123 %%%", None, "s", 3, None, None, None),
    (5, "word " * 30_000, "en", "s", 3, None, None, None),
    (6, "the quick brown fox jumps over the lazy dog", "en", "s", 3, None, None, None),
    (7, "the quick brown fox jumps over the lazy dog", "en", "s", 3, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


def roots(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return [find(x) for x in range(n)]


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (None, 3), (1, 0), (0, 1)]
    found = components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert {r["node"]: r["root"] for r in found} == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_near_duplicate_vectors_match_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    rows = []
    for i in range(900):
        near = base[i % 40] * rng.uniform(0.5, 3) + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.2])
        rows.append((i, [float(np.float32(x)) for x in near], int(i % 3), "clash"))
    rows += [(900, None, 1, ""), (901, [0.0] * 16, 1, ""), (902, [math.nan] * 16, 1, ""), (903, [None] * 16, 1, ""), (904, rows[0][1], None, ""), (905, [], 0, ""), (906, [1.0], 0, "")]
    rows += [(i, rows[0][1], rows[0][2], "") for i in range(907, 930)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cid string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(df, 0.98).collect()}
    live = [(v, np.array(e), lab) for v, e, lab, _ in rows if e and lab is not None and None not in e and np.isfinite(e).all() and np.any(e)]
    links = [
        (a[0], b[0]) for i, a in enumerate(live) for b in live[:i]
        if a[2] == b[2] and a[1].size == b[1].size and a[1] @ b[1] / np.sqrt((a[1] @ a[1]) * (b[1] @ b[1])) >= 0.98
    ]
    degree = np.bincount(np.array(links).ravel(), minlength=930)
    root = roots(930, links)
    assert got == {v: (degree[v], root[v], root[v] == v) for v in range(930)}
    assert near_duplicates(df.limit(0)).count() == 0


def test_simhash_matches_definition_and_all_pairs(docs, odd):
    rows = docs.select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in simhash.simhash_components(docs).collect()}
    prints = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))
        parts = [" ".join(words[j : j + 4]) for j in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        prints[i] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    ids = sorted(prints)
    links = [(a, b) for a in range(len(ids)) for b in range(a) if (prints[ids[a]] ^ prints[ids[b]]).bit_count() <= 4]
    assert [got[i]["component_id"] for i in ids] == [ids[r] for r in roots(len(ids), links)]
    strange = simhash.simhash_components(odd).collect()
    assert len(strange) == len(ODD)
    assert {r["component_id"] for r in strange if r["doc_id"] in (1, 2)} == {1}
    kept = simhash.keep_one_per_component(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6]
    assert simhash.simhash_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("distance", [2, 4])
def test_ball_links_lose_no_pair(spark, distance):
    rng = random.Random(distance)
    centres = [rng.getrandbits(64) for _ in range(60)]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for c in centres for _ in range(25)}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    df = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    found = [(r["a"], r["b"]) for r in simhash.ball_links(df, distance).collect()]
    place = {v: i for i, v in enumerate(values)}
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= distance for a, b in found)
    want = [(i, j) for i in range(len(values)) for j in range(i) if ((values[i] ^ values[j]) & (2**64 - 1)).bit_count() <= distance]
    assert roots(len(values), [(place[a], place[b]) for a, b in found]) == roots(len(values), want)
    with pytest.raises(ValueError):
        simhash.ball_links(df, 3)


def test_dense_prefix_is_made_in_parts(monkeypatch):
    rng = random.Random(5)
    low = np.array([rng.getrandbits(20) & 0b11111111111100001111 for _ in range(300)], np.uint64)
    budget = np.full(300, 2)
    whole = {frozenset(p) for a, b in simhash._collisions(low, budget, 20, {}) for p in zip(a.tolist(), b.tolist(), strict=True)}
    monkeypatch.setattr(simhash, "VARIANTS_AT_ONCE", 500)
    parts = {frozenset(p) for a, b in simhash._collisions(low, budget, 20, {}) for p in zip(a.tolist(), b.tolist(), strict=True)}
    assert roots(300, whole) == roots(300, parts)


def test_longest_match_phrases():
    sample = bytes([2, 3, 4, 2, 3, 5])
    moves = language.suffix_automaton(sample, 7)

    def slow(data):
        count, at = 0, 0
        while at < len(data):
            size = max([n for n in range(1, len(data) - at + 1) if bytes(data[at : at + n]) in sample], default=0)
            count, at = count + 1, at + max(1, size)
        return count

    rng = random.Random(1)
    for _ in range(400):
        data = bytes(rng.choice([2, 3, 4, 5, 6]) for _ in range(rng.randrange(1, 15)))
        assert language.phrases(data, moves) == slow(data)


def test_language_is_told_on_held_out_rows(spark, odd):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = language.predict_language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.where("lang = lang_pred").count() >= 0.95 * found.count()
    strange = {r["doc_id"]: r for r in language.predict_language(odd).collect()}
    assert [strange[i]["lang_pred"] for i in (1, 2, 4)] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in strange.values())
    assert language.keep_known_language(odd).count() == len(ODD) - 3
    assert language.predict_language(docs.limit(0)).count() == 0


def test_toxicity_neighbours_are_exact(spark):
    rng = random.Random(2)
    terms, rows = 30, []
    for _ in range(400):
        at = tuple(sorted(rng.sample(range(terms), rng.randrange(1, 6))))
        raw = [rng.random() + 0.1 for _ in at]
        rows.append((at, tuple(x / math.sqrt(sum(y * y for y in raw)) for x in raw)))
    model = toxicity.Model(tuple(map(str, range(terms))), (1.0,) * terms, tuple(range(400)), tuple(i % 2 for i in range(400)), tuple(rows), ((), ()), 0.1)
    index = toxicity.BlockMaxIndex(model)
    dense = np.zeros((400, terms))
    for i, (at, w) in enumerate(rows):
        dense[i, list(at)] = w
    for at, w in rows[:60]:
        query = np.zeros(terms)
        query[list(at)] = w
        _, cosines = index.nearest(at, w, None)
        want = np.sort(dense @ query)[::-1][: toxicity.NEIGHBOURS]
        assert np.allclose(cosines, want[want > 0], atol=1e-6)


def test_toxicity_on_held_out_rows_and_odd_rows(spark, odd):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    scored = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out")
    c = {(r["toxic"], r["predicted"]): r["count"] for r in scored.groupBy("toxic", "predicted").count().collect()}
    assert c[1, 1] >= 0.9 * (c[1, 1] + c.get((1, 0), 0)) and c.get((0, 1), 0) <= 0.02 * c[0, 0]
    none = spark.createDataFrame([(1, None, 1), (None, 1, 1), (6, 1, 0), (6, 0, 0)], "doc_id long, toxic int, quality int")
    got = toxicity.score_toxicity(odd, none).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score_toxicity(odd.limit(0), none.limit(0)).count() == 0


PAGES = [
    (1, "http://a/ b\nc", "<p>é</p>" * 30, "x"), (2, None, "<p>é</p>" * 30, "x"), (3, "u", "short", "x"), (4, "u", "short", "x"),
    (5, "u", None, "x"), (6, "u", "", "x"), (2, "u", "<p>é</p>" * 30, "x"), (None, "u", "<p>é</p>" * 30, "x"), (7, "u", "WARC/1.1\r\n\r\n" * 20, "x"),
    (8, "u", "http://x 1.2.3.4 20200101000000 text/html 5\n" * 9, "x"), (9, "u", "a" * 2_000_000, "x"),
]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, head string").repartition(3)
    rows = pages_round_trip(pages).collect()
    assert len(rows) == len(PAGES) and all(r["digest_ok"] for r in rows)
    want = sorted((p or 0, hashlib.sha256((h or "").encode()).hexdigest(), len((h or "").encode())) for p, _, h, _ in PAGES)
    assert sorted((r["page_id"] or 0, r["payload_digest"], r["payload_bytes"]) for r in rows) == want
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in rows if r["record_type"] == "revisit")
    assert kinds == [(0, "revisit", 1), (2, "revisit", 1), (2, "revisit", 1)]
    assert pages_round_trip(pages.limit(0)).count() == 0


def test_arc_headers_of_both_versions_and_faults():
    two = arc_files.ARC_FIELDS[2]
    body = f"2 0 x\n{two}\n"
    data = f"filedesc://a 0.0.0.0 2000 text/plain {len(body)}\n{body}\n"
    data += "http://a/with blank 1.2.3.4 20010203040506 text/html 200 - - 0 f 5\nhello\n"
    body = f"1 0 x\n{arc_files.ARC_FIELDS[1]}\n"
    data += f"filedesc://b 0.0.0.0 2000 text/plain {len(body)}\n{body}\ndns:a 1.2.3.4 200102 text/dns 3\nabc\nhttp://b 1.1.1.1 20011301 text/html 99\nxy"
    rows = list(arc_files.arc_records("f", data.encode()))
    assert [r["warc_type"] for r in rows] == ["warcinfo", "resource", "warcinfo", "resource", "resource"]
    assert rows[1]["url"] == "http://a/with blank" and rows[1]["warc_date"] == "2001-02-03T04:05:06Z" and rows[1]["block"] == b"hello"
    assert rows[3]["warc_date"] == "2001-02-01T00:00:00Z" and rows[4]["error"] == "2 of 99 bytes"
    assert len({r["record_id"] for r in rows}) == 5
    assert [r["error"] for r in arc_files.arc_records("f", b"nonsense\n")] == ["header line without a length"]


def test_warc_blocks_may_be_any_bytes(spark, tmp_path):
    block = bytes(range(256)) * 3
    df = spark.createDataFrame([(bytearray(block), bytearray(b""))], "block binary, head binary").selectExpr(
        "'resource' warc_type", "'<urn:uuid:1>' record_id", "'2000-01-01T00:00:00Z' warc_date", "'u' url", "cast(null as string) ip",
        "cast(null as string) refers_to_id", "cast(null as string) refers_to_url", "cast(null as string) refers_to_date",
        "'application/octet-stream' content_type", "sha2(block, 256) payload_digest", "cast(null as string) error", "head", "block",
    )
    write_warc(df, str(tmp_path / "w"))
    row = read_warc(spark, str(tmp_path / "w")).first()
    assert row["digest_ok"] and row["payload_bytes"] == len(block)


def test_decontamination_finds_all_within_the_budget(spark, odd):
    bench = [(i, r["text"]) for i, r in enumerate(table(spark, SF, "benchmark").collect())]
    index = decontaminate.build_index(tuple((i, decontaminate.normal(t)) for i, t in bench))
    rng = random.Random(4)
    for _ in range(40):
        n = rng.randrange(len(index.texts))
        text = bytearray(index.texts[n])
        for _ in range(index.edits[n]):
            kind, at = rng.choice("sid"), rng.randrange(len(text))
            if kind == "s":
                text[at] = 120
            elif kind == "i":
                text.insert(at, 120)
            else:
                del text[at]
        whole = b"some words before " + bytes(text) + b" and after"
        hit = [h for h in decontaminate.find_items(index, [b"", whole]) if h[1] == index.ids[n]]
        assert hit and hit[0][0] == 1 and hit[0][2] <= index.edits[n]
    items = spark.createDataFrame([(1, bench[0][1]), (2, None), (3, " "), (4, "one"), (5, bench[0][1])], "item_id long, text string")
    more = odd.union(spark.createDataFrame([(50, "x " + bench[0][1].upper().replace(" ", "\n ") + " y", *[None] * 6)], DOCS))
    found = {(r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.contaminations(more, items).collect()}
    assert found == {(50, 1, 0), (3, 4, 0)}
    kept = decontaminate.keep_uncontaminated(more, items)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 4, 5, 6, 7]
    assert decontaminate.contaminations(odd, items.limit(0)).count() == 0


def test_banded_alignment_counts_edits():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row)

    rng = random.Random(8)
    for _ in range(150):
        a, b = (bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, n))) for n in (9, 14))
        got = decontaminate.banded_alignment(a, b, -len(a), len(a) + len(b) + 1, len(a))
        assert got[0] == slow(a, b) and 0 <= got[1] <= got[2] <= len(b)


def test_token_counts_equal_the_library(docs, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = token_counts.load(path)
    for df in (docs, odd):
        texts = {(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()}
        want = sorted((i or 0, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in texts)
        rows = {(r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(df, path).collect()}
        assert sorted(rows) == want
    counter = token_counts.PieceCounter(path, token_counts.whole_tokens(path))
    rng = random.Random(6)
    pool = [*map(chr, range(0x250)), *"ΣςİǅＡé́’“…™½日本한🙂", "<|endoftext|>", "'s", "'LL"]
    for _ in range(3_000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(1, 12)))
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_byte_bpe_equals_the_library(spark, docs, odd):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(7)
    pool = [*map(chr, range(0x250)), *"日本한🙂½²Ⅷ", "'s", "  ", "the", " and"]
    made = [(i, "".join(rng.choice(pool) for _ in range(rng.randrange(14)))) for i in range(300)]
    made += [(900, "a" * 5_000), (901, " " * 300 + "x"), (902, "é" * 32 + "%" * 100), (903, "<|endoftext|>")]
    for df in (docs.select("doc_id", "text"), odd.select("doc_id", "text", "line"), spark.createDataFrame(made, "doc_id long, text string")):
        want = []
        for r in df.collect():
            ids = library.encode_ordinary(r["text"] or "")
            want.append((r["doc_id"] or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
        got = [(r[0] or 0, *r[1:]) for r in byte_bpe.encode_documents(df, path, public_tokenizers.PATTERN).collect()]
        assert sorted(got) == sorted(want)
    assert byte_bpe.encode_documents(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


def slow_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    line, places, base, found = " ".join(words), [], set(), []
    for label, phrase in license_scan.BASE:
        parts = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        places += at
        base |= {label} if at else set()
    known = rules()
    for k, rule in enumerate(known):
        if rule.keyword in line:
            for m in re.finditer(rf"(?<![^ ])(?:{rule.pattern})(?![^ ])", line):
                start = line[: m.start()].count(" ")
                found.append((start, -start - m[0].count(" "), -rule.priority, k))
    kept = {
        d[3] for d in found
        if not any(e < d and e[0] <= d[0] and e[1] <= d[1] and e[2] <= d[2] for e in found)
    }
    score = max([0.95 if base else 0.0] + [known[k].confidence for k in kept])
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | {known[k].label for k in kept})), score)


def test_licenses_match_brute_force(spark, odd):
    assert all(any(a in r.keyword for a in ANCHORS) for r in rules()) and len(rules()) > 300
    parts = [r.pattern.replace("(?:", "").split(")")[0] for r in rules()]
    made = [(i, f"Foo {a}. bar {b} under the MIT License cc by-nc 4.0") for i, (a, b) in enumerate(zip(parts, parts[5:]))]
    made += [(900, "cc by nc " * 60), (901, "SPDX-License-Identifier: GPL-3.0-or-later"), (902, "é under the MIT-License")]
    for df in (odd.select("doc_id", "text", "line"), spark.createDataFrame(made, "doc_id long, text string"), table(spark, "/root/testdata/sf0.01", "documents")):
        want = sorted(((r["doc_id"] or 0, *slow_licenses(r["text"])) for r in df.select("doc_id", "text").collect()), key=str)
        assert sorted(((r[0] or 0, *r[1:]) for r in license_scan.scan_licenses(df).collect()), key=str) == want


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_minimax(spark, odd, docs, shards):
    for df in (docs.select("doc_id", "text"), odd, docs.select("doc_id", "text").union(docs.select("doc_id", F.lit("hot text " * 50)))):
        rows = shard_documents(df, shards).collect()
        assert len(rows) == df.count() and all(0 <= r["shard"] < shards for r in rows)
        size: dict[str, int] = {}
        for r in df.select("text").collect():
            key = hashlib.sha256((r["text"] or "").encode()).hexdigest()
            size[key] = size.get(key, 0) + len((r["text"] or "").encode()) + 1
        order = [size[k] for k in sorted(size)]

        def needed(capacity, order=order):
            count, held = 1, 0
            for s in order:
                if held + s > capacity:
                    count, held = count + 1, 0
                held += s
            return count

        best = next(c for c in sorted({sum(order[a:b]) for a in range(len(order)) for b in range(a + 1, len(order) + 1)}) if c >= max(order) and needed(c) <= shards) if len(order) < 60 else None
        totals = [0] * shards
        slots: list[list[int]] = [[] for _ in range(shards)]
        for r in rows:
            totals[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots)
        assert best is None or max(totals) == best
        assert needed(max(totals)) <= shards and (max(totals) == max(order) or needed(max(totals) - 1) > shards)
    assert shard_documents(odd.limit(0), shards).count() == 0
