"""Merge rounds, the piece model, alignment of two tokenizers and collocations against libraries and brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rowferry.llm import collocations, merging, piece_bpe, token_alignment
from rowferry.llm.queries import QUERIES, SQL
from rowferry.llm.tables import table
from rowferry.llm.token_counts import byte_letters
from tests.oracle import database, differences

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, ids long, block string, phrase string, n long"
ODD = [
    (None, "no id", "en", 1, "x", "y", 2), (1, None, None, None, None, None, None), (2, "", "en", 1, "", "", 1), (3, " ", "en", 1, "", "", 1),
    (4, "  a  b\t\n ", "en", 1, "", "", 1), (4, "  a  b\t\n ", "en", 1, "", "", 1), (5, "▁x ▁", None, 1, "", "", 1),
    (6, "</s><|endoftext|><0x0A>", "en", 1, "", "", 1), (7, "日本 \x00😀 é é", "en", 1, "", "", 1), (8, "word a " * 40_000, "en", 1, "", "", 1),
    (9, "ab" * 3_000 + " " * 300 + "x", "en", 1, "", "", 1),
]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    letters = list("abcdethe  ▁\n.é日́😀<>0x") + ["the", "   ", "　"]
    rows = [(100 + i, "".join(rng.choice(letters) for _ in range(rng.randrange(50))), rng.choice(["en", "de", None]), 1, "", "", 1) for i in range(400)]
    docs = table(spark, SF, "documents").selectExpr("doc_id + 1000", "text", "lang", "1L", "''", "''", "1L")
    return spark.createDataFrame(ODD + rows, DOCS).repartition(3).union(docs)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_merge_rounds_equal_single_merges():
    rng = np.random.default_rng(7)
    for case in range(60):
        # Any table of pairs, ranks with ties and out of order, so that words must be merged again one by one too.
        width, pairs = 12, [(a, b) for a in range(12) for b in range(12) if rng.random() < 0.3]
        rows = [(a, b, int(rng.integers(0, 8 if case % 2 else 99)), int(rng.integers(0, 12))) for a, b in pairs]
        merges = merging.Merges(*zip(*rows, strict=True), width=width)
        sizes = rng.integers(0, 12, 50)
        symbols = rng.integers(0, 12, sizes.sum()).astype(np.int32)
        flat, made = merging.merge_rounds(symbols, sizes, merges)
        words = [merges.one_by_one(list(map(int, w))) for w in np.split(symbols, np.cumsum(sizes)[:-1])]
        assert made.tolist() == [len(w) for w in words]
        assert flat.tolist() == [s for w in words for s in w]


def test_single_merges_take_the_smallest_then_the_leftmost():
    merges = merging.Merges([0, 0, 2], [0, 1, 1], [5, 3, 9], [2, 3, 4], 5)
    assert merges.one_by_one([0, 0, 0, 1]) == [2, 3]
    assert merges.one_by_one([0, 0, 0]) == [2, 0]
    assert merges.one_by_one([]) == []


def test_pieces_equal_the_library(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = Counter()
    for r in texts.select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        rows[r["doc_id"], np.array(ids, "<u4").tobytes(), library.decode(ids)] += 1
    found = piece_bpe.encode_pieces(texts, MODEL)
    assert Counter((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in found.collect()) == rows
    digests = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in piece_bpe.piece_digests(found).collect())
    assert digests == Counter((d, len(i) // 4, sha(i), sha(t.encode())) for d, i, t in rows.elements())
    assert piece_bpe.encode_pieces(texts.limit(0), MODEL).count() == 0
    assert QUERIES["op13_piece_bpe"](spark, SF).count() == table(spark, SF, "documents").count()


def test_word_table_starts_again():
    encoder = piece_bpe.PieceEncoder(MODEL)
    encoder.table.most = 5
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for at in range(0, 60, 3):
        given = [f"word{i} other {i * i}" for i in range(at, at + 3)]
        flat, counts = encoder.ids(given)
        assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == library.encode(given)


def test_other_models_are_refused(tmp_path):
    unigram = tmp_path / "unigram.model"
    with open(MODEL, "rb") as file:
        data = file.read()
    unigram.write_bytes(data.replace(b"\x18\x02\x20\x80\xfa\x01", b"\x18\x01\x20\x80\xfa\x01", 1))
    assert unigram.read_bytes() != data
    with pytest.raises(ValueError, match="only BPE"):
        piece_bpe.PieceModel(str(unigram))


def aligned_plainly(rows):
    """The contract's columns, document by document."""
    first, second = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    first.encode_special_tokens = True
    byte_of = {c: b for b, c in byte_letters().items()}
    bytes_a = {i: bytes(byte_of[c] for c in t) for t, i in first.get_vocab(with_added_tokens=False).items()}
    entries = [second.id_to_piece(i) for i in range(second.get_piece_size())]
    bytes_b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(entries)]
    links, per_doc = Counter(), []
    for doc_id, text in rows:
        source = f" {text}".encode() if text else b""
        a, b = (first.encode(f" {text}", add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
        if b"".join(bytes_a[i] for i in a) != source or b"".join(bytes_b[i] for i in b) != source:
            a, b = [], []
        ends_a, ends_b = ([*np.cumsum([len(by[i]) for i in ids])] for ids, by in ((a, bytes_a), (b, bytes_b)))
        own = [
            (x, y) for i, (x, e) in enumerate(zip(a, ends_a, strict=True)) for j, (y, f) in enumerate(zip(b, ends_b, strict=True))
            if (ends_a[i - 1] if i else 0) < f and (ends_b[j - 1] if j else 0) < e
        ] if len(a) < 400 else list(sweep(a, ends_a, b, ends_b))
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            i, j = p, q
        links.update(own)
        per_doc.append((doc_id, len(a), len(b), len(groups), own, sha(";".join(groups).encode()) if a else ""))
    best = defaultdict(int)
    for (_, y), n in links.items():
        best[y] = max(best[y], n)
    return Counter((d, n, m, g, len(own), h, sum(links[p] == best[p[1]] for p in own), sum(links[p] for p in own)) for d, n, m, g, own, h in per_doc), links


def sweep(a, ends_a, b, ends_b):
    i = j = 0
    while i < len(a):
        yield a[i], b[j]
        end = min(ends_a[i], ends_b[j])
        i, j = i + (ends_a[i] == end), j + (ends_b[j] == end)


@pytest.mark.parametrize("block_docs", [1 << 16, 300])
def test_alignment_matches_document_by_document(spark, texts, monkeypatch, block_docs):
    monkeypatch.setattr(token_alignment, "BLOCK_DOCS", block_docs)
    want, links = aligned_plainly([(r["doc_id"], r["text"]) for r in texts.select("doc_id", "text").collect()])
    found = token_alignment.align_documents(texts, BYTES, public_tokenizers.PATTERN, MODEL)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert found.columns == columns
    assert Counter(tuple(r[c] for c in columns) for r in found.collect()) == want
    pairs = token_alignment.pair_counts(token_alignment.aligned_blocks(texts, BYTES, public_tokenizers.PATTERN, MODEL)).collect()
    assert {(r["a"], r["b"]): r["n_links"] for r in pairs} == links
    assert all(0 < r["n_docs"] <= r["n_links"] for r in pairs)
    assert token_alignment.align_documents(texts.limit(0), BYTES, public_tokenizers.PATTERN, MODEL).count() == 0


def test_planes_hold_documents_and_multiplicities():
    rng = np.random.default_rng(1)
    size, want = 500, {}
    for pair, share in ((3, 0.9), (4, 0.02), (9, 0.5)):
        docs = np.flatnonzero(rng.random(size) < share)
        want |= {(pair, int(d)): int(rng.integers(1, 40)) for d in docs}
    parts = [[(k, n) for k, n in want.items() if (k[1] < 250) == low] for low in (True, False)]  # two parts of a block
    found = [(np.array([p << token_alignment.DOC_BITS | d for (p, d), _ in part]), np.array([n for _, n in part])) for part in parts]
    got = Counter()
    for batch in token_alignment._postings(0, size, found):
        for r in batch.to_pylist():
            listed = 2 * r["docs"] < token_alignment.bitset_bytes(size)
            bits = np.frombuffer(r["bits"], "<u2") if listed else np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little"))
            assert len(bits) == r["docs"]
            got.update({(r["b"], int(d)): 1 << max(r["plane"] - 1, 0) for d in bits})
    assert got == want


def mined_plainly(rows, first, fewest, percent=100):
    lower, runs, words = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))), Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").encode().translate(lower).decode()):
            w = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(w)
            runs.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    candidates = {k: n for k, n in runs.items() if len(k[1]) > 1 and n >= fewest}
    inside = {
        (lang, w[i : i + m]) for (lang, w), n in candidates.items() for m in range(2, len(w)) for i in range(len(w) - m + 1)
        if 100 * n >= percent * runs[lang, w[i : i + m]]
    }
    ranked = defaultdict(list)
    for (lang, w), a in candidates.items():
        if (lang, w) not in inside:
            score, k = min((1000 * a * words[lang] // (runs[lang, w[:k]] * runs[lang, w[k:]]), k) for k in range(1, len(w)))
            ranked[lang].append((-score, -a, " ".join(w).encode(), runs[lang, w[:k]], runs[lang, w[k:]]))
    return {(lang, i + 1, p.decode(), -a, l, r, words[lang], -s) for lang, rows in ranked.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:first])}


@pytest.mark.parametrize(("first", "fewest", "percent"), [(2000, 20, 100), (7, 5, 100), (300, 10, 80)])
def test_collocations_match_counting_everything(spark, texts, first, fewest, percent):
    rng = random.Random(fewest)
    words = ["a", "A", "b", "é", "É", "c d", "e\tf", "g.h", "i\x0bj", "k\x00", "\x1c", "　", "日本"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randrange(30))), rng.choice(["en", None, "und", "de"])) for _ in range(300)]
    docs = texts.select("text", "lang", "phrase", "n").union(spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "'clash'", "1L"))
    given = [(r["text"], r["lang"]) for r in docs.select("text", "lang").collect()]
    found = {tuple(r) for r in collocations.collocations(docs, first, fewest, percent).collect()}
    assert found == mined_plainly(given, first, fewest, percent)
    assert collocations.collocations(docs.limit(0), first, fewest).count() == 0


def test_collocations_match_their_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = database(folder)
    assert differences(QUERIES["op12_phrase_collocations"](spark, folder), con, SQL["op12_phrase_collocations"]) == []


def test_phrases_that_share_a_fingerprint_come_apart(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefg") * rng.randrange(1, 3) for _ in range(40)).encode() + b"\n" for _ in range(30)]
    block = collocations.Block(texts, [i % 2 for i in range(30)], ["x", "y"])
    whole = collocations.Block.runs
    for size in (1, 3):
        at = block.places(size)
        want = Counter((int(block.words.lang[i]), block.words.phrase(i, size)) for i in at.tolist())
        for weak in (whole, lambda self, at, size: whole(self, at, size) & np.uint64(7)):
            monkeypatch.setattr(collocations.Block, "runs", weak)
            prints, checks, counts, pointers = block.counted(at, size)
            assert len(set(zip(prints.tolist(), checks.tolist(), strict=True))) == len(prints)
            assert sorted(counts.tolist()) == sorted(want.values())
            for n, p, place in zip(prints.tolist(), checks.tolist(), pointers.tolist(), strict=True):
                there = (block.runs(at, size) == n) & (block.checks(at, size) == p)
                assert place in block.pointers(at[there])
    monkeypatch.setattr(collocations.Block, "checks", lambda self, at, size: np.zeros(len(at), np.int32))
    with pytest.raises(ValueError, match="same fingerprints"):
        block.counted(block.places(1), 1)


def test_runs_leave_tasks_added_up_and_packed(monkeypatch):
    rng = np.random.default_rng(3)
    prints, checks = rng.integers(0, 1 << 63, 3_000), rng.integers(0, 1 << 31, 3_000).astype(np.int32)
    prints[:10] = prints[10:20]  # of equal first fingerprints, the second tells them apart
    parts, want = [], defaultdict(list)
    for _ in range(4):
        some = rng.permutation(3_000)[:2_000]
        some = some[np.lexsort((checks[some], prints[some]))]
        parts.append((prints[some], checks[some], rng.integers(1, 90, 2_000), rng.integers(0, 1 << 16, 2_000)))
        for p, c, n, at in zip(*(x.tolist() for x in parts[-1]), strict=True):
            want[p, c].append((n, at))
    runs = collocations.added_up(parts)
    found = {(p, c): (n, at) for p, c, n, at in zip(*(x.tolist() for x in runs), strict=True)}
    assert found == {k: (sum(n for n, _ in v), min(at for _, at in v)) for k, v in want.items()}
    data = collocations.packed(runs)
    assert len(data) == collocations.RUN_BYTES * len(runs[0])
    assert all((a == b).all() for a, b in zip(collocations.unpacked(data), runs, strict=True))
    batches = list(collocations._grouped(runs, 9))
    again = collocations.added_up([collocations.unpacked(d.as_py()) for b in batches for d in b.column("runs")])
    assert all((a == b).all() for a, b in zip(again, runs, strict=True))
    words = " ".join("abcdefg"[i] for i in rng.integers(0, 7, 4_000))
    batches = [pa.RecordBatch.from_pydict({"text": [words[i : i + 400]], "lang": ["a"]}) for i in range(0, len(words), 400)]
    every, totals = SimpleNamespace(value=[(0, b"\xff" * (1 << collocations.FILTER_BITS - 3))]), []
    for held, size in ((1 << 20, 4 << 20), (50, 600)):
        monkeypatch.setattr(collocations, "HELD", held)
        monkeypatch.setattr(collocations, "BLOCK_BYTES", size)
        left = [d.as_py() for b in collocations._counter(1, (1, 2), every, 9)(batches) for d in b.column("runs")]
        totals.append((len(left), [c.tolist() for c in collocations.added_up([collocations.unpacked(d) for d in left])]))
    # Which place is pointed to depends on the blocks.
    assert totals[0][1][:3] == totals[1][1][:3] and totals[0][0] < totals[1][0]


def test_phrases_are_written_in_passes(spark, monkeypatch):
    docs = table(spark, SF, "documents")
    want = {tuple(r) for r in collocations.frequent_phrases(docs, 30).collect()}
    monkeypatch.setattr(collocations, "WRITTEN", 200)
    assert {tuple(r) for r in collocations.frequent_phrases(docs.repartition(5), 30).collect()} == want


def test_long_texts_are_cut_at_breaks(monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 50)
    text = "one two three. four five, " * 20 + "x" * 200 + ";tail"
    batch = pa.RecordBatch.from_pydict({"text": [text, None, ""], "lang": ["a", "a", "a"]})
    blocks = list(collocations._blocks([batch]))
    assert len(blocks) > 5
    pieces = [[b.words.phrase(i, 1).decode() for i in range(len(b.words))] for b in blocks]
    assert [w for p in pieces for w in p] == re.split(r"[ ,.;]+", text)
    assert sum(len(b.places(3)) for b in blocks) == 20
