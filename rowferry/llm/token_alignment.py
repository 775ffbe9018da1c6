"""Alignment of two tokenizers over a corpus, through an inverted index of id pairs.

Tasks encode their texts with both tokenizers and link the tokens whose bytes overlap. For each
pair of ids a block of documents gives a compressed bitmap of the documents that hold the pair,
and one bitmap per further bit of how often they hold it. Spark adds the bitmaps' bits up over all
blocks, finds each id's best partners, and joins the scores to the postings, which carry them back
to their documents.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowferry.llm.byte_bpe import word_finder
from rowferry.llm.merging import Merges, WordTable, merge_rounds
from rowferry.llm.piece_bpe import PieceEncoder
from rowferry.llm.tables import small_batches, sub_batches, tidy, worker_model
from rowferry.llm.token_counts import byte_letters
from rowferry.storage import materialize

BLOCK_BYTES = 12_000_000  # of text; a longer text is a block of its own
BLOCK_DOCS = 1 << 16
OUT_ROWS = 20_000
DOC_BITS, ID_BITS = 16, 23

DOC_COLUMNS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
BLOCKS = f"block long, doc int, {DOC_COLUMNS}, a int, b int, plane int, docs long, bits binary"
_ARROW = pa.schema(
    [
        ("block", pa.int64()), ("doc", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
        ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("plane", pa.int32()), ("docs", pa.int64()),
        ("bits", pa.binary()),
    ]
)


class ByteEncoder:
    """Ids of texts by a byte-level BPE vocabulary file, with strings of special tokens as plain text."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        model, before = read["model"], read.get("pre_tokenizer") or {}
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if read.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not plain:
            raise ValueError("only byte-level BPE files without a normalizer are read")
        ids, letters = model["vocab"], byte_letters()
        self.by_byte = np.array([ids[letters[b]] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        rows = [(ids[a], ids[b], rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)]
        self.size = max(ids.values()) + 1
        self.merges = Merges(*zip(*rows, strict=True), width=self.size)
        byte_of = {letter: byte for byte, letter in letters.items()}
        entries = [b""] * self.size
        for entry, i in ids.items():
            entries[i] = bytes(byte_of[c] for c in entry) if set(entry) <= byte_of.keys() else b""
        self.entries = pa.array(entries, pa.binary())
        self.words = word_finder(pattern)
        self.table = WordTable(self._encode)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        data = [w.encode() for w in words]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        return merge_rounds(self.by_byte[np.frombuffer(b"".join(data), np.uint8)], sizes, self.merges)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.table.ids([self.words(t) for t in texts])


def _taken(pieces: pa.BinaryArray, numbers: np.ndarray) -> tuple[np.ndarray, memoryview]:
    """Chosen entries one after the other: where each starts, with the end, and their bytes."""
    if not len(numbers):
        return np.zeros(1, np.int64), memoryview(b"")
    _, offsets, data = (taken := pieces.take(pa.array(numbers))).buffers()
    places = np.frombuffer(offsets, np.int32, len(numbers) + 1, taken.offset * 4).astype(np.int64)
    return places, memoryview(data).cast("B") if data else memoryview(b"")  # unsigned, to be compared with bytes


class Aligner:
    """Both tokenizers, their entries' bytes and the decimal texts of their ids."""

    def __init__(self, path_a: str, pattern: str, path_b: str) -> None:
        self.a, self.b = ByteEncoder(path_a, pattern), PieceEncoder(path_b)
        self.pieces = [self.a.entries, pa.array(self.b.model.bytes_of(), pa.binary())]
        if max(map(len, self.pieces)) > 1 << ID_BITS:
            raise ValueError(f"ids must be below {1 << ID_BITS}")
        # The text of an id with the sign after it: within a group, or as the last of its side.
        texts = [f"{i}{sign}" for count, last in zip(map(len, self.pieces), "|;", strict=True) for i in range(count) for sign in (",", last)]
        self.texts = pa.array([t.encode() for t in texts], pa.binary())
        self.first_b = 2 * len(self.pieces[0])

    def _tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, byte lengths and numbers of tokens per text, of both sides; without tokens where the bytes differ."""
        source = [f" {t}".encode() if t else b"" for t in texts]
        sides = []
        same = np.ones(len(texts), bool)
        for encoder, pieces, given in ((self.a, self.pieces[0], [f" {t}" if t else "" for t in texts]), (self.b, self.pieces[1], texts)):
            flat, counts = encoder.ids(given)
            places, joined = _taken(pieces, flat)
            lengths, ends = np.diff(places), places[np.concatenate([[0], np.cumsum(counts)])].tolist()
            same &= [joined[x:y] == s for x, y, s in zip(ends[:-1], ends[1:], source, strict=True)]
            sides.append((flat, lengths, counts))
        if same.all():
            return sides
        return [(f[k := np.repeat(same, c)], n[k], np.where(same, c, 0)) for f, n, c in sides]

    def align(self, texts: list[str]) -> tuple[dict[str, np.ndarray | list], np.ndarray, np.ndarray, np.ndarray]:
        """Columns per text, and of each link its text and two ids."""
        (a, size_a, n_a), (b, size_b, n_b) = self._tokens(texts)
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        links = np.union1d(end_a, end_b)  # a link ends where a token of either side does
        in_a, in_b = np.searchsorted(end_a, links), np.searchsorted(end_b, links)
        groups = links[(end_a[in_a] == links) & (end_b[in_b] == links)]
        text_ends = np.concatenate([[0], end_a])[np.cumsum(n_a)]
        text = np.searchsorted(text_ends, links)
        many = len(texts)
        columns = {
            "n_a": n_a, "n_b": n_b, "n_links": np.bincount(text, minlength=many),
            "n_groups": np.bincount(np.searchsorted(text_ends, groups), minlength=many),
            "groups_sha256": self._digests(a, end_a, b, end_b, groups, n_a + n_b),
        }
        return columns, text, a[in_a], b[in_b]

    def _digests(self, a: np.ndarray, end_a: np.ndarray, b: np.ndarray, end_b: np.ndarray, groups: np.ndarray, counts: np.ndarray) -> list[str]:
        """Digest of each text's groups, ids of A, then of B, written in decimals."""
        group_a, group_b = np.searchsorted(groups, end_a), np.searchsorted(groups, end_b)
        numbers = np.arange(len(groups))
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.searchsorted(group_b, numbers)[group_a]] = 2 * a + np.isin(end_a, groups, assume_unique=True)
        order[np.arange(len(b)) + np.searchsorted(group_a, numbers, "right")[group_b]] = self.first_b + 2 * b + np.isin(end_b, groups, assume_unique=True)
        places, written = _taken(self.texts, order)
        ends = places[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [hashlib.sha256(written[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(ends, ends[1:])]


def _rows(count: int, **columns: pa.Array | list | np.ndarray) -> pa.RecordBatch:
    """A batch of the blocks' schema; columns that aren't given are null."""
    made = [
        columns[f.name] if isinstance(columns.get(f.name), pa.Array) else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(count, f.type)
        for f in _ARROW
    ]
    return pa.RecordBatch.from_arrays(made, schema=_ARROW)


def bitset_bytes(docs: int) -> int:
    return (docs + 7) // 8


def _plane(block: int, size: int, plane: int, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Bitmaps of one plane: ``keys`` are pair and document, sorted.

    A pair's documents are listed as two-byte numbers where that is shorter than a bit for each of the block's.
    """
    pair, doc = keys >> DOC_BITS, (keys & (1 << DOC_BITS) - 1).astype("<u2")
    starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    counts = np.diff(np.append(starts, len(pair)))
    width = bitset_bytes(size)
    listed = 2 * counts < width
    for chosen in (np.flatnonzero(listed), np.flatnonzero(~listed)):
        step = OUT_ROWS if len(chosen) and listed[chosen[0]] else max(1, min(OUT_ROWS, (32 << 20) // (8 * width)))
        for at in range(0, len(chosen), step):
            part = chosen[at : at + step]
            many = counts[part]
            offsets = np.concatenate([[0], np.cumsum(many)])
            docs = doc[np.repeat(starts[part] - offsets[:-1], many) + np.arange(offsets[-1])]
            if listed[part[0]]:
                ends, data = 2 * offsets, docs.tobytes()
            else:
                bits = np.zeros((len(part), 8 * width), bool)
                bits[np.repeat(np.arange(len(part)), many), docs] = True
                ends, data = width * np.arange(len(part) + 1), np.packbits(bits, axis=1, bitorder="little").tobytes()
            values = pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data)])
            ids = pair[starts[part]]
            yield _rows(
                len(part), block=np.full(len(part), block), a=(ids >> ID_BITS).astype(np.int32), b=(ids & (1 << ID_BITS) - 1).astype(np.int32),
                plane=np.full(len(part), plane, np.int32), docs=many, bits=values,
            )


def _postings(block: int, size: int, found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """All planes of a block, its parts' postings merged: plane 0 has every document of a pair, the next
    planes the binary digits of its links beyond the first."""
    keys = np.concatenate([k for k, _ in found])
    more = np.concatenate([m for _, m in found]) - 1
    order = np.argsort(keys)
    keys, more = keys[order], more[order]
    del order
    yield from _plane(block, size, 0, keys)
    plane = 1
    while (on := more > 0).any():
        keys, more = keys[on], more[on]
        odd = more & 1 == 1
        if odd.any():
            yield from _plane(block, size, plane, keys[odd])
        more, plane = more >> 1, plane + 1


def _blocks(path_a: str, pattern: str, path_b: str):
    """Texts to blocks: a row per text, then a row per pair and plane."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = worker_model(("aligned", path_a, path_b), lambda: Aligner(path_a, pattern, path_b))
        block, size, held, found = TaskContext.get().partitionId() << 32, 0, 0, []
        for batch in batches:
            for part in sub_batches(batch, 256):
                if size and (held >= BLOCK_BYTES or size + part.num_rows > BLOCK_DOCS):
                    yield from _postings(block, size, found) if found else ()
                    block, size, held, found = block + 1, 0, 0, []
                texts = [t or "" for t in part.column("text").to_pylist()]
                columns, text, a, b = aligner.align(texts)
                many = part.num_rows
                yield _rows(many, block=np.full(many, block), doc=np.arange(size, size + many, dtype=np.int32), doc_id=part.column("doc_id"), **columns)
                keys = (a.astype(np.int64) << ID_BITS | b) << DOC_BITS | (text + size)
                if len(keys):
                    found.append(np.unique(keys, return_counts=True))
                size, held = size + many, held + sum(map(len, texts))
        if found:
            yield from _postings(block, size, found)

    return run


def aligned_blocks(docs: DataFrame, path_a: str, pattern: str, path_b: str) -> DataFrame:
    """The inverted index of ``docs``, written to the shared folder: rows of documents (``a`` is null) and of postings.

    A block has its documents numbered from 0 and is as large as ``BLOCK_BYTES`` of text or
    ``BLOCK_DOCS`` documents, or one longer text; its bitmaps stand for those numbers.
    """
    rows = small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return materialize(rows.mapInArrow(tidy(_blocks(path_a, pattern, path_b)), BLOCKS), "alignment")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``a, b, n_docs, n_links, is_best`` of every linked pair of ids; best pairs have as many links as any of their ``b``.

    Plane 0 counts documents and their first links, the further planes the binary digits of the rest.
    One row per pair and block is added up, map-side first; the window over a ``b`` is no larger
    than the first vocabulary.
    """
    totals = (
        blocks.where("a is not null")
        .groupBy("a", "b")
        .agg(
            F.sum(F.when(F.col("plane") == 0, F.col("docs")).otherwise(0)).alias("n_docs"),
            F.sum(F.expr("shiftleft(docs, greatest(plane - 1, 0))")).alias("n_links"),
        )
    )
    return totals.withColumn("is_best", F.col("n_links") == F.max("n_links").over(Window.partitionBy("b")))


SCORED = f"{DOC_COLUMNS}, n_best long, count_sum long"


def _score_block(table: pa.Table) -> pa.Table:
    """One block's documents with the sums of the scores that its postings bring."""
    is_doc = pc.is_null(table["a"])
    docs, posts = table.filter(is_doc), table.filter(pc.invert(is_doc))
    size = docs.num_rows
    sums, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    width = bitset_bytes(size)
    for part in posts.to_batches(max_chunksize=max(1, min(OUT_ROWS, (32 << 20) // (8 * max(width, 1))))):
        many = part.column("docs").to_numpy()
        links = np.left_shift(1, np.maximum(part.column("plane").to_numpy().astype(np.int64) - 1, 0))
        weight = links * part.column("n_links").to_numpy()
        top = links * part.column("is_best").to_numpy(zero_copy_only=False)
        listed = 2 * many < width
        for chosen in (listed, ~listed):
            if not chosen.any():
                continue
            data = b"".join(part.column("bits").filter(pa.array(chosen)).to_pylist())
            if chosen is listed:
                rows, at = np.repeat(np.arange(chosen.sum()), many[chosen]), np.frombuffer(data, "<u2")
            else:
                rows, at = np.nonzero(np.unpackbits(np.frombuffer(data, np.uint8).reshape(-1, width), axis=1, bitorder="little", count=size))
            np.add.at(sums, at, weight[chosen][rows])
            np.add.at(best, at, top[chosen][rows])
    at = docs["doc"].to_numpy()
    return docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]).append_column("n_best", pa.array(best[at])).append_column(
        "count_sum", pa.array(sums[at])
    )


def align_documents(docs: DataFrame, path_a: str, pattern: str, path_b: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum`` for every row of ``docs``.

    ``docs`` needs ``doc_id`` and ``text``; other columns aren't read. A space and the text is encoded
    by the byte-level BPE file at ``path_a`` (``pattern`` cuts it into words), the text by the piece
    model at ``path_b``, which puts the space there itself; no special token is added or looked for.
    Tokens are linked where their bytes overlap, and grouped where tokens of both sides end. A null or
    empty text, and one whose tokens' bytes differ from the space and the text (as with a U+2581), has
    no tokens: its numbers are 0 and its digest is empty. Repeated rows count each time and get equal
    results; an empty table gives no rows. ``n_best`` are the links whose pair has the most links of
    its second id, ``count_sum`` adds up each link's count over the corpus. A block's postings meet
    in one task, at most a few MB; counts are exact whole numbers of 64 bits.
    """
    blocks = aligned_blocks(docs, path_a, pattern, path_b)
    scores = pair_counts(blocks).select("a", "b", "n_links", "is_best")
    posts = blocks.where("a is not null").select("block", "a", "b", "plane", "docs", "bits").join(scores, ["a", "b"])
    own = ["block", "doc", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    rows = blocks.where("a is null").select(*own, "n_links").unionByName(posts.drop("b"), allowMissingColumns=True)
    return rows.groupBy("block").applyInArrow(_score_block, SCORED)
