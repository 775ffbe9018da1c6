"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

Texts are split into words in tasks; the distinct words of a chunk of texts are folded by
ranked merges with ``aggregate`` over arrays of their bytes, each merge looked up in a
literal rank map; then each text's ids are put together from its words. No stage shuffles.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry.llm.tables import small_batches, sub_batches, tidy, worker_model

SLOTS = 1 << 16
CHUNK_BYTES = 4_000_000
BATCH_IDS = 250_000  # that go back to Spark at a time, or those of one longer text
KNOWN_WORDS = 450_000
TOGETHER = 24
FOLDED_BYTES = 64
PLACE_BITS = 6
PLACE_MASK = 63
SEED = 42  # of Spark's xxhash64
PLAN_TEXT = 100_000  # characters of a plan's text that Spark keeps


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings with their merge ranks, from a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def ranks_and_pieces(path: str) -> tuple[dict[bytes, int], pa.BinaryArray]:
    """The ranks, and each rank's bytes."""
    ranks = read_ranks(path)
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return ranks, pa.array(pieces, pa.binary())


def letter(rank: int) -> str:
    """One character that stands for a piece in Spark strings: beyond Latin-1, past the surrogates."""
    code = rank + 0x100
    return chr(code if code < 0xD800 else code + 0x800)


def word_letters(ranks: dict[bytes, int]) -> dict[int, str]:
    """``str.translate`` table from a byte (as a Latin-1 character) to its piece's letter."""
    return {b: letter(ranks[bytes([b])]) for b in range(256)}


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The rank of each mergeable pair of pieces as a literal map.

    It is split into slots by hash, because Spark searches a map literal in order.
    """
    slots: list[dict[str, int]] = [{} for _ in range(SLOTS)]
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if left is not None and right is not None:
                pair = letter(left) + letter(right)
                slots[xxhash.xxh64_intdigest(pair.encode(), SEED) % SLOTS][pair] = rank
    return F.from_json(F.lit(json.dumps(slots)), "array<map<string,int>>")


def first_merges(ranks: dict[bytes, int], count: int) -> Column:
    """The ``count`` merges of the smallest ranks, in order, as a literal array of pairs and letters."""
    rows = []
    for piece, rank in sorted((x for x in ranks.items() if len(x[0]) > 1), key=lambda x: x[1])[:count]:
        for cut in range(1, len(piece)):
            left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if left is not None and right is not None:
                rows.append({"pair": letter(left) + letter(right), "to": letter(rank)})
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<pair:string,to:string>>")


def fold_words(words: Column, ranks: dict[bytes, int]) -> Column:
    """Each word of an array, one letter per byte, as its merged pieces, one letter per piece.

    First the ``TOGETHER`` merges of the smallest ranks are folded, in order, over all words at once, joined
    to one string. Then each word goes on by itself: ``aggregate`` folds over as many steps as a word has pairs. A step looks up every pair of
    neighbours, takes the smallest rank with its first place, and merges that pair wherever it
    stands in the word, from the left; without a ranked pair the word stays. Ranks must be in merge
    order, as in any trained rank file: then no merge makes a pair of a smaller rank, and merging a
    pair everywhere at once is the same as one place after the other. A word has at most
    ``FOLDED_BYTES`` letters, because a place takes six bits of a number.
    """
    known = rank_literal(ranks)
    names = F.split(F.lit(",".join(letter(i) for i in range(max(ranks.values()) + 1))), ",")

    def rank(pair: Column) -> Column:
        return F.element_at(F.get(known, F.xxhash64(pair).bitwiseAND(F.lit(SLOTS - 1)).cast("int")), pair)

    def merged(word: Column, best: Column) -> Column:
        pair = F.substring(word, best.bitwiseAND(F.lit(PLACE_MASK)), F.lit(2))
        return F.coalesce(F.replace(word, pair, F.get(names, F.shiftright(best, PLACE_BITS))), word)

    def step(word: Column, _: Column) -> Column:
        places = F.sequence(F.lit(1), F.length(word) - 1)
        ranked = F.transform(places, lambda i: F.shiftleft(rank(F.substring(word, i, F.lit(2))), PLACE_BITS) + i)
        done = F.length(word) < 2
        return F.when(done, word).otherwise(F.get(F.transform(F.array(F.array_min(ranked)), lambda b: merged(word, b)), 0))

    joined = F.aggregate(first_merges(ranks, TOGETHER), F.array_join(words, ","), lambda s, m: F.replace(s, m["pair"], m["to"]))
    begun = F.when(F.size(words) > 0, F.split(joined, ",")).otherwise(words)
    return F.transform(begun, lambda w: F.when(F.length(w) < 2, w).otherwise(F.aggregate(F.sequence(F.lit(2), F.length(w)), w, step)))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one very long word, with a heap of pairs, so that time is not the square of its length."""
    if word in ranks:
        return [ranks[word]]
    ends = list(range(1, len(word) + 1))  # of the piece that starts here; 0 once merged away
    before = list(range(-1, len(word) - 1))

    def pair(a: int) -> tuple[int, int, int] | None:
        b = ends[a]
        if b >= len(word):
            return None
        rank = ranks.get(word[a : ends[b]])
        return None if rank is None else (rank, a, ends[b])

    heap = [x for a in range(len(word)) if (x := pair(a))]
    heapq.heapify(heap)
    while heap:
        _, a, end = heapq.heappop(heap)
        b = ends[a]
        if not b or b >= len(word) or ends[b] != end:
            continue
        ends[a], ends[b] = end, 0
        if end < len(word):
            before[end] = a
        for c in (before[a], a):
            if c >= 0 and (x := pair(c)):
                heapq.heappush(heap, x)
    out, at = [], 0
    while at < len(word):
        out.append(ranks[word[at : ends[at]]])
        at = ends[at]
    return out


CHUNK = "fresh boolean, doc_ids array<long>, ends array<int>, words array<string>, long_words array<string>, uses array<int>"


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for, and lists the new ones in ``new``."""

    new: list[str]

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        self.new.append(key)
        return number


#: ASCII without the separators 1C to 1F, Latin letters with accents, and general punctuation up to the
#: arrows: here ``re`` and the Unicode properties agree on letters, digits and white space.
_PLAIN = re.compile(r"[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u017f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u2190-\u23ff]*")
_PROPERTIES = {r"\p{L}": r"[^\W\d_]", r"\p{N}": r"\d", r"[^\s\p{L}\p{N}]": r"(?:[^\s\w]|_)"}


def word_finder(pattern: str):
    """All matches of a pattern in a text; plain texts take the standard module, which is faster."""
    whole = regex.compile(pattern).findall
    simple = pattern
    for name in sorted(_PROPERTIES, key=len, reverse=True):
        simple = simple.replace(name, _PROPERTIES[name])
    if r"\p" in simple:
        return whole
    quick = re.compile(simple).findall
    return lambda text: quick(text) if _PLAIN.fullmatch(text) else whole(text)


def _splitter(path: str, pattern: str):
    """Rows ``(doc_id, text)`` to chunks: their new words, and each text's word numbers.

    A task's chunks share one numbering, so a word is folded once per task; beyond ``KNOWN_WORDS``
    it starts again, with a ``fresh`` chunk. A word is written with one letter per byte; beyond
    ``FOLDED_BYTES`` it is empty and stands in ``long_words`` as it is, in the same order.
    """

    def run(batches):
        letters = worker_model(("letters", path), lambda: word_letters(read_ranks(path)))
        find = word_finder(pattern)
        number, new = Numbers(), []
        number.new, fresh = new, True
        ids, ends, uses, size = [], [], array("i"), 0

        def chunk():
            words = [b.decode("latin-1").translate(letters) if len(b := w.encode()) <= FOLDED_BYTES else "" for w in new]
            long_words = [w for w, coded in zip(new, words, strict=True) if not coded]
            used = pa.array(np.frombuffer(uses, np.int32) if len(uses) else np.zeros(0, np.int32))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([fresh]), pa.array([ids], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int32())),
                    pa.array([words], pa.list_(pa.string())), pa.array([long_words], pa.list_(pa.string())),
                    pa.ListArray.from_arrays(pa.array([0, len(used)], pa.int32()), used),
                ],
                ["fresh", "doc_ids", "ends", "words", "long_words", "uses"],
            )

        for batch in batches:
            for part in sub_batches(batch, 256):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                    value = text.as_py() or ""
                    uses.extend(map(number.__getitem__, find(value)))
                    ids.append(doc_id)
                    ends.append(len(uses))
                    size += len(value) + 16
                    if size >= CHUNK_BYTES:
                        made = chunk()  # the next stages work while this one waits, so its own copies go first
                        fresh = len(number) > KNOWN_WORDS
                        if fresh:
                            number.clear()
                        new.clear()
                        ids, ends, uses, size = [], [], array("i"), 0
                        yield made
                        del made
                        pa.default_memory_pool().release_unused()
        if ids:
            yield chunk()

    return run


def _letter_ranks(text: str) -> np.ndarray:
    """The ranks of a string of letters."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    return np.where(codes < 0xD800, codes, codes - 0x800).astype(np.int32) - np.int32(0x100)


def _encoded(doc_ids: pa.Array, ends: np.ndarray, ids: np.ndarray, pieces: pa.BinaryArray, packed: bool, decoded: bool) -> pa.RecordBatch:
    """One row per text, of its ids and its decoded bytes; ``ends`` are those of the texts' ids, after a 0."""
    if packed:
        data = ids.astype("<i4", copy=False).tobytes()
        rows = pa.BinaryArray.from_buffers(pa.binary(), len(doc_ids), [None, pa.py_buffer((ends * 4).astype(np.int32).tobytes()), pa.py_buffer(data)])
    else:
        rows = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
    if not decoded:
        return pa.RecordBatch.from_arrays([doc_ids, rows], ["doc_id", "ids"])
    bytes_of = pieces.take(pa.array(ids))
    _, offsets, data = bytes_of.buffers()
    at = np.frombuffer(offsets, np.int32, len(ids) + 1, bytes_of.offset * 4)[ends] if len(ids) else np.zeros(len(ends), np.int32)
    texts = pa.BinaryArray.from_buffers(pa.binary(), len(doc_ids), [None, pa.py_buffer(at.tobytes()), data if data is not None else pa.py_buffer(b"")])
    return pa.RecordBatch.from_arrays([doc_ids, rows, texts], ["doc_id", "ids", "decoded"])


def _assembler(path: str, packed: bool, decoded: bool):
    """Chunks with each word's pieces to one row per text."""

    def run(batches):
        ranks, pieces = worker_model(("ranks", path), lambda: ranks_and_pieces(path))
        flat, counts, firsts = (np.zeros(0, np.int32),) * 3
        for batch in batches:
            for row in range(batch.num_rows):
                if batch.column("fresh")[row].as_py():
                    flat, counts, firsts = (np.zeros(0, np.int32),) * 3
                doc_ids, ends = (batch.column(c)[row].values for c in ("doc_ids", "ends"))
                uses = batch.column("uses")[row].values.to_numpy()
                coded = batch.column("coded")[row].values
                many = pc.utf8_length(coded).to_numpy(zero_copy_only=False).astype(np.int32)
                parts = [_letter_ranks("".join(coded.to_pylist()))]
                starts = np.cumsum(many, dtype=np.int32) - many
                size = parts[0].size
                for at, word in zip(np.flatnonzero(many == 0), batch.column("long_words")[row].as_py(), strict=True):
                    parts.append(np.array(merge_long(word.encode(), ranks), np.int32))
                    starts[at], many[at] = size, parts[-1].size
                    size += parts[-1].size
                own = np.concatenate(parts)
                firsts = np.concatenate([firsts, starts + np.int32(flat.size)])
                counts = np.concatenate([counts, many])
                flat = np.concatenate([flat, own])
                word_ends = np.concatenate([[0], ends.to_numpy()])
                id_ends = np.concatenate([[0], np.cumsum(counts[uses], dtype=np.int32)])[word_ends]
                first = 0
                while first < len(ends):
                    last = max(first + 1, int(np.searchsorted(id_ends, id_ends[first] + BATCH_IDS, "right")) - 1)
                    used = uses[word_ends[first] : word_ends[last]]
                    many = counts[used]
                    shift = firsts[used] - (np.cumsum(many, dtype=np.int32) - many)
                    ids = flat[np.repeat(shift, many) + np.arange(id_ends[last] - id_ends[first], dtype=np.int32)]
                    yield _encoded(doc_ids.slice(first, last - first), id_ends[first : last + 1] - id_ends[first], ids, pieces, packed, decoded)
                    first = last
                del coded, uses, parts, own
                pa.default_memory_pool().release_unused()

    return run


def encoded_chunks(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Chunks of texts with their distinct words and ``coded``, the pieces of each word as letters.

    Words beyond ``FOLDED_BYTES`` are empty in ``coded`` and listed in ``long_words``.
    """
    chunks = small_batches(docs.select("doc_id", "text")).mapInArrow(tidy(_splitter(path, pattern)), CHUNK)
    return chunks.withColumn("coded", fold_words(F.col("words"), read_ranks(path))).drop("words")


def encode_texts(docs: DataFrame, path: str, pattern: str, *, packed: bool = False, decoded: bool = True) -> DataFrame:
    """``doc_id, ids, decoded`` for every row of ``docs``: its token ids, and the bytes they decode to.

    ``docs`` needs ``doc_id`` and ``text``; other columns aren't read. Each match of ``pattern`` is
    encoded by itself with the ranks of the file at ``path``; no special token is added or looked
    for. A null or empty text has no id and no byte. Repeated rows get equal results; an empty
    table gives no rows. ``packed`` gives ids as little-endian numbers of four bytes in one binary
    value; ``decoded=False`` leaves the decoded bytes out. A task holds one chunk of about
    ``CHUNK_BYTES`` at a time, or one longer text. The rank map is part of the plan, so the session's
    limit on the texts that Spark keeps of plans is lowered to ``PLAN_TEXT``.
    """
    conf = docs.sparkSession.conf
    if _bytes(conf.get("spark.sql.maxPlanStringLength")) > PLAN_TEXT:
        conf.set("spark.sql.maxPlanStringLength", str(PLAN_TEXT))
    schema = f"doc_id long, ids {'binary' if packed else 'array<int>'}" + (", decoded binary" if decoded else "")
    return encoded_chunks(docs, path, pattern).mapInArrow(tidy(_assembler(path, packed, decoded)), schema)


def _bytes(setting: str) -> int:
    """A setting of a size, with its unit if it has one."""
    number = setting.lower().rstrip("b")
    unit = "kmgt".find(number[-1]) + 1
    return int(number[:-1]) << 10 * unit if unit else int(number)


def token_digests(encoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of the ``packed`` rows of ``encode_texts``.

    Ids are digested as little-endian numbers of four bytes; without ids both digests are those of no bytes.
    """
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``token_digests`` of ``encode_texts``: what to compare encodings by without keeping them."""
    return token_digests(encode_texts(docs, path, pattern, packed=True))
