"""Encoding and decoding with a SentencePiece BPE model, by merge rounds over arrays.

Texts are cut into words where no piece of the vocabulary can cross; the words that a worker
hasn't met yet are merged together, as flat arrays of symbols. One pass over the texts, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowferry.llm.merging import Keys, Merges, WordTable, merge_rounds
from rowferry.llm.tables import small_batches, sub_batches, tidy, worker_model

# The library's blank, its kinds of pieces, and the kind of model that merges by score.
BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte, at = data[at], at + 1
        value |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a message in the model file's wire format."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if tag & 7 == 2 else (4 if tag & 7 == 5 else 8, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class PieceModel:
    """Pieces, scores and rules of a model file. Rules that this module does not follow are refused."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            parts = list(_fields(file.read()))
        trainer, rules = (dict(_fields(next((v for f, v in parts if f == n), b""))) for n in (2, 3))
        entries = [dict(_fields(v)) for f, v in parts if f == 1]
        self.pieces = [e[1].decode() for e in entries]
        self.kinds = [e.get(3, NORMAL) for e in entries]
        self.scores = [np.frombuffer(e.get(2, bytes(4)), "<f4")[0] for e in entries]
        # Field numbers: model type, byte fallback, blanks after words; rules' map, dummy prefix, extra blanks, escapes.
        same = trainer.get(3, 1) == BPE and trainer.get(35, 0) == 1 and not trainer.get(24, 0)
        same &= not rules.get(2) and rules.get(3, 1) == 1 and rules.get(4, 1) == 0 and rules.get(5, 1) == 1
        if not same or set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE} or self.kinds.count(BYTE) != 256:
            raise ValueError("only BPE models with byte fallback, a dummy prefix and unchanged text are read")
        self.bos, self.eos = trainer.get(41, 1), trainer.get(42, 2)

    def bytes_of(self) -> list[bytes]:
        """What each id decodes to, before the first blank goes."""
        out = []
        for piece, kind in zip(self.pieces, self.kinds, strict=True):
            if kind == BYTE:
                out.append(bytes([int(piece[3:5], 16)]))
            else:
                out.append({CONTROL: b"", UNKNOWN: " ⁇ ".encode()}.get(kind, piece.replace(BLANK, " ").encode()))
        return out


class PieceEncoder:
    """Ids of texts, without begin and end."""

    def __init__(self, path: str) -> None:
        self.model = model = PieceModel(path)
        count = len(model.pieces)
        ids = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == NORMAL}
        self.first_code = count  # a letter that is no piece has the symbol of its code above this
        self.symbols = np.arange(0x110000, dtype=np.int32) + np.int32(count)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.symbols[ord(piece)] = i
        self.byte_ids = np.zeros(256, np.int32)
        for i, (piece, kind) in enumerate(zip(model.pieces, model.kinds, strict=True)):
            if kind == BYTE:
                self.byte_ids[int(piece[3:5], 16)] = i
        order = {s: r for r, s in enumerate(sorted({model.scores[i] for i in ids.values()}, reverse=True))}

        def symbol(part: str) -> int | None:
            return int(self.symbols[ord(part)]) if len(part) == 1 else ids.get(part)

        pairs = [
            (left, right, order[model.scores[i]], i)
            for piece, i in ids.items()
            for cut in range(1, len(piece))
            if (left := symbol(piece[:cut])) is not None and (right := symbol(piece[cut:])) is not None
        ]
        self.merges = Merges(*zip(*pairs, strict=True), width=count + 0x110000) if pairs else Merges([], [], [], [], count + 0x110000)
        neighbours = {ord(a) << 21 | ord(b) for piece in ids for a, b in zip(piece, piece[1:])}
        self.neighbours = Keys(np.array(sorted(neighbours), np.int64))
        self.by_words = not any(a != BLANK and b == BLANK for piece in ids for a, b in zip(piece, piece[1:]))
        self.table = WordTable(self._encode)

    def words(self, text: str | None) -> list[str]:
        """The words of a text, each without the blank before it; together they are the text.

        No piece has a blank after another letter, so nothing merges across; otherwise a text is one word.
        """
        if not text:
            return []
        text = text.replace(BLANK, " ")
        if not self.by_words:
            return [text]
        words = text.split(" ")
        if "" in words:
            words = [w[1:] for w in re.findall(r" +[^ ]*", f" {text}")]
        return words

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words and their numbers; each word gets its blank back."""
        text = BLANK + BLANK.join(words).replace(" ", BLANK) if words else ""
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        firsts = np.zeros(len(codes), bool)
        firsts[np.cumsum(sizes) - sizes] = True
        if len(codes) > 1:  # a word is cut again where its letters are neighbours in no piece
            key = codes[:-1] << 21 | codes[1:]
            firsts[1:] |= self.neighbours.find(key) < 0
        parts = np.flatnonzero(firsts)
        flat, counts = merge_rounds(self.symbols[codes], np.diff(np.append(parts, len(codes))), self.merges)
        lengths = np.add.reduceat(counts, np.searchsorted(parts, np.cumsum(sizes) - sizes)) if len(words) else counts
        return self._fall_back(flat, lengths)

    def _fall_back(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Letters that are no piece become the ids of their UTF-8 bytes."""
        codes = flat - self.first_code
        many = np.where(codes < 0, 1, 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)).astype(np.int64)
        if not (codes >= 0).any():
            return flat, lengths
        ends = np.cumsum(many)
        wide, codes, place = np.repeat(many, many), np.repeat(codes, many), np.arange(ends[-1]) - np.repeat(ends - many, many)
        code = np.maximum(codes, 0)
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[wide] | code >> 6 * (wide - 1)
        byte = np.where(place == 0, lead, 0x80 | code >> 6 * (wide - 1 - place) & 0x3F)
        out = np.where(codes < 0, np.repeat(flat, many), self.byte_ids[byte & 0xFF])
        word_ends = np.cumsum(lengths)
        return out.astype(np.int32), np.diff(np.concatenate([[0], np.concatenate([[0], ends])[word_ends]]))

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """``(flat ids, ids of each text)``."""
        return self.table.ids([self.words(t) for t in texts])


class PieceCodec:
    """Rows of ids between begin and end, and what they decode to."""

    def __init__(self, path: str) -> None:
        self.encoder = PieceEncoder(path)
        model = self.encoder.model
        self.begin, self.end = model.bos, model.eos
        self.pieces = pa.array(model.bytes_of(), pa.binary())

    def framed(self, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids with begin and end around each text's, and where each text's end, after a 0."""
        ends = np.concatenate([[0], np.cumsum(counts + 2)])
        out = np.empty(ends[-1], np.int32)
        inner = np.ones(len(out), bool)
        inner[ends[:-1]] = inner[ends[1:] - 1] = False
        out[ends[:-1]], out[ends[1:] - 1], out[inner] = self.begin, self.end, flat
        return out, ends

    def decoded(self, ids: np.ndarray, ends: np.ndarray) -> pa.StringArray:
        """Each text's pieces joined, less the blank that encoding puts first."""
        whole = self.pieces.take(pa.array(ids))
        _, offsets, data = whole.buffers()
        at = np.frombuffer(offsets, np.int32, len(ids) + 1, whole.offset * 4)[ends].astype(np.int64)
        chars = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        full = np.flatnonzero(np.diff(at) > 0)
        blank = full[chars[at[full]] == 0x20]
        keep = np.ones(int(at[-1]), bool)
        keep[at[blank]] = False
        sizes = np.diff(at)
        sizes[blank] -= 1
        new = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(new.tobytes()), pa.py_buffer(chars[: len(keep)][keep].tobytes()))


def encode_pieces(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, decoded`` for every row of ``docs``, by the model at ``path``.

    ``docs`` needs ``doc_id`` and ``text``; other columns aren't read. ``ids`` holds begin, the text's
    ids and end as little-endian numbers of four bytes; ``decoded`` is the text of those ids (a U+2581
    in a text comes back as a blank, as the library has it). A null or empty text has begin and end
    only and decodes to an empty text. Repeated rows get equal results; an empty table gives no rows.
    A task holds a few hundred texts at a time, or one longer text, and a bounded table of words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_model(("pieces", path), lambda: PieceCodec(path))
        for batch in batches:
            for part in sub_batches(batch, 256):
                ids, ends = codec.framed(*codec.encoder.ids(part.column("text").to_pylist()))
                rows = pa.BinaryArray.from_buffers(
                    pa.binary(), part.num_rows,
                    [None, pa.py_buffer((ends * 4).astype(np.int32).tobytes()), pa.py_buffer(ids.astype("<i4", copy=False).tobytes())],
                )
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), rows, codec.decoded(ids, ends)], ["doc_id", "ids", "decoded"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(tidy(run), "doc_id long, ids binary, decoded string")


def piece_digests(encoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of the rows of ``encode_pieces``."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
