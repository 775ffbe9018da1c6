"""Token counts with a whole-token shortcut.

Which vocabulary strings encode alone as one token is proved once, by running the merges on
every candidate. A pre-token among them counts one without merging; only the rest is merged,
each distinct string once per task's memory.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowferry.llm.tables import small_batches, sub_batches, tidy, worker_model

CACHED = 300_000
LONG_PIECE = 4_096


def byte_letters() -> dict[int, str]:
    """The letter that byte-level pre-tokenizers write for each byte: printable Latin-1 as itself, the rest from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return {b: chr(b) if b in plain else chr(next(spare)) for b in range(256)}


def load(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def whole_tokens(path: str, suffix: str = "</w>") -> frozenset[str]:
    """Pre-tokens proved to be one token: vocabulary strings with the word end whose merges end in themselves.

    At most as many as the vocabulary has. Strings that aren't whole UTF-8 can't be pre-tokens.
    """
    tokenizer = load(path)
    bytes_of = {letter: byte for byte, letter in byte_letters().items()}
    proved = []
    for token in tokenizer.get_vocab(with_added_tokens=False):
        if not token.endswith(suffix):
            continue
        letters = token.removesuffix(suffix)
        try:
            text = bytes(bytes_of[c] for c in letters).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if letters and len(tokenizer.model.tokenize(letters)) == 1:
            proved.append(text)
    return frozenset(proved)


class Counts(dict):
    """Pre-token to number of tokens: proved ones from the start, the rest merged when first met."""

    def __init__(self, path: str, proved: frozenset[str]) -> None:
        super().__init__()
        self.tokenizer = load(path)
        self.model, self.proved = self.tokenizer.model, proved
        self.letters = byte_letters()
        self.update(dict.fromkeys(proved, 1))

    def __missing__(self, piece: str) -> int:
        count = len(self.model.tokenize("".join(map(self.letters.__getitem__, piece.encode("utf-8")))))
        if len(piece) <= LONG_PIECE:
            if len(self) - len(self.proved) >= CACHED:
                self.clear()
                self.update(dict.fromkeys(self.proved, 1))
            self[piece] = count
        return count


class PieceCounter:
    """Counts the tokens of a text as the library does for this vocabulary's rules.

    The rules are fixed: NFC, white space as blanks, lower case letter by letter, then the matches
    of one pattern, the rest dropped. Texts with an added token's string, or with letters for
    which Python's tables may differ from the library's, go to the library itself.
    """

    def __init__(self, path: str, proved: frozenset[str]) -> None:
        self.counts = Counts(path, proved)
        self.tokenizer = self.counts.tokenizer
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        # Fixed value: the vocabulary file's pattern, in the classes of this module.
        self.pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
        # ASCII without the separators 1C to 1F (Python's white space, not the library's), Latin with its
        # accents, and general punctuation up to the arrows: classes that all tables share.
        self.plain = re.compile(r"[\x00-\x1b\x20-\x84\x86-\xa9\xab-\xb1\xb4-\xb8\xbb\xbf-ſ‐-‧‰-⁞₠-₿←-⏿]*")

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if (self.special and self.special.search(text)) or not self.plain.fullmatch(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return sum(map(self.counts.__getitem__, self.pieces.findall(text.lower())))


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    ``docs`` needs ``doc_id`` and ``text``; other columns aren't read. A null or empty text has no
    byte and no token. Added tokens' strings inside a text count as those tokens, none is added,
    nothing is cut. Repeated rows get equal counts; an empty table gives no rows. The proved
    pre-tokens are sent to the workers, at most the vocabulary's size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Callable[[Any], int] = worker_model(("tokens", path), lambda: PieceCounter(path, shared.value)).count
        for batch in batches:
            for part in sub_batches(batch, 256):
                counts = [counter(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = small_batches(docs.select("doc_id", size.alias("n_bytes"), "text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
