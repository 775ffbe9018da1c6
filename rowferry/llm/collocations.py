"""Phrases whose words stand together more often than their parts would: mining by fingerprints.

Prefix polynomials over a block's bytes give each word two fingerprints, and prefix polynomials over
those give two to every run of words. What crosses the network are fingerprints with their counts and
with a pointer to one occurrence, added up and packed per task and group of fingerprints; longer runs are
counted only where all shorter runs inside may be frequent. Inside a block the places of a fingerprint are held against each other; between blocks the
second one tells runs apart. Text is written once, for frequent runs alone, at the places pointed to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowferry.llm.tables import small_batches, tidy
from rowferry.storage import materialize

LONGEST = 5
FEWEST = 100
FIRST = 2_000
UNKNOWN = "und"
BLOCK_BYTES = 4 << 20  # of text; a longer piece without a break is a block of its own
FILTER_BITS = 27  # of a filter of frequent fingerprints: 16 MB, whatever the corpus
WRITTEN = 1 << 24  # frequent runs that one pass over the texts writes out
POINTER_SHIFT = FILTER_BITS - 16
SALTS = 16
HELD = 1 << 20  # runs that a task adds up before they leave it
GROUP_WORDS = 1 << 19  # of the corpus for each group of fingerprints, so that a group's runs fit in memory
LEAST_GROUPS = 9  # as a power of two
RUN_BYTES = 22  # of a packed run: 8 of the fingerprint, 4 of the second, 8 of the count and 2 of the pointer

#: Bytes as they are compared: A to Z in lower case, blanks as blanks, breaks as line ends.
_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[0x41:0x5B] += 0x20
_LETTERS[0x09] = 0x20
for _byte in b".,;:!?\x0a\x0b\x0c\x0d":
    _LETTERS[_byte] = 0x0A


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit numbers spread over all their bits."""
    values = (values ^ values >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ values >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return values ^ values >> np.uint64(31)


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as far as they were asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < size:
            self.up, self.down = (np.cumprod(np.append(np.uint64(1), np.full(size - 1, b))) for b in (self.base, self.inverse))
        return self.up[:size], self.down[:size]


POWERS = Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93)


class Prefixes:
    """Prefix polynomials of an array, from which any run of it has its own."""

    def __init__(self, values: np.ndarray, powers: Powers) -> None:
        self.up, down = powers.to(len(values) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values.astype(np.uint64) * down[:-1])])

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.up[ends - 1]


class Words:
    """Words of a block: where they are, the piece and the language of each, and their fingerprints."""

    def __init__(self, data: bytes, text_ends: np.ndarray, langs: np.ndarray) -> None:
        letters = self.letters = _LETTERS[np.frombuffer(data, np.uint8)]
        inside = (letters != 0x20) & (letters != 0x0A)
        edges = np.diff(np.concatenate([[False], inside, [False]]).view(np.int8))
        self.starts, self.ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        breaks = np.flatnonzero(letters == 0x0A)
        self.text = np.searchsorted(text_ends, self.starts, "right")
        # A piece ends at a break, and so does each text; a word knows how many words of its piece are left.
        piece = np.searchsorted(breaks, self.starts)
        last = np.flatnonzero(np.diff(piece, append=-1) != 0) if len(piece) else np.zeros(0, np.int64)
        self.left = last[np.searchsorted(last, np.arange(len(piece)))] - np.arange(len(piece)) + 1 if len(piece) else piece
        self.lang = langs[self.text] if len(piece) else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.starts)

    def fingerprints(self, seeds: np.ndarray, powers: Powers) -> np.ndarray:
        """One per word, of its bytes, its length and the seed of its language."""
        if not len(self):
            return np.zeros(0, np.uint64)
        own = Prefixes(self.letters, powers).runs(self.starts, self.ends) + (self.ends - self.starts).astype(np.uint64)
        return mixed(mixed(own) ^ seeds[self.lang])

    def phrase(self, word: int, size: int) -> bytes:
        at = range(word, word + size)
        return b" ".join(self.letters[self.starts[i] : self.ends[i]].tobytes() for i in at)


class Block:
    """Words of a block with the fingerprints of every run of up to ``LONGEST`` of them."""

    def __init__(self, texts: list[bytes], langs: list[int], names: list[str]) -> None:
        self.names = names
        self.words = words = Words(b"".join(texts), np.cumsum([len(t) for t in texts]), np.array(langs, np.int64))
        seeds = np.array([xxhash.xxh64_intdigest(n.encode()) for n in names], np.uint64)
        self.prefixes = [Prefixes(words.fingerprints(seeds, p), p) for p in POWERS]
        self.texts = np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64)

    def places(self, size: int) -> np.ndarray:
        """First words of all runs of ``size`` words inside a piece."""
        return np.flatnonzero(self.words.left >= size)

    def runs(self, at: np.ndarray, size: int) -> np.ndarray:
        """Fingerprints of the runs that start at these words, never below zero as signed numbers."""
        return mixed(self.prefixes[0].runs(at, at + size) + np.uint64(size)) >> np.uint64(1)

    def checks(self, at: np.ndarray, size: int) -> np.ndarray:
        """The second fingerprints, of 31 bits."""
        return (mixed(self.prefixes[1].runs(at, at + size) + np.uint64(size)) >> np.uint64(33)).astype(np.int32)

    def pointers(self, at: np.ndarray) -> np.ndarray:
        """Places of words by the text and the word's number in it: the same however texts are dealt to tasks.

        In 16 bits, as they travel with every run; a phrase is then written at one place or a few.
        """
        text = self.words.text[at]
        return mixed(self.texts[text] + (at - np.searchsorted(self.words.text, text)).astype(np.uint64)) >> np.uint64(48)

    def same(self, one: np.ndarray, other: np.ndarray, size: int) -> np.ndarray:
        """Whether the runs at these words have the same language and text, by their bytes."""
        words = self.words
        same = words.lang[one] == words.lang[other]
        for i in range(size):
            a, b = one + i, other + i
            many = words.ends[a] - words.starts[a]
            same &= many == words.ends[b] - words.starts[b]
            for first in range(0, len(one), 1 << 18):
                part = np.flatnonzero(same[first : first + (1 << 18)]) + first
                sizes = many[part]
                place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                equal = words.letters[np.repeat(words.starts[a[part]], sizes) + place] == words.letters[np.repeat(words.starts[b[part]], sizes) + place]
                if not equal.all():
                    same[np.unique(np.repeat(part, sizes)[~equal])] = False
        return same

    def counted(self, at: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
        """Fingerprints of the runs at these words, both, with their number and a pointer to one of each.

        Runs with equal fingerprints are compared by their text; where the second fingerprint alone differs, they are
        counted apart. Two texts with both alike would be an error that ends the task.
        """
        prints = self.runs(at, size)
        order = np.argsort(prints, kind="stable")
        at, prints = at[order], prints[order]
        checks = self.checks(at, size)
        new = np.concatenate([[True], prints[1:] != prints[:-1]]) if len(at) else np.zeros(0, bool)
        if (~new[1:] & (checks[1:] != checks[:-1])).any():
            order = np.lexsort((checks, prints))
            at, prints, checks = at[order], prints[order], checks[order]
            new[1:] = (prints[1:] != prints[:-1]) | (checks[1:] != checks[:-1])
        first = np.flatnonzero(new)
        counts = np.diff(np.append(first, len(at)))
        again = np.flatnonzero(~new)
        if not self.same(at[again], np.repeat(at[first], counts)[again], size).all():
            raise ValueError("two phrases of a block have the same fingerprints")
        return prints[first].astype(np.int64), checks[first], counts, self.pointers(at[first]).astype(np.int64)


class Filter:
    """Numbers that may be wanted, as bits; what isn't in it is not."""

    def __init__(self, parts: list[tuple[int, bytes]]) -> None:
        self.bits = np.zeros(1 << FILTER_BITS - 3, np.uint8)
        for number, part in parts:
            self.bits[number * len(part) : (number + 1) * len(part)] = np.frombuffer(part, np.uint8)

    def has(self, numbers: np.ndarray) -> np.ndarray:
        at = (numbers & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
        return self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def filter_of(rows: DataFrame, number: Column) -> Broadcast:
    """The filter of a column of numbers, made by Spark: at most 2**27 bits reach the driver."""
    # Spark's bitmap functions: buckets of 32,768 bits each.
    place = number.bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    parts = (
        rows.groupBy(F.shiftright(place, 15).cast("int").alias("number"))
        .agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(32_767))).alias("bits"))
        .collect()
    )
    return rows.sparkSession.sparkContext.broadcast([(r["number"], bytes(r["bits"])) for r in parts])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of texts, a break after each; a text that is longer is cut after a break."""
    held, langs, names, size = [], [], {}, 0
    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
            whole = (text.as_py() or "").encode()
            while whole:
                part, whole = _cut(whole)
                held.append(part + b"\n")
                langs.append(names.setdefault(lang, len(names)))
                size += len(part)
                if size >= BLOCK_BYTES:
                    yield Block(held, langs, list(names))
                    held, langs, names, size = [], [], {}, 0
    if held:
        yield Block(held, langs, list(names))


def _cut(text: bytes) -> tuple[bytes, bytes]:
    """A text's first block, up to a break near its end if it is longer, and the rest."""
    if len(text) <= BLOCK_BYTES:
        return text, b""
    letters = _LETTERS[np.frombuffer(text, np.uint8)]
    breaks = np.flatnonzero(letters == 0x0A) + 1
    at = np.searchsorted(breaks, BLOCK_BYTES, "right")
    end = int(breaks[at - 1]) if at else int(breaks[0]) if len(breaks) else len(text)
    return text[:end], text[end:]


def _word_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First fingerprints of single words with their counts in a block."""
    for block in _blocks(batches):
        prints, counts = np.unique(block.runs(block.places(1), 1).astype(np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(prints), pa.array(counts)], ["print", "n"])


def added_up(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Runs of several blocks, one of each by both fingerprints and in their order, with all its places' number and its smallest pointer."""
    prints, checks, counts, pointers = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(prints, kind="stable")
    prints, checks = prints[order], checks[order]
    if ((prints[1:] == prints[:-1]) & (checks[1:] != checks[:-1])).any():
        again = np.lexsort((checks, prints))
        order, prints, checks = order[again], prints[again], checks[again]
    new = np.concatenate([[True], (prints[1:] != prints[:-1]) | (checks[1:] != checks[:-1])])[: len(prints)]
    first = np.flatnonzero(new)
    if not len(first):
        return prints, checks, counts, pointers
    return prints[first], checks[first], np.add.reduceat(counts[order], first), np.minimum.reduceat(pointers[order], first)


def packed(runs: tuple[np.ndarray, ...]) -> bytes:
    """Runs in the order of their fingerprints, as gaps, byte by byte: what is zero in all runs is shuffled as good as free."""
    prints, checks, counts, pointers = runs
    columns = np.diff(prints, prepend=0).astype("<i8"), checks.astype("<i4"), counts.astype("<i8"), pointers.astype("<u2")
    return b"".join(c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)


def unpacked(data: bytes) -> tuple[np.ndarray, ...]:
    """What ``packed`` was given."""
    planes, columns, first = np.frombuffer(data, np.uint8).reshape(RUN_BYTES, -1), [], 0
    for kind in ("<i8", "<i4", "<i8", "<u2"):
        last = first + np.dtype(kind).itemsize
        columns.append(np.ascontiguousarray(planes[first:last].T).view(kind).ravel())
        first = last
    gaps, checks, counts, pointers = columns
    return np.cumsum(gaps), checks, counts, pointers.astype(np.int64)


def _grouped(runs: tuple[np.ndarray, ...], bits: int) -> Iterator[pa.RecordBatch]:
    """Runs packed by the first bits of their fingerprints."""
    groups = runs[0] >> (63 - bits)
    edges = np.append(np.flatnonzero(np.diff(groups, prepend=-1)), len(groups)).tolist()
    for first in range(0, len(edges) - 1, 64):
        ends = edges[first : first + 65]
        data = [packed(tuple(c[a:b] for c in runs)) for a, b in zip(ends, ends[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(groups[ends[:-1]].astype(np.int32)), pa.array(data, pa.binary())], ["number", "runs"])


def _counter(inside: int, sizes: tuple[int, ...], below: Broadcast, bits: int) -> Callable:
    """Fingerprints of the runs of some sizes with their counts in a task and a pointer, packed in ``2**bits`` groups.

    A run is left out if one of the runs of ``inside`` words in it, or it itself, is not in the filter of frequent ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, held = Filter(below.value), []
        for block in _blocks(batches):
            known = np.zeros(len(block.words), bool)
            at = block.places(inside)
            known[at] = frequent.has(block.runs(at, inside))
            for size in sizes:
                at = block.places(size)
                for shift in range(size - inside + 1):
                    at = at[known[at + shift]]
                held.append(block.counted(at, size))
            if sum(len(part[0]) for part in held) >= HELD:
                held = [added_up(held)]
                if 2 * len(held[0][0]) >= HELD:
                    yield from _grouped(held.pop(), bits)
        if held:
            yield from _grouped(added_up(held), bits)

    return run


def _adder(fewest: int) -> Callable:
    """A group's packed runs to those that stand at least ``fewest`` times."""

    def run(table: pa.Table) -> pa.Table:
        prints, checks, counts, pointers = added_up([unpacked(data.as_py()) for data in table.column("runs")])
        kept = counts >= fewest
        return pa.table({"print": prints[kept], "check": checks[kept], "n": counts[kept], "at": pointers[kept]})

    return run


def _writer(frequent: Broadcast, places: Broadcast, totals: bool) -> Callable:
    """Texts of the runs that may be frequent and pointed to, and the number of words per language if ``totals``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, pointed = Filter(frequent.value), Filter(places.value)
        for block in _blocks(batches):
            words, names = block.words, block.names
            rows = [(None, None, None, names[i], 0, "", int(n)) for i, n in enumerate(np.bincount(words.lang, minlength=len(names))) if n and totals]
            for size in range(1, LONGEST + 1):
                at = block.places(size)
                at = at[kept.has(block.runs(at, size))]
                prints, pointers = block.runs(at, size), block.pointers(at)
                on = pointed.has(prints ^ pointers << np.uint64(POINTER_SHIFT))
                at, prints, pointers = at[on], prints[on].tolist(), pointers[on].tolist()
                one_each = dict(zip(zip(prints, block.checks(at, size).tolist(), pointers, strict=True), at.tolist(), strict=True))
                rows += [(*key, names[words.lang[i]], size, words.phrase(i, size).decode(), 0) for key, i in one_each.items()]
            for first in range(0, len(rows), 20_000):
                columns = zip(*rows[first : first + 20_000], strict=True)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*KEY, "lang", "size", "phrase", "n"])

    return run


KEY = ["print", "check", "at"]
COUNTED = "print long, check int, n long, at long"
TEXTS = "print long, check int, at long, lang string, size int, phrase string, n long"


def frequent_phrases(docs: DataFrame, fewest: int = FEWEST) -> DataFrame:
    """``lang, size, phrase, n``: every run of 1 to 5 words that stands at least ``fewest`` times in a language's
    texts, words joined by blanks; with ``size`` 0 each language's number of words.

    ``docs`` needs ``text`` and ``lang``; a null language is ``und``. Texts are cut into pieces at ``. , ; : ! ?``
    and line breaks, pieces into words at blanks and tabs; A to Z are lower-cased. No run crosses a
    piece. Null and empty texts have no words; repeated rows count each time. Passes over the
    texts: words, frequent words and pairs of them, three words of frequent pairs, longer runs whose every three
    words are frequent, then texts, one pass for every ``WRITTEN`` frequent runs. Between them only filters of 16 MB go to the driver and to the workers; in a larger
    corpus those of the first passes let more runs through, which costs time but changes no row.
    """
    rows = small_batches(docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), "text"))

    def counted(inside: int, sizes: tuple[int, ...], below: DataFrame) -> DataFrame:
        runs = rows.mapInArrow(tidy(_counter(inside, sizes, filter_of(below, F.col("print")), bits)), "number int, runs binary")
        return materialize(runs.groupBy("number").applyInArrow(_adder(fewest), COUNTED), "phrases")

    words = rows.mapInArrow(tidy(_word_counter), "print long, n long").groupBy("print").agg(F.sum("n").alias("n"))
    words = materialize(words.where(F.col("n") >= fewest), "phrases")
    # No pass counts more runs of a size than there are frequent words: groups grow in number, not in size.
    bits = max(LEAST_GROUPS, ((words.agg(F.sum("n")).first()[0] or 0) // GROUP_WORDS).bit_length())
    short = counted(1, (1, 2), words)
    three = counted(2, (3,), short)
    every = short.union(three).union(counted(3, tuple(range(4, LONGEST + 1)), three))
    passes = max(1, -(-every.count() // WRITTEN))
    written = []
    for number in range(passes):
        wanted = every.where(F.pmod("print", F.lit(passes)) == number)
        place = F.col("print").bitwiseXOR(F.shiftleft("at", POINTER_SHIFT))
        texts = rows.mapInArrow(tidy(_writer(filter_of(wanted, F.col("print")), filter_of(wanted, place), number == 0)), TEXTS)
        written.append(texts.where(f"print is null or pmod(print, {passes}) = {number}"))
    texts = materialize(reduce(DataFrame.union, written), "phrases")
    totals = texts.where("print is null").groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    # Copies of a text have the same pointers, and others may be alike: a phrase may have been written more than once.
    phrases = texts.where("print is not null").drop("n").distinct().join(every, KEY).select("lang", "size", "phrase", "n")
    return materialize(totals.union(phrases), "phrases")


def _words(first: Column, last: Column) -> Column:
    """A phrase of the words numbered from ``first`` to ``last`` (from 1) of the array ``w``."""
    return F.array_join(F.slice("w", first, last - first + 1), " ")


def _with_counts(parts: DataFrame, phrases: DataFrame, part: str, size: Column, name: str) -> DataFrame:
    """``parts`` with the count of the phrase in column ``part``.

    Single words are parts of very many phrases: their counts are copied ``SALTS`` times, and the rows dealt out.
    """
    one = F.col("size") == 1
    salts = F.when(one, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    known = phrases.select("lang", F.col("phrase").alias(part), F.col("n").alias(name), F.explode(salts).alias("salt"))
    salt = F.when(size == 1, F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")).otherwise(0)
    return parts.withColumn("salt", salt).join(known, ["lang", part, "salt"]).drop("salt")


def collocations(docs: DataFrame, first: int = FIRST, fewest: int = FEWEST, percent: int = 100) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``first`` phrases whose parts belong together most.

    Candidates are the ``frequent_phrases`` of 2 to 5 words, ``a`` their count. Cut after word k, the parts
    stand ``l`` and ``r`` times, and the cut's score is ``floor(1000 * a * n / (l * r))`` with ``n`` words
    in the language; the cut with the smallest score counts, of equal ones the first. A candidate inside a
    longer one that has at least ``percent`` of its count is left out. Rows are ranked by score and
    count, largest first, then by phrase in byte order. Products are decimals of 38 digits.
    Without words, or on an empty table, there are no rows.
    """
    phrases = frequent_phrases(docs, fewest)
    totals = phrases.where("size = 0").select("lang", F.col("n").alias("total"))
    counted = phrases.where("size > 0")
    several = counted.where("size > 1").withColumn("w", F.split("phrase", " "))
    inner = several.where("size > 2").select(
        "lang", "n", "size", "w", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("many")
    )
    inner = inner.select("lang", "n", "w", "many", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("many") + 1)).alias("at"))
    inner = inner.select("lang", "n", _words(F.col("at"), F.col("at") + F.col("many") - 1).alias("phrase"))
    around = inner.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    cuts = several.select("lang", "phrase", "size", "n", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "size", "n", "k",
        _words(F.lit(1), F.col("k")).alias("head"), _words(F.col("k") + 1, F.col("size")).alias("tail"),
    )
    cuts = _with_counts(cuts, counted, "head", F.col("k"), "l")
    cuts = _with_counts(cuts, counted, "tail", F.col("size") - F.col("k"), "r")
    whole = {c: F.col(c).cast("decimal(19,0)") for c in ("n", "total", "l", "r")}
    over = (whole["n"] * whole["total"]).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")
    salted = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS * SALTS - 1))))
    cuts = cuts.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS * SALTS)).cast("int"))
    scored = cuts.join(salted, ["lang", "salt"]).withColumn("over", over).withColumn("under", whole["l"] * whole["r"])
    scored = scored.withColumn("score", F.expr("over div under"))
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "n", "l", "r", "total")).alias("c"))
    free = weakest.join(around, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(percent) * F.col("c.n"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = free.select("lang", "phrase", F.col("c.n").alias("a"), "c.l", "c.r", F.col("c.total").alias("n"), "c.score")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
