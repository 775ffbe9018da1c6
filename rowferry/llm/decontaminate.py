"""Benchmark decontamination by the q-gram lemma.

An item of ``m`` bytes that occurs with at most ``k`` edits shares at least ``m - q + 1 - k*q``
q-grams with the place, and all of them lie in ``k + 1`` neighbouring diagonals. Shared q-grams
are counted in bands of diagonals that overlap by ``k``; bands that meet the bound are
verified by banded alignment. Nothing within the edit budget is missed.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowferry.llm.tables import small_batches, sub_batches, tidy, worker_model
from rowferry.storage import materialize, no_rows

Q = 8
ERROR_RATE = 0.1
SLOT_BITS = 22
BLOCK_CHARS = 4_000_000  # of benchmark text per pass over the documents
TEXT_AT_ONCE = 1_000_000
HITS_AT_ONCE = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> bytes:
    """ASCII lower case, white space runs as one blank, UTF-8."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def budget(size: int) -> int:
    """Edits allowed in an item of ``size`` bytes: a tenth, and so few that the lemma's bound stays positive."""
    return max(0, min(int(size * ERROR_RATE), (size - Q) // Q))


def grams(data: np.ndarray) -> np.ndarray:
    """All 8-byte windows of a byte array as integers."""
    n = data.size - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for shift in range(min(Q, n)):
        part = data[shift : shift + (data.size - shift) // Q * Q]
        out[shift::Q] = part.view("<u8")[: out[shift::Q].size] if shift % Q == 0 else np.frombuffer(part.tobytes(), "<u8")[: out[shift::Q].size]
    return out


@dataclass
class Index:
    """The q-grams of a block of items: sorted codes with postings, and a slot filter in front."""

    ids: list[int]
    texts: list[bytes]
    tiny: list[tuple[int, bytes]]  # items shorter than a q-gram, or without an edit budget's q-gram
    slots: np.ndarray
    codes: np.ndarray
    starts: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    need: np.ndarray
    edits: np.ndarray


def build_index(items: tuple[tuple[int, bytes], ...]) -> Index:
    """Of each item the commonest q-grams are left out, as many as its bound can spare.

    With ``d`` of an item's q-grams left out, its place still shares the bound less ``d``, so
    half the bound is spent on q-grams that many items share, and the other half still filters.
    """
    kept = [(i, t) for i, t in items if len(t) >= Q]
    tiny = [(i, t) for i, t in items if 0 < len(t) < Q]
    lists = [grams(np.frombuffer(t, np.uint8)) for _, t in kept]
    values, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *lists]), return_counts=True)
    codes, item, offset, need, edits = [], [], [], [], []
    for n, own in enumerate(lists):
        k = budget(len(kept[n][1]))
        bound = own.size - k * Q
        common = counts[np.searchsorted(values, own)]
        spare = (bound - 1) // 2
        chosen = np.sort(np.argsort(common, kind="stable")[: own.size - spare])
        codes.append(own[chosen])
        item.append(np.full(chosen.size, n, np.int64))
        offset.append(chosen)
        need.append(bound - spare)
        edits.append(k)
    every = np.concatenate([np.zeros(0, np.uint64), *codes])
    order = np.argsort(every, kind="stable")
    unique, first = np.unique(every[order], return_index=True)
    slots = np.zeros(1 << SLOT_BITS, np.bool_)
    slots[(unique * _MIX) >> np.uint64(64 - SLOT_BITS)] = True
    joined = [np.concatenate([np.zeros(0, np.int64), *x])[order] for x in (item, offset)]
    return Index(
        [i for i, _ in kept], [t for _, t in kept], tiny, slots, unique, np.append(first, every.size), *joined,
        np.array(need, np.int64), np.array(edits, np.int64),
    )


def _regions(index: Index, data: np.ndarray, codes: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Rows ``(text, item, first diagonal)`` of the bands that meet their item's bound."""
    hits = np.flatnonzero(index.slots[(codes * _MIX) >> np.uint64(64 - SLOT_BITS)])
    if not index.codes.size or not hits.size:
        return np.zeros((0, 3), np.int64)
    found = np.minimum(np.searchsorted(index.codes, codes[hits]), index.codes.size - 1)
    true = index.codes[found] == codes[hits]
    hits, found = hits[true], found[true]
    fan = index.starts[found + 1] - index.starts[found]
    ends = np.cumsum(fan)
    out = []
    text_of = np.searchsorted(borders, hits, side="right") - 1
    at = 0
    while at < hits.size:  # whole texts at a time, about HITS_AT_ONCE expanded hits together
        goal = (ends[at - 1] if at else 0) + HITS_AT_ONCE
        to = max(at + 1, int(np.searchsorted(ends, goal, side="right")))
        to = int(np.searchsorted(text_of, text_of[min(to, hits.size) - 1], side="right"))
        f, n = found[at:to], fan[at:to]
        posting = np.repeat(index.starts[f] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
        item = index.item[posting]
        text = np.repeat(text_of[at:to], n)
        diagonal = np.repeat(hits[at:to], n) - borders[text] - index.offset[posting]
        width = index.edits[item] + 1
        longest = max(map(len, index.texts))
        band = (diagonal + longest) // width + 1  # positive
        # A match's k + 1 diagonals lie in one band of width k + 1 or two neighbours: count both.
        span = int(band.max(initial=0)) + 2
        key = (text * len(index.ids) + item) * span + band
        key, count = np.unique(np.concatenate([key, key - 1]), return_counts=True)
        owner = key // span
        good = count >= index.need[owner % len(index.ids)]
        key, owner = key[good], owner[good]
        text, item = owner // len(index.ids), owner % len(index.ids)
        low = (key % span - 1) * (index.edits[item] + 1) - longest
        out.append(np.stack([text, item, low], axis=1))
        at = to
    return np.concatenate([np.zeros((0, 3), np.int64), *out])


def banded_alignment(item: bytes, window: bytes, low: int, width: int, most: int) -> tuple[int, int, int] | None:
    """Fewest edits that turn ``item`` into a part of ``window``: ``(edits, start, end)``, None beyond ``most``.

    Cells lie on the diagonals ``low .. low + width - 1`` (place in the window less place in the item).
    Ties take the end, then the start, that comes first.
    """
    far = most + 1
    text = np.frombuffer(window, np.uint8)
    places = np.arange(width, dtype=np.int64) + low
    cost = np.where((places >= 0) & (places <= text.size), 0, far)
    start = places.copy()
    steps = np.arange(width, dtype=np.int64)
    for i, char in enumerate(item, 1):
        at = places + i  # ends of the window parts, after i bytes of the item
        legal = (at >= 0) & (at <= text.size)
        symbol = text[np.clip(at - 1, 0, max(0, text.size - 1))] if text.size else np.zeros(width, np.uint8)
        step = cost + np.where((at >= 1) & (symbol == char), 0, 1)
        step = np.where(at >= 1, step, far)
        drop = np.append(cost[1:] + 1, far)
        own = np.where(drop < step, np.append(start[1:], 0), start)
        value = np.where(legal, np.minimum(step, drop), far)
        lead = np.minimum.accumulate((value - steps) * (width + 1) + steps)
        source = lead % (width + 1)
        cost = np.minimum(value[source] + (steps - source), far)
        cost = np.where(legal, cost, far)
        start = own[source]
        if cost.min() > most:
            return None
    best = int(cost.argmin())
    end = int(places[best] + len(item))
    return (int(cost[best]), int(start[best]), end) if cost[best] <= most else None


def _verified(index: Index, text: bytes, item: int, low: int) -> tuple[int, int, int] | None:
    """The best place of an item on one band, in bytes of the normalised text."""
    target, k = index.texts[item], int(index.edits[item])
    width = 2 * (k + 1)
    left = max(0, low - k)
    right = min(len(text), low + width + len(target) + k)
    window = text[left:right]
    exact = window.find(target)
    if exact >= 0:
        return 0, left + exact, left + exact + len(target)
    got = banded_alignment(target, window, low - left - k, width + 2 * k, k)
    return got and (got[0], left + got[1], left + got[2])


def find_items(index: Index, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """``(text, item id, edits, start, end, item bytes)``, the best place of each item in each text."""
    gap = b"\x00" * Q
    joined = np.frombuffer(gap.join(texts) + gap, np.uint8)
    borders = np.cumsum([0, *(len(t) + Q for t in texts)])[:-1]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for text, item, low in _regions(index, joined, grams(joined), borders).tolist():
        known = best.get((text, item))
        if known and known[0] == 0:
            continue
        got = _verified(index, texts[text], item, low)
        if got and (known is None or got < known):
            best[text, item] = got
    for (text, item), (edits, start, end) in sorted(best.items()):
        yield text, index.ids[item], edits, start, end, len(index.texts[item])
    for number, short in index.tiny:
        for i, t in enumerate(texts):
            at = (b" " + t + b" ").find(b" " + short + b" ")
            if at >= 0:
                yield i, number, 0, at, at + len(short), len(short)


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows with about ``TEXT_AT_ONCE`` bytes of normalised text."""
    for part in sub_batches(batch, 512):
        texts, first, size = [], 0, 0
        for i, value in enumerate(part.column("text")):
            text = normal(value.as_py())
            if texts and size + len(text) > TEXT_AT_ONCE:
                yield part.slice(first, i - first), texts
                texts, first, size = [], i, 0
            texts.append(text)
            size += len(text)
        if texts:
            yield part.slice(first), texts


def benchmark_blocks(benchmark: DataFrame) -> Iterator[tuple[tuple[int, bytes], ...]]:
    """The items in blocks of about ``BLOCK_CHARS`` bytes; a query set, streamed through the driver block by block.

    Null and blank items are left out; of equal normalised texts, grouped by Spark, the smallest id stays,
    a null id last.
    """
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    item = F.trim(F.regexp_replace(lower, r"[\x20\x09-\x0D]+", " "))
    rows = benchmark.select("item_id", item.alias("item")).where("item != ''").groupBy("item").agg(F.min("item_id").alias("item_id"))
    block, size = [], 0
    for row in rows.orderBy(F.col("item_id").asc_nulls_last(), "item").toLocalIterator():
        text = normal(row["item"])
        if block and size + len(text) > BLOCK_CHARS:
            yield tuple(block)
            block, size = [], 0
        block.append((row["item_id"], text))
        size += len(text)
    if block:
        yield tuple(block)


HITS = "doc_id long, item_id long, edits int, similarity double, start long, end long"


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document row and benchmark item found in it, at the item's best place.

    ``docs`` needs ``doc_id`` and ``text``, ``benchmark`` ``item_id`` and ``text``; other columns aren't
    read. Texts are compared in ASCII lower case with white space as single blanks; ``start`` and
    ``end`` are byte offsets in that form, ``similarity`` is one less edits per item byte. Items
    shorter than a q-gram must stand between blanks. Null texts hold nothing. Repeated document
    rows give repeated rows; equal items count once, under the smallest id; empty tables give no rows.
    Only whole items count: a text that quotes a part of a long item does not hold it.
    Each block of items is one pass over the documents, without a shuffle.
    """
    spark, out = docs.sparkSession, no_rows(docs.sparkSession, HITS)
    for block in benchmark_blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            index = worker_model(("benchmark", shared.value), lambda: build_index(shared.value))
            for batch in batches:
                for part, texts in _pieces(batch):
                    found = list(find_items(index, texts))
                    if found:
                        at, ids, edits, start, end, size = (np.array(x) for x in zip(*found, strict=True))
                        yield pa.RecordBatch.from_arrays(
                            [part.column("doc_id").take(pa.array(at)), pa.array([x[1] for x in found], pa.int64()), pa.array(edits.astype(np.int32)), pa.array(1 - edits / size), pa.array(start), pa.array(end)],
                            ["doc_id", "item_id", "edits", "similarity", "start", "end"],
                        )

        hits = small_batches(docs.select("doc_id", "text")).mapInArrow(tidy(run), HITS)
        out = out.union(hits)
    return out


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any benchmark item; all columns stay as they are.

    Each block of items is one pass; between two passes the rows that are left are written, so a worker
    holds one block at a time.
    """
    spark = docs.sparkSession
    for number, block in enumerate(benchmark_blocks(benchmark)):
        if number:
            docs = materialize(docs, "uncontaminated")
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            index = worker_model(("benchmark", shared.value), lambda: build_index(shared.value))
            for batch in batches:
                for part, texts in _pieces(batch):
                    bad = {hit[0] for hit in find_items(index, texts)}
                    yield part.filter(pa.array([i not in bad for i in range(len(texts))]))

        docs = small_batches(docs).mapInArrow(tidy(run), docs.schema)
    return docs
