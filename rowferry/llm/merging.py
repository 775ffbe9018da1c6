"""Ranked merges of many words at once, on flat arrays, and a table of words already merged."""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Callable, Sequence

import numpy as np

NONE = np.iinfo(np.int32).max  # rank of a pair that never merges


class Keys:
    """Places of distinct non-negative numbers in a list, looked up many at a time through hashed slots."""

    FREE = -1

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(4, int(4 * len(keys) + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots, self.places = np.full(1 << bits, self.FREE, np.int64), np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.slots[at] == self.FREE
            self.slots[at[free]], self.places[at[free]] = keys[left[free]], left[free]
            lost = self.slots[at] != keys[left]  # another key took the slot
            left, at = left[lost], (at[lost] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each number's place in the list, -1 where it isn't listed."""
        at = self._slot(keys)
        seen = self.slots[at]
        out = np.where(seen == keys, self.places[at], np.int32(-1))
        going = np.flatnonzero((seen != keys) & (seen != self.FREE))
        at = at[going]
        while len(going):
            at = (at + 1) & self.mask
            seen = self.slots[at]
            hit = seen == keys[going]
            out[going[hit]] = self.places[at[hit]]
            on = ~hit & (seen != self.FREE)
            at, going = at[on], going[on]
        return out


class Merges:
    """Which pair of symbols becomes which symbol, and at what rank (the smallest goes first)."""

    def __init__(self, left: Sequence[int], right: Sequence[int], rank: Sequence[int], merged: Sequence[int], width: int) -> None:
        self.width = width  # symbols are below it
        self.listed = np.asarray(left, np.int64) * width + np.asarray(right, np.int64)
        self.keys = Keys(self.listed)
        self.ranks = np.append(np.asarray(rank, np.int32), np.int32(NONE))
        self.merged = np.append(np.asarray(merged, np.int32), np.int32(0))
        self._by_key: dict[int, tuple[int, int]] | None = None

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; ``NONE`` where the pair does not merge."""
        at = self.keys.find(left.astype(np.int64) * self.width + right)
        return self.ranks[at], self.merged[at]

    def one_by_one(self, word: list[int]) -> list[int]:
        """One word merged pair by pair: the smallest rank first, then the leftmost."""
        if self._by_key is None:
            self._by_key = dict(zip(self.listed.tolist(), zip(self.ranks.tolist(), self.merged.tolist()), strict=False))
        symbols, size = list(word), len(word)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))

        def pair(a: int) -> tuple[int, int, int, int] | None:
            b = after[a]
            known = self._by_key.get(symbols[a] * self.width + symbols[b]) if b < size else None
            return None if known is None else (known[0], a, symbols[a], symbols[b])

        heap = [x for a in range(size) if (x := pair(a))]
        heapq.heapify(heap)
        while heap:
            _, a, first, second = heapq.heappop(heap)
            b = after[a]
            if b >= size or symbols[a] != first or symbols[b] != second:
                continue
            symbols[a], symbols[b] = self._by_key[first * self.width + second][1], -1
            after[a] = after[b]
            if after[a] < size:
                before[after[a]] = a
            for c in (before[a], a):
                if c >= 0 and (x := pair(c)):
                    heapq.heappush(heap, x)
        return [s for s in symbols if s >= 0]


def _leftmost(at: np.ndarray) -> np.ndarray:
    """Of ascending places, every other one of each run of neighbours: pairs that don't overlap."""
    place = np.arange(len(at))
    head = np.ones(len(at), bool)
    head[1:] = np.diff(at) != 1
    return at[(place - np.maximum.accumulate(np.where(head, place, 0))) % 2 == 0]


def merge_rounds(symbols: np.ndarray, sizes: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Each word's symbols, merged until no pair is left: ``(flat symbols, sizes)`` in the words' order.

    A round takes the smallest rank of each word, merges that pair wherever it stands in the word, from
    the left, and closes the gaps; words without a pair leave. That equals one merge after the other
    unless a merge makes a pair that goes before the rest of the round (a smaller rank, or an equal one
    further left); words in which that happens are merged again one by one.
    """
    count = len(sizes)
    made, given, given_starts = np.zeros(count, np.int64), symbols, np.cumsum(sizes) - sizes
    odd = np.zeros(count, bool)
    number = np.flatnonzero(sizes)
    sizes = np.asarray(sizes, np.int64)[number]
    symbols = symbols.astype(np.int32)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    if len(symbols):
        ranks = np.append(merges.find(symbols[:-1], symbols[1:])[0], np.int32(NONE))
        ranks[np.cumsum(sizes) - 1] = NONE
    while len(symbols):
        starts = np.cumsum(sizes) - sizes
        low = np.minimum.reduceat(ranks, starts)
        rest = low < NONE
        if not rest.all():
            keep = np.repeat(rest, sizes)
            made[number[~rest]] = sizes[~rest]
            done.append((np.repeat(number[~rest], sizes[~rest]), symbols[~keep]))
            symbols, ranks, number, sizes, low = symbols[keep], ranks[keep], number[rest], sizes[rest], low[rest]
            starts = np.cumsum(sizes) - sizes
            if not len(symbols):
                break
        at = _leftmost(np.flatnonzero(ranks == np.repeat(low, sizes)))
        word = np.searchsorted(starts, at, "right") - 1
        _, new = merges.find(symbols[at], symbols[at + 1])
        # With the next symbol as it stands before that one takes part in a merge of this round.
        beside = np.flatnonzero(np.diff(at) == 2)
        beside = beside[word[beside] == word[beside + 1]]
        early = merges.find(new[beside], symbols[at[beside] + 2])[0] <= low[word[beside]]
        odd[number[word[beside[early]]]] = True
        symbols[at] = new
        kept = np.ones(len(symbols), bool)
        kept[at + 1] = False
        symbols, ranks = symbols[kept], ranks[kept]
        at = at - np.arange(len(at))
        sizes = sizes - np.bincount(word, minlength=len(sizes))
        starts = np.cumsum(sizes) - sizes
        ranks[at] = NONE
        for place, owner in ((at, word), (at - 1, word)):
            inside = (place >= starts[owner]) & (place < starts[owner] + sizes[owner] - 1)
            place, owner = place[inside], owner[inside]
            ranks[place] = merges.find(symbols[place], symbols[place + 1])[0]
            odd[number[owner[ranks[place] <= low[owner]]]] = True
        ranks[starts + sizes - 1] = NONE
    owners, flat = (np.concatenate(x) if done else np.zeros(0, np.int64) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 2
    if odd.any():
        keep = ~odd[owners]
        owners, flat = [owners[keep]], [flat[keep]]
        ends = np.append(given_starts, len(given))
        for i in np.flatnonzero(odd):
            again = merges.one_by_one(given[ends[i] : ends[i + 1]].tolist())
            made[i] = len(again)
            owners.append(np.full(len(again), i))
            flat.append(np.array(again, np.int64))
        owners, flat = np.concatenate(owners), np.concatenate(flat)
    return flat[np.argsort(owners, kind="stable")].astype(np.int32), made


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for, and lists the new ones."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, word: object) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class WordTable:
    """Ids of each distinct word met so far; a word is merged once until the table starts again.

    ``encode`` takes new words and returns their ids, one after the other, and how many each has.
    Beyond ``most`` words, or eight times as many ids, the table starts again with the next texts.
    """

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], most: int = 300_000) -> None:
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.numbers = _Numbers()
        self.flat, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids(self, texts: Sequence[Sequence]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts given as their words: ``(flat ids, ids of each text)``."""
        if len(self.numbers) > self.most or len(self.flat) > 8 * self.most:
            self._clear()
        uses, words = array("i"), []
        for text in texts:
            uses.extend(map(self.numbers.__getitem__, text))
            words.append(len(text))
        new, self.numbers.new = self.numbers.new, []
        if new:
            flat, counts = self.encode(new)
            self.starts = np.append(self.starts, len(self.flat) + np.cumsum(counts) - counts)
            self.counts = np.append(self.counts, counts)
            self.flat = np.append(self.flat, flat)
        used = np.frombuffer(uses, np.int32) if len(uses) else np.zeros(0, np.int32)
        many = self.counts[used]
        ends = np.concatenate([[0], np.cumsum(many)])
        flat = self.flat[np.repeat(self.starts[used] - ends[:-1], many) + np.arange(ends[-1])]
        return flat, np.diff(ends[np.concatenate([[0], np.cumsum(words, dtype=np.int64)])]) if words else np.zeros(0, np.int64)
