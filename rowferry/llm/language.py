"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language gives longest-match lengths: a text is
parsed greedily into the longest phrases that occur in the language's sample. The
language that needs the fewest phrases, normalised by its sample's length, wins.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowferry.llm.tables import held_out, small_batches, sub_batches, tidy, worker_model

UNKNOWN = "und"
SAMPLE_CHARS = 96_000  # of all languages together
SAMPLE_ROWS = 200  # per language
LEAST_CHARS = 2_000  # per language
LETTERS = 126  # the most frequent letters have dense transitions, all others of the samples sparse ones
RARE = 256  # first code of the others
BREAK = 1


@dataclass(frozen=True)
class Automaton:
    """``moves[state + code]`` is the next state (a multiple of ``width``), 0 if the phrase ends there.

    For codes from ``RARE`` on it is ``rare[state + code * len(moves)]``, if there.
    """

    lang: str
    moves: list[int]
    rare: dict[int, int]
    weight: float  # bits that name one phrase of the sample


def suffix_automaton(text: Sequence[int], width: int) -> list[int]:
    """The dense transitions of the suffix automaton of ``text``, whose codes are below ``width``."""
    return transitions(text, width)[0]


def transitions(text: Sequence[int], width: int) -> tuple[list[int], dict[int, int]]:
    """The transitions of the suffix automaton of ``text``; state 0 is the empty match.

    Those of codes below ``width`` are a table of at most ``2 * len(text)`` rows of ``width`` entries, the
    others, in all less than three for each code of ``text``, are a dict by state and code.
    """
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for code in text:
        now = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and code not in moves[at]:
            moves[at][code] = now
            at = link[at]
        if at >= 0:
            onto = moves[at][code]
            if length[at] + 1 == length[onto]:
                link[now] = onto
            else:
                copy = len(moves)
                moves.append(dict(moves[onto]))
                length.append(length[at] + 1)
                link.append(link[onto])
                link[onto] = link[now] = copy
                while at >= 0 and moves[at].get(code) == onto:
                    moves[at][code] = copy
                    at = link[at]
        last = now
    dense, rare = [0] * (len(moves) * width), {}
    for state, out in enumerate(moves):
        for code, to in out.items():
            if code < width:
                dense[state * width + code] = to * width
            else:
                rare[state * width + code * len(dense)] = to * width
    return dense, rare


def phrases(codes: bytes, moves: list[int]) -> int:
    """Phrases of the greedy parse; a code that the sample lacks is a phrase of its own."""
    count, state = 0, 0
    for code in codes:
        onward = moves[state + code]
        if onward:
            state = onward
        else:
            if state:
                count += 1
            state = moves[code]
            if not state:
                count += 1
    return count + (state != 0)


def wide_phrases(codes: Sequence[int], moves: list[int], rare: dict[int, int]) -> int:
    """``phrases`` of a text with codes from ``RARE`` on."""
    count, state, span = 0, 0, len(moves)
    for code in codes:
        onward = moves[state + code] if code < RARE else rare.get(state + code * span, 0)
        if onward:
            state = onward
        else:
            if state:
                count += 1
            state = moves[code] if code < RARE else rare.get(code * span, 0)
            if not state:
                count += 1
    return count + (state != 0)


class Codes(dict):
    """Character to code for ``str.translate``: case is folded, all but letters are breaks.

    A letter that no sample has is 0, which never matches.
    """

    def __missing__(self, point: int) -> int:
        char = chr(point)
        code = self.letters.get(char.lower()[:1], 0) if char.isalpha() else BREAK
        self[point] = code
        return code

    def __init__(self, letters: dict[str, int]) -> None:
        super().__init__()
        self.letters = letters

    def encode(self, text: str) -> bytes | array:
        """Letters with single breaks between them and around them; empty if there is no letter.

        Bytes if all codes are below ``RARE``, else an array of numbers.
        """
        words = [w for w in text.translate(self).split("\x01") if w]
        line = "\x01" + "\x01".join(words) + "\x01" if words else ""
        try:
            return line.encode("latin-1")
        except UnicodeEncodeError:
            return array("I", line.encode("utf-32-le", "surrogatepass"))


def build(samples: tuple[tuple[str, str], ...]) -> tuple[Codes, list[Automaton]]:
    """The code table and one automaton per language, kept by each worker."""
    seen = Counter(c for _, text in samples for c in text.lower() if c.isalpha())
    order = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))]
    letters = {c: BREAK + 1 + i for i, c in enumerate(order[:LETTERS])}
    width = BREAK + 1 + len(letters)
    codes = Codes(letters | {c: RARE + i for i, c in enumerate(order[LETTERS:])})
    out = []
    for lang, text in samples:
        sample = codes.encode(text)
        out.append(Automaton(lang, *transitions(sample, width), math.log2(len(sample) + 2)))
    return codes, out


def identify(text: str | None, codes: Codes, automata: list[Automaton]) -> tuple[str, float]:
    """Language and score; the score is the share of the runner-up's phrases among both, 0 for ``und``."""
    data = codes.encode(text) if text else b""
    if not data or not automata:
        return UNKNOWN, 0.0
    narrow = isinstance(data, bytes)
    costs = sorted(((phrases(data, a.moves) if narrow else wide_phrases(data, a.moves, a.rare)) * a.weight, a.lang) for a in automata)
    best = costs[0]
    if len(costs) == 1:
        return best[1], 1.0
    return best[1], costs[1][0] / (best[0] + costs[1][0])


def language_samples(docs: DataFrame, usable: Column) -> tuple[tuple[str, str], ...]:
    """``(lang, text)`` per labelled language, from ``usable`` rows with a label and a text.

    Of each language the ``SAMPLE_ROWS`` distinct texts with the smallest hashes: equal texts count once.
    Each gives a span that starts at a hashed place and goes on from the text's end to its start, so
    every part of a text is as likely as any other; spans are cut to an even share of the
    language's part of ``SAMPLE_CHARS``, and shorter texts are whole. Workers learn from that many
    characters (``LEAST_CHARS`` per language if there are many), whatever the input; the driver
    gets at most ``SAMPLE_ROWS`` spans of a language's part. Two passes: counts per language, then the chosen texts.
    """
    rows = docs.where(usable & F.col("lang").isNotNull() & (F.length(F.trim("text")) > 0))
    rows = rows.select("lang", F.abs(F.xxhash64("text")).alias("draw"), "text")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")).collect()}
    if not counts:
        return ()
    share = max(LEAST_CHARS, SAMPLE_CHARS // len(counts))
    limit = F.lit(0).cast("double")
    for lang, n in counts.items():
        limit = F.when(F.col("lang") == lang, F.lit(min(1.0, 2.0 * SAMPLE_ROWS / max(1, n)) * 2.0**63)).otherwise(limit)
    start = F.pmod(F.xxhash64("text", F.lit(1)), F.length("text")).cast("int") + 1
    span = F.substring(F.concat("text", F.lit("\n"), "text"), start, F.least(F.lit(share), F.length("text") + 1))
    chosen = rows.where(F.col("draw") <= limit).select("lang", "draw", span.alias("text")).distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))
    chosen = chosen.withColumn("place", place).where(F.col("place") <= SAMPLE_ROWS)
    texts: dict[str, list[str]] = {}
    for r in chosen.orderBy("lang", "place").collect():
        texts.setdefault(r["lang"], []).append(r["text"])
    return tuple((lang, _even_cut(parts, share)) for lang, parts in sorted(texts.items()))


def _even_cut(parts: list[str], share: int) -> str:
    """The beginnings of the spans, all at most as long as fits ``share`` in total."""
    left, out = share, []
    for i, part in enumerate(sorted(parts, key=len)):
        take = part[: left // (len(parts) - i)]
        out.append(take)
        left -= len(take)
    return "\n".join(out)


def _predictor(samples: tuple[tuple[str, str], ...], text_at: int, keep_known: bool):
    def run(batches):
        codes, automata = worker_model(("language", samples), lambda: build(samples))
        for batch in batches:
            for part in sub_batches(batch, 256):
                found = [identify(t, codes, automata) for t in part.column(text_at).to_pylist()]
                if keep_known:
                    yield part.filter(pa.array([lang != UNKNOWN for lang, _ in found]))
                else:
                    langs = pa.array([x for x, _ in found], pa.string())
                    scores = pa.array([x for _, x in found], pa.float64())
                    yield pa.RecordBatch.from_arrays([*part.columns[:2], langs, scores], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict_language(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``.

    ``docs`` needs ``doc_id``, ``text`` and ``lang``; other columns aren't read. Labels are learned
    from rows that aren't held out (a null id isn't held out). Null texts and texts without a
    letter are ``und`` with score 0; so is all if no label can be learned. Ties go to the
    language first in order. Repeated rows get equal answers; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text", "lang")
    samples = language_samples(docs, ~held_out())
    rows = small_batches(docs.select("doc_id", held_out().alias("held_out"), "text"))
    return rows.mapInArrow(tidy(_predictor(samples, 2, False)), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language can be told; ``und`` rows go. All columns stay as they are."""
    samples = language_samples(docs.select("doc_id", "text", "lang"), ~held_out())
    return small_batches(docs).mapInArrow(tidy(_predictor(samples, docs.columns.index("text"), True)), docs.schema)
