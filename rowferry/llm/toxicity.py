"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are all words of the examples, and those of their character 4- and 5-grams that tell the
labels apart by a chi-squared test. Such terms, words or grams, keep their whole idf, all others
``WEAK`` of it, so an insult outweighs a topic but every word counts. Examples sit in a block-max
inverted index: for each term, posting lists in blocks with the largest weight of each block, so
that blocks are skipped by an upper bound and the best neighbours are still exact. Votes weighted by
distance are calibrated on the examples themselves, each left out of its own vote.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections import Counter
from collections.abc import Sequence
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowferry.llm.tables import held_out, rows_of, small_batches, sub_batches, tidy, worker_model
from rowferry.storage import materialize

EXAMPLES = 4_096
WEAK = 0.02  # weight of terms that don't tell the labels apart
LEAST_CHI2 = 28.0  # one in ten million by chance, as very many terms are tried
LEAST_DOCS = 3
NEIGHBOURS = 15
EVIDENCE = 3
BLOCK = 64
BLOCKS_AT_ONCE = 8
NEAR = 0.02  # added to a distance, so an equal example does not outvote all others
CACHED_WORDS = 200_000
THRESHOLD = 0.3

_word = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _word.findall(text.lower()) if text else []


def word_terms(word: str) -> set[str]:
    """The whole word and its 4- and 5-grams, word borders included."""
    marked = f"^{word}$"
    grams = {marked[i : i + n] for n in (4, 5) for i in range(len(marked) - n + 1)}
    return grams | {f"={word}"}


class Model(NamedTuple):
    """What a worker needs: terms with their weights, and the examples as (ids, labels, sparse rows)."""

    terms: Sequence[str]  # those that tell the labels apart come first
    idf: np.ndarray
    ids: Sequence[int]
    toxic: Sequence[int]
    rows: Sequence[tuple[Sequence[int], Sequence[float]]]
    curve: tuple[tuple[float, ...], tuple[float, ...]]  # vote to probability, as steps
    base: float  # probability of a text without any term
    key: str = ""  # equal for models with equal terms and rows


class WordTerms(dict):
    """Word to the numbers of its terms; memory is bounded by starting anew."""

    def __init__(self, terms: Sequence[str]) -> None:
        super().__init__()
        self.number = {t: i for i, t in enumerate(terms)}
        self.grams = ahocorasick.Automaton()
        for term, i in self.number.items():
            if term and not term.startswith("="):
                self.grams.add_word(term, i)
        self.grams.make_automaton()

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = {i for _, i in self.grams.iter(f"^{word}$")} if len(self.grams) else set()
        if (whole := self.number.get(f"={word}")) is not None:
            found.add(whole)
        out = self[word] = tuple(sorted(found))
        return out


def vector(text: str | None, known: WordTerms, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers and unit-length weights ``(1 + ln tf) * idf`` of a whole text."""
    count: dict[int, int] = {}
    for word, times in Counter(words(text)).items():
        for term in known[word]:
            count[term] = count.get(term, 0) + times
    at = np.fromiter(count, np.int64, len(count))
    order = np.argsort(at)
    at, times = at[order], np.fromiter(count.values(), np.float64, len(count))[order]
    raw = (1.0 + np.log(times)) * idf[at]
    return at, raw / np.sqrt(raw @ raw) if at.size else raw


def spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All positions of the ranges from ``start`` to before ``end``, one range after the other."""
    size = end - start
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


class BlockMaxIndex:
    """Posting lists by term, cut where a block of examples ends, with the largest weight of each cut."""

    def __init__(self, model: Model) -> None:
        # Examples with like terms share blocks, so block maxima say more.
        order = sorted(range(len(model.ids)), key=lambda i: (tuple(model.rows[i][0][:BLOCK]), model.toxic[i], model.ids[i]))
        sizes = np.array([len(model.rows[i][0]) for i in order], np.int64)
        term = np.concatenate([np.zeros(0, np.int32), *(np.asarray(model.rows[i][0], np.int32) for i in order)])
        weight = np.concatenate([np.zeros(0, np.float32), *(np.asarray(model.rows[i][1], np.float32) for i in order)])
        by_term = np.argsort(term, kind="stable")
        term = term[by_term]
        self.weight = weight[by_term]
        self.place = np.repeat(np.arange(len(order), dtype=np.int32), sizes)[by_term]
        block = self.place // BLOCK
        new = np.ones(term.size, bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        self.first = np.append(np.flatnonzero(new), term.size)  # where the postings of a cut begin
        self.block = block[new]
        self.most = np.maximum.reduceat(self.weight, self.first[:-1]) if term.size else self.weight
        self.cuts = np.searchsorted(term[new], np.arange(len(model.terms) + 1))  # the cuts of a term
        self.blocks = -(-len(order) // BLOCK)
        self.ids = np.array([model.ids[i] for i in order], np.int64)
        self.toxic = np.array([model.toxic[i] for i in order], np.float64)

    def nearest(self, at: Sequence[int], weight: Sequence[float], leave: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the ``NEIGHBOURS`` best examples, exact; ties by place; ``leave`` is left out."""
        t, w = np.asarray(at, np.int64), np.asarray(weight, np.float64)
        start, end = self.cuts[t], self.cuts[t + 1]
        cut, w = spans(start, end), np.repeat(w, end - start)
        block = self.block[cut]
        bound = np.bincount(block, w * self.most[cut], self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        places, cosines = np.zeros(0, np.int64), np.zeros(0)
        done, many = 0, BLOCKS_AT_ONCE
        while done < order.size:
            if cosines.size == NEIGHBOURS:
                order = order[: done + np.searchsorted(-bound[order[done:]], 1e-6 - cosines[-1], "right")]
            some, done, many = order[done : done + many], done + many, many * 2
            if not some.size:
                break
            wanted = np.zeros(self.blocks, bool)
            wanted[some] = True
            use = np.flatnonzero(wanted[block])
            first, last = self.first[cut[use]], self.first[cut[use] + 1]
            posting = spans(first, last)
            score = np.bincount(self.place[posting], np.repeat(w[use], last - first) * self.weight[posting], self.ids.size)
            own = np.flatnonzero(score)
            if leave is not None:
                own = own[self.ids[own] != leave]
            places, cosines = np.concatenate([places, own]), np.concatenate([cosines, score[own]])
            best = np.lexsort((places, -cosines))[:NEIGHBOURS]
            places, cosines = places[best], cosines[best]
        return places, cosines

    def vote(self, at, weight, leave: int | None = None) -> tuple[float, list[int]] | None:
        """Share of toxic votes, weighted by distance, and the nearest ids; None without a neighbour."""
        if not len(at) or not self.ids.size:
            return None
        places, cosines = self.nearest(at, weight, leave)
        if not places.size:
            return None
        votes = 1.0 / (np.maximum(0.0, 1.0 - cosines) + NEAR)
        return float(votes @ self.toxic[places] / votes.sum()), self.ids[places[:EVIDENCE]].tolist()


def _loaded(model: Model) -> tuple[WordTerms, BlockMaxIndex]:
    return worker_model(("toxicity", model.key), lambda: (WordTerms(model.terms), BlockMaxIndex(model)))


def calibrated(vote: float, curve: tuple[tuple[float, ...], tuple[float, ...]]) -> float:
    """Nine parts of the calibration curve's probability and one of the vote, which keeps the order."""
    ends, values = curve
    if not ends:
        return vote
    return min(1.0, max(0.0, 0.9 * float(np.interp(vote, ends, values)) + 0.1 * vote))


def calibration_curve(votes: list[float], labels: list[int]) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Votes to probabilities that never fall: neighbouring pools merge until they ascend."""
    pools: list[list[float]] = []  # [count, positives, sum of votes]
    for v, y in sorted(zip(votes, labels, strict=True)):
        if pools and pools[-1][2] / pools[-1][0] == v:
            pools[-1] = [pools[-1][0] + 1, pools[-1][1] + y, pools[-1][2] + v]
        else:
            pools.append([1, y, v])
        while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top, strict=True)]
    return tuple(p[2] / p[0] for p in pools), tuple((p[1] + 0.25) / (p[0] + 0.5) for p in pools)


def labelled_examples(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, toxic, text`` of at most ``EXAMPLES`` labelled rows that aren't held out.

    Ids with the smallest hashes; several labels of an id count as toxic if one does, and of
    several texts the smallest stays.
    """
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    marks = marks.groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    marks = materialize(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES), "toxic-labels")
    texts = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")  # at most EXAMPLES rows
    return texts.groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def _term_counts(batches):
    """Documents with each term, by label, summed up per task."""
    counts: tuple[Counter, Counter] = Counter(), Counter()
    for batch in batches:
        for toxic, text in rows_of(batch, "toxic", "text"):
            counts[toxic].update(set().union(*map(word_terms, set(words(text)))))
    both = list(counts[0].keys() | counts[1].keys())
    for start in range(0, len(both), 100_000):
        some = both[start : start + 100_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array([counts[1][t] for t in some]), pa.array([counts[0][t] for t in some])],
            ["term", "pos", "neg"],
        )


def weighted_terms(examples: DataFrame, positives: int, negatives: int) -> list[tuple[str, float]]:
    """All words of the examples and the grams that tell the labels apart, each with its weight, those that do first."""
    sums = examples.select("toxic", "text").mapInArrow(tidy(_term_counts), "term string, pos long, neg long")
    sums = sums.groupBy("term").agg(F.sum("pos").alias("a"), F.sum("neg").alias("b"))
    n = float(positives + negatives)
    cross = F.col("a") * F.lit(float(negatives)) - F.col("b") * F.lit(float(positives))
    seen = F.col("a") + F.col("b")
    spread = seen * (n - seen) * F.lit(float(positives)) * F.lit(float(negatives))
    chi2 = F.when(spread > 0, n * cross * cross / spread).otherwise(0.0)
    telling = (chi2 >= LEAST_CHI2) & (seen >= LEAST_DOCS)
    found = sums.select("term", seen.alias("df"), telling.alias("telling")).where(F.col("telling") | F.startswith("term", F.lit("=")))
    got = found.toArrow().to_pydict()
    weight = [(math.log((1 + n) / (1 + df)) + 1.0) * (1.0 if tells else WEAK) for df, tells in zip(got["df"], got["telling"], strict=True)]
    rows = sorted(zip([not t for t in got["telling"]], got["term"], weight, strict=True))
    return [(term, w) for _, term, w in rows]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Terms, index and calibration from at most ``EXAMPLES`` labelled rows; all on the driver is bounded by them."""
    spark = docs.sparkSession
    examples = materialize(labelled_examples(docs, labels), "toxic-examples")
    count = {r["toxic"]: r["count"] for r in examples.groupBy("toxic").count().collect()}
    positives, negatives = count.get(1, 0), count.get(0, 0)
    chosen = weighted_terms(examples, positives, negatives) if positives and negatives else []
    terms, idf = [t for t, _ in chosen], np.array([w for _, w in chosen], np.float64)
    vocabulary = spark.sparkContext.broadcast((terms, idf))

    def vectors(batches):
        terms, idf = vocabulary.value
        known = WordTerms(terms)
        for batch in batches:
            for part in sub_batches(batch, 256):
                made = [vector(t, known, idf) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("toxic"), pa.array([a for a, _ in made], pa.list_(pa.int32())), pa.array([w for _, w in made], pa.list_(pa.float64()))],
                    ["doc_id", "toxic", "at", "weight"],
                )

    rows = examples.mapInArrow(tidy(vectors), "doc_id long, toxic int, at array<int>, weight array<double>")
    rows = materialize(rows, "toxic-vectors")
    vocabulary.destroy()
    got = rows.toArrow().combine_chunks().sort_by("doc_id")
    sizes = pc.list_value_length(got["at"]).to_numpy()
    toxic, ids = got["toxic"].to_numpy(), got["doc_id"].to_numpy()
    ends = np.cumsum(sizes)[:-1] if sizes.size else []
    at = np.split(pc.list_flatten(got["at"]).to_numpy().astype(np.int32), ends)
    weight = np.split(pc.list_flatten(got["weight"]).to_numpy().astype(np.float32), ends)
    rate = positives / max(1, positives + negatives)
    bare = toxic[sizes == 0]
    base = (float(bare.sum()) + rate) / (bare.size + 1)
    own = np.flatnonzero(sizes).tolist()
    model = Model(
        terms, idf, ids[own].tolist(), toxic[own].tolist(), [(at[i], weight[i]) for i in own], ((), ()), base, uuid.uuid4().hex,
    )
    shared = spark.sparkContext.broadcast(model)

    def left_out(batches):
        index = _loaded(shared.value)[1]
        for batch in batches:
            votes = [index.vote(tuple(a), tuple(w), leave=i) for i, a, w in rows_of(batch, "doc_id", "at", "weight")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array([v and v[0] for v in votes], pa.float64())], ["toxic", "vote"]
            )

    own = rows.mapInArrow(tidy(left_out), "toxic int, vote double").where("vote is not null").collect()
    shared.destroy()
    return model._replace(curve=calibration_curve([r["vote"] for r in own], [r["toxic"] for r in own]))


def _scores(model: Model, loaded: tuple[WordTerms, BlockMaxIndex], texts: list[str | None], seen: dict) -> list[tuple[float, list[int]]]:
    known, index = loaded
    out = []
    for text in texts:
        key = hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if key not in seen:
            if len(seen) >= 50_000:
                seen.clear()
            vote = index.vote(*vector(text, known, model.idf))
            seen[key] = (model.base, []) if vote is None else (calibrated(vote[0], model.curve), vote[1])
        out.append(seen[key])
    return out


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence`` for every row of ``docs``.

    ``docs`` needs ``doc_id`` and ``text``, ``labels`` ``doc_id`` and ``toxic``; other columns aren't read.
    ``evidence`` holds the ids of the nearest examples. A text without any word of them (null and
    empty texts too) gets the toxic share of such examples; without labels of both kinds every
    score is the share of toxic labels. Null labels and ids teach nothing. Repeated
    rows get equal scores; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        seen: dict = {}
        model = shared.value
        loaded = _loaded(model)
        for batch in batches:
            for part in sub_batches(batch, 256):
                got = _scores(model, loaded, part.column("text").to_pylist(), seen)
                score = [s for s, _ in got]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("held_out"), pa.array(score, pa.float64()),
                        pa.array([int(s >= THRESHOLD) for s in score], pa.int32()),
                        pa.array([e for _, e in got], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "held_out", "score", "predicted", "evidence"],
                )

    rows = small_batches(docs.select("doc_id", held_out().alias("held_out"), "text"))
    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int, evidence array<long>")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below ``THRESHOLD``; all columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        seen: dict = {}
        model = shared.value
        loaded = _loaded(model)
        for batch in batches:
            for part in sub_batches(batch, 256):
                got = _scores(model, loaded, part.column("text").to_pylist(), seen)
                yield part.filter(pa.array([s < THRESHOLD for s, _ in got]))

    return small_batches(docs).mapInArrow(tidy(run), docs.schema)
