"""Neighbours over whole TF-IDF vectors, benchmark items held against all pairs, revisits of a hot page."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from rowferry.llm import decontaminate, toxicity, warc_convert
from rowferry.llm.tables import table

SMALL = "/root/testdata/sf0.01"


def test_toxic_neighbours_equal_cosines_over_all_words_of_a_table(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    model = toxicity.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    words = {w for i in model.ids for w in toxicity.words(texts[i])}
    assert {f"={w}" for w in words} <= set(model.terms)
    weight = dict(zip(model.terms, model.idf, strict=True))

    def whole(text):
        count = Counter()
        for word, times in Counter(toxicity.words(text)).items():
            count.update({t: times for t in toxicity.word_terms(word) if t in weight})
        raw = {t: (1 + math.log(n)) * weight[t] for t, n in count.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {t: x / norm for t, x in raw.items()}

    examples = [whole(texts[i]) for i in model.ids]
    known, index = toxicity.WordTerms(model.terms), toxicity.BlockMaxIndex(model)
    some = sorted(texts)[:: max(1, len(texts) // 150)]
    for i in some:
        query = whole(texts[i])
        want = np.sort([sum(x * e.get(t, 0.0) for t, x in query.items()) for e in examples])[::-1][: toxicity.NEIGHBOURS]
        _, got = index.nearest(*toxicity.vector(texts[i], known, model.idf), None)
        assert np.allclose(got, want[want > 0], atol=1e-5)
    scored = toxicity.score_toxicity(docs, labels)
    assert scored.where(F.size("evidence") == 0).count() <= 0.01 * len(texts)


def _edits(item: bytes, text: bytes) -> int:
    """Fewest edits that turn the item into some part of the text."""
    m = len(item)
    steps, goal = np.arange(m + 1), np.frombuffer(item, np.uint8)
    column, best = steps.copy(), m
    for byte in text:
        new = np.empty(m + 1, int)
        new[0] = 0
        new[1:] = np.minimum(column[:-1] + (goal != byte), column[1:] + 1)
        column = np.minimum.accumulate(new - steps) + steps
        best = min(best, int(column[-1]))
    return best


def _items_and_texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 8))) for _ in range(60)]
    items = [(n, " ".join(rng.choices(vocabulary, k=rng.randrange(4, 16)))) for n in range(14)]
    texts = []
    for n in range(36):
        text = " ".join(rng.choices(vocabulary, k=rng.randrange(0, 30)))
        quoted = list(rng.choice(items)[1])
        for _ in range(n % 9):
            at = rng.randrange(len(quoted))
            quoted[at : at + rng.randrange(2)] = rng.choices("abcxyz", k=rng.randrange(2))
        texts.append((n, text + " " + "".join(quoted) + " " + text[::-1]))
    return items, texts


def test_items_found_are_all_pairs_within_their_budget(spark):
    items, texts = _items_and_texts()
    want = set()
    for item, words in items:
        for doc, text in texts:
            edits = _edits(words.encode(), decontaminate.normal(text))
            if edits <= decontaminate.budget(len(words)):
                want.add((doc, item, edits))
    found = decontaminate.contaminations(
        spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    assert len(want) > 10
    assert {(r["doc_id"], r["item_id"], r["edits"]) for r in found.collect()} == want


def test_rows_do_not_depend_on_the_block_size(spark, monkeypatch):
    items, texts = _items_and_texts()
    items += [(n + 50, "  " + t.upper().replace(" ", "\t ")) for n, t in items] + [(None, items[0][1]), (99, " "), (98, None)]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows, kept = decontaminate.contaminations(docs, bench).collect(), decontaminate.keep_uncontaminated(docs, bench).collect()
    assert max(r["item_id"] for r in rows) < 50
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 200)
    assert len(list(decontaminate.benchmark_blocks(bench))) > 3
    assert sorted(decontaminate.contaminations(docs, bench).collect()) == sorted(rows)
    assert sorted(decontaminate.keep_uncontaminated(docs, bench).collect()) == sorted(kept)


def test_revisits_of_a_hot_page_and_records_that_name_none(spark):
    hot = "<p>" + "x" * 200
    rows = [(n, f"http://a/{n}", hot if n % 3 else f"{n} " + "y" * 150) for n in range(60)] + [(None, None, None), (70, None, hot)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc_convert.pages_round_trip(pages).collect()}
    assert len(got) == len(rows)
    again = [n for n, _, html in rows if html == hot and n != 1]
    assert all(got[n]["record_type"] == "revisit" and got[n]["refers_to"] == 1 and got[n]["payload_bytes"] == len(hot) for n in again)
    assert all(r["refers_to"] is None and r["record_type"] == "response" for n, r in got.items() if n not in again)
    assert len({got[n]["payload_digest"] for n in [1, *again]}) == 1
