"""What the language samples hold, and letters of any script."""

from __future__ import annotations

import random

from rowferry.llm import language

DOCS = "doc_id long, text string, lang string"


def made_words(letters, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(150)]


def test_a_long_shared_header_and_copies_do_not_fill_the_sample(spark):
    words = {"aa": made_words("abcdefgh", 1), "bb": made_words("efghijkl", 2)}
    rng = random.Random(3)

    def body(lang, n=120):
        return " ".join(rng.choice(words[lang]) for _ in range(n))

    header, copy = body("bb", 60), body("bb", 200)
    rows = [(i, f"{header}\n{body('aa')}", "aa") for i in range(400)]
    rows += [(1_000 + i, copy, "aa") for i in range(300)]
    rows += [(2_000 + i, body("bb"), "bb") for i in range(400)]
    rows += [(3_000 + i, body("aa", 30), None) for i in range(50)] + [(4_000 + i, body("bb", 30), None) for i in range(50)]
    docs = spark.createDataFrame(rows, DOCS)
    samples = dict(language.language_samples(docs.where("lang is not null"), language.F.lit(True)))
    assert sum(map(len, samples.values())) <= language.SAMPLE_CHARS + 2 * language.SAMPLE_ROWS
    assert samples["aa"].count(copy[:60]) <= 1
    own = sum(w in set(words["aa"]) for w in samples["aa"].split())
    assert own > 0.4 * len(samples["aa"].split())
    found = {r["doc_id"]: r["lang_pred"] for r in language.predict_language(docs).collect()}
    assert all(found[i] == ("aa" if i < 4_000 else "bb") for i in found if i >= 3_000)


def test_every_letter_of_the_samples_counts():
    common = "".join(map(chr, range(0x4E00, 0x4E00 + 126)))
    ours, theirs = (made_words("".join(map(chr, range(a, a + 300))), a) for a in (0x5000, 0x6000))
    samples = (("ja", " ".join([common] * 9 + ours)), ("zh", " ".join([common] * 2 + theirs[:100])))
    codes, automata = language.build(samples)
    assert len(codes.letters) > 400
    for lang, words in (("ja", ours), ("zh", theirs[:100])):
        for word in words:
            assert language.identify(word, codes, automata)[0] == lang

    def slow(data, sample):
        count, at = 0, 0
        while at < len(data):
            size = 1
            while at + size < len(data) and data[at : at + size + 1] in sample:
                size += 1
            count, at = count + 1, at + size
        return count

    rng = random.Random(5)
    for a, (_, sample) in zip(automata, samples, strict=True):
        held = "".join(map(chr, codes.encode(sample)))
        for _ in range(200):
            text = " ".join(rng.choice(ours + theirs + ["latin", common[:9]])[: rng.randrange(1, 9)] for _ in range(6))
            data = codes.encode(text)
            assert language.wide_phrases(data, a.moves, a.rare) == slow("".join(map(chr, data)), held)
