"""License scan with ordered signature rules, in DataFrame functions only.

Texts become lower-case words. Texts with an anchor are tried against the rules whose keyword
they hold; matches are intervals of words, and an interval inside one of a rule of higher
priority, or of equal priority and earlier in order, is suppressed.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry.llm.license_rules import ANCHORS, rules

BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
BASE_CONFIDENCE = 0.95
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE = "array<struct<index:int,label:string,priority:int,confidence:double,keyword:string,pattern:string>>"
PLACES = "array<struct<label:string,start:int,end:int>>"
MATCHES = "array<struct<start:int,back:int,rank:int,index:int>>"
BLOCK = 256


def rule_literal() -> Column:
    """The rules as one literal array; patterns match whole words only."""
    rows = [
        {"index": i, **r._asdict(), "pattern": rf"(?<![^ ])(?:{r.pattern})(?![^ ])"} for i, r in enumerate(rules())
    ]
    return F.from_json(F.lit(json.dumps(rows)), RULE)


def word_text(text: Column) -> Column:
    """The words of a text with one blank between them and around them; a single blank without words."""
    plain = F.regexp_replace(F.translate(text, UPPER, LOWER), GAPS, " ")
    return F.concat(F.lit(" "), F.trim(plain), F.when(F.trim(plain) != "", F.lit(" ")).otherwise(F.lit("")))


def phrase_places(words: Column, phrase: str) -> Column:
    """Every index at which the phrase's words stand one after the other."""
    parts = phrase.split(" ")

    def here(word: Column, i: Column) -> Column:
        same = word == parts[0]
        for n, part in enumerate(parts[1:], 1):
            same = same & (F.get(words, i + n) == part)
        return F.when(same, i)

    return F.filter(F.transform(words, here), lambda i: i.isNotNull())


def _matches(line: Column, rule: Column) -> Column:
    """The word intervals of a rule's matches: the pattern marks their ends, and marked words are looked up."""
    marked = F.split(F.regexp_replace(line, rule["pattern"], F.lit("\x01$0\x02")), " ")

    def at(words: Column, test) -> Column:
        return F.filter(F.transform(words, lambda w, i: F.when(test(w), i)), lambda i: i.isNotNull())

    def zipped(words: Column) -> Column:
        starts, ends = at(words, lambda w: w.startswith("\x01")), at(words, lambda w: w.endswith("\x02"))
        return F.zip_with(starts, ends, lambda s, e: F.struct(
            s.alias("start"), (-e).alias("back"), (-rule["priority"]).alias("rank"), rule["index"].alias("index"),
        ))

    return F.get(F.transform(F.array(marked), zipped), 0)


def surviving(found: Column) -> Column:
    """The matches that no better match contains, in order of start, longest first.

    In that order every match that contains another comes before it, so it is enough to keep
    the furthest end so far for each priority and above. Matches that stay are gathered in blocks
    of ``BLOCK``, so that a step does not copy all that came before it.
    """
    none = F.lit(-1)
    some = F.array().cast(MATCHES)
    empty = F.struct(
        none.alias("p1"), none.alias("p2"), none.alias("p3"), some.alias("open"), F.array().cast(f"array<{MATCHES}>").alias("full")
    )

    def step(s: Column, m: Column) -> Column:
        end, priority = -m["back"], -m["rank"]
        reach = F.when(priority == 3, s["p3"]).when(priority == 2, s["p2"]).otherwise(s["p1"])
        gone, whole = reach >= end, F.size(s["open"]) >= BLOCK
        return F.struct(
            F.greatest(s["p1"], end).alias("p1"),
            F.when(priority >= 2, F.greatest(s["p2"], end)).otherwise(s["p2"]).alias("p2"),
            F.when(priority >= 3, F.greatest(s["p3"], end)).otherwise(s["p3"]).alias("p3"),
            F.when(gone, s["open"]).when(whole, F.array(m)).otherwise(F.concat(s["open"], F.array(m))).alias("open"),
            F.when(~gone & whole, F.concat(s["full"], F.array(s["open"]))).otherwise(s["full"]).alias("full"),
        )

    return F.aggregate(F.array_sort(found), empty, step, lambda s: F.concat(F.flatten(s["full"]), s["open"]))


def license_matches(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, base, matches`` of every row: the places of base phrases and of rules.

    ``base`` has ``label, start, end`` of every place of a base phrase, phrase by phrase. ``matches`` has
    ``label, start, end, priority, confidence`` of every match of a rule that no better one contains, in
    order of start, longest first. ``start`` and ``end`` are the first and the last word, from 0.
    ``docs`` needs ``doc_id`` and ``text``; other columns aren't read. A null text has no word. Repeated rows
    get equal results; an empty table gives no rows. Rows are independent: nothing is shuffled.
    """
    known = rule_literal()
    line = word_text(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", line.alias("line"))
    gate = F.lit(False)
    for anchor in ANCHORS:
        gate = gate | F.contains("line", F.lit(anchor))
    blanks = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit("")))
    rows = rows.select(
        "doc_id", (F.greatest(blanks - 1, F.lit(0))).cast("long").alias("n_words"), F.when(gate, F.trim("line")).alias("line")
    )
    rows = rows.withColumn("words", F.when(F.col("line").isNotNull(), F.split("line", " ")))

    def placed(label: str, phrase: str) -> Column:
        last = len(phrase.split(" ")) - 1
        places = F.transform(phrase_places(F.col("words"), phrase), lambda i: F.struct(
            F.lit(label).alias("label"), i.alias("start"), (i + last).alias("end"),
        ))
        return F.when(F.contains("line", F.lit(phrase)), places).otherwise(F.array().cast(PLACES))

    def named(m: Column, rule: Column) -> Column:
        return F.struct(
            rule["label"].alias("label"), m["start"].alias("start"), (-m["back"]).alias("end"),
            rule["priority"].alias("priority"), rule["confidence"].alias("confidence"),
        )

    hits = F.flatten(F.transform(F.filter(known, lambda r: F.contains("line", r["keyword"])), lambda r: _matches(F.col("line"), r)))
    kept = F.when(F.col("line").isNotNull(), surviving(hits)).otherwise(F.array().cast(MATCHES))
    return rows.select(
        "doc_id", "n_words", F.concat(*[placed(*b) for b in BASE]).alias("base"),
        F.transform(kept, lambda m: named(m, F.get(known, m["index"]))).alias("matches"),
    )


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every row.

    A summary of ``license_matches``. Base phrases count at every place, and their labels always
    stay; rules add theirs. ``score`` is the largest confidence of what was found, 0 if nothing was.
    """
    sure = F.when(F.size("base") > 0, F.lit(BASE_CONFIDENCE)).otherwise(F.lit(0.0))
    return license_matches(docs).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").cast("long").alias("first_word"), F.array_max("base.start").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base.label")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base.label", "matches.label")), ",").alias("labels"),
        F.greatest(sure, F.coalesce(F.array_max("matches.confidence"), F.lit(0.0))).alias("score"),
    )
