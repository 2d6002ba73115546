"""Licence scan on a positional rare-token index, with DataFrame functions only.

Templates are word sequences: the base phrases, which are mandatory as a whole, and longer passages of licence texts with
key phrases that must be present. Each word's inverse document frequency is counted over all documents. The index
holds, for each of a template's `RARE` words of highest frequency weight, the places in the template. A file is reduced
to the places of index words; a place minus the word's place in a template is a possible start of the template, and
words that agree on a start confirm each other: the start's share is the weight of the template's words found at their
relative places. A passage counts from `SHARE` on, if all its key phrases stand where the start puts them; a start may lie
before the text, whose missing words then count as not found. A base phrase counts only whole. No text is cut, and any number of places is followed.

The template table is fixed and small, so it is part of the plan. A file without any index word costs one pass over its
words. Everything about a file is computed in its own row: nothing is shuffled but the counts of template words.

Edge cases: null and empty texts have no words, places or labels, and score 0. Repeated rows get a row each. Phrases may
overlap; each start counts. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlog.llm.common import ascii_lower, text_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and labels: fixed values.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Label, passage and key phrases of the method's own templates: short public licence notices, fixed values.
PASSAGES = (
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("mit-notice", "released under the mit license", ("mit license",)),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        ("hereby granted free of charge",),
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
)
#: Index words of a template, and the share of weight from which a passage counts.
RARE, SHARE = 4, 0.6


def words(text: Column) -> Column:
    """Words of a whole text with A-Z lower-cased."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def templates() -> list[tuple[str, list[str], list[list[str]], bool]]:
    """Label, words, key phrases and whether it is a base phrase."""
    base = [(label, phrase.split(), [phrase.split()], True) for phrase, label in PHRASES]
    return base + [(label, passage.split(), [k.split() for k in keys], False) for label, passage, keys in PASSAGES]


def word_weights(docs: DataFrame, text: str = "text") -> tuple[int, dict[str, float]]:
    """Number of documents, and the inverse document frequency of every template word, over all documents."""
    vocabulary = sorted({w for _, ws, _, _ in templates() for w in ws})
    found = docs.select(F.array_intersect(words(text_of(text)), F.array(*map(F.lit, vocabulary))).alias("w"))
    rows = found.select(F.explode_outer(F.concat(F.array(F.lit("")), "w")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    seen = {r.w: r.n for r in rows}  # one row per template word and one for all documents
    total = seen.pop("", 0)
    return total, {w: math.log((total + 1) / (seen.get(w, 0) + 0.5)) for w in vocabulary}


def _at(all_words: Column, start: Column, word: str, place: int) -> Column:
    """Whether the template's word stands at its relative place; false outside the text."""
    return F.coalesce(F.get(all_words, (start + place).cast("int")) == word, F.lit(False))


def rarest(template: list[str], base: bool, weights: dict[str, float]) -> list[str]:
    """Index words of a template; one does for a base phrase, of which every word must stand."""
    return sorted(set(template), key=lambda w: (-weights[w], w))[: 1 if base else RARE]


def _starts(places: Column, template: list[str], rare: list[str]) -> Column:
    """Possible starts: places of the template's rarest words less their relative places, without repetition."""
    shifts = {w: [i for i, x in enumerate(template) if x == w] for w in rare}
    found = F.filter(places, lambda p: p["word"].isin(*rare))

    def back(p: Column) -> Column:
        moves = F.array().cast("array<int>")
        for w, at in shifts.items():
            moves = F.when(p["word"] == w, F.array(*map(F.lit, at))).otherwise(moves)
        return F.transform(moves, lambda m: p["place"] - m)

    return F.array_distinct(F.flatten(F.transform(found, back)))


def _share(all_words: Column, start: Column, template: list[str], weights: dict[str, float]) -> Column:
    total = sum(weights[w] for w in template)
    hits = [F.when(_at(all_words, start, w, i), weights[w]).otherwise(0.0) for i, w in enumerate(template)]
    return sum(hits[1:], hits[0]) / F.lit(total)


def _keys_hold(all_words: Column, start: Column, template: list[str], keys: list[list[str]]) -> Column:
    holds = F.lit(True)
    for key in keys:
        first = next(i for i in range(len(template)) if template[i : i + len(key)] == key)
        for i, word in enumerate(key):
            holds = holds & _at(all_words, start, word, first + i)
    return holds


def _measures(all_words: Column, template: list[str], keys: list[list[str]], weights: dict[str, float]):
    """Two functions of a start: its share, and whether the template counts there."""

    def share(start: Column) -> Column:
        return _share(all_words, start, template, weights)

    def holding(start: Column) -> Column:
        return _keys_hold(all_words, start, template, keys) & (share(start) >= SHARE)

    return share, holding


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per file: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    _, weights = word_weights(docs, text)
    index = sorted({w for _, template, _, base in templates() for w in rarest(template, base, weights)})
    rows = docs.select(F.col(key).alias("doc_id"), words(text_of(text)).alias("words"))
    has_any = F.arrays_overlap("words", F.array(*map(F.lit, index)))
    place = F.filter(
        F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("place"))), lambda p: p["word"].isin(*index)
    )
    none = F.array().cast("array<struct<word:string,place:int>>")
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), "words", F.when(has_any, place).otherwise(none).alias("places"))
    starts, labels, shares = {}, [], []
    for number, (label, template, keys, base) in enumerate(templates()):
        possible = _starts(F.col("places"), template, rarest(template, base, weights))
        share, holding = _measures(F.col("words"), template, keys, weights)
        holds = F.filter(possible, holding)
        if base:
            starts[number] = holds
            continue
        best = F.array_max(F.transform(holds, share))
        labels.append(F.when(F.size(holds) > 0, label))
        shares.append(F.coalesce(best, F.lit(0.0)))
    rows = rows.select(
        "doc_id", "n_words", *[s.alias(f"starts_{n}") for n, s in starts.items()], F.array(*labels).alias("own"), F.greatest(*shares).alias("best")
    )
    base_starts = F.concat(*[F.col(f"starts_{n}") for n in starts])
    base = F.array_sort(F.array_compact(F.array(*[F.when(F.size(f"starts_{n}") > 0, templates()[n][0]) for n in starts])))
    return rows.select(
        "doc_id",
        "n_words",
        F.size(base_starts).cast("long").alias("n_base"),
        F.array_min(base_starts).cast("long").alias("first_word"),
        F.array_max(base_starts).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.array_compact("own")))), ",").alias("labels"),
        F.when(F.size(base) > 0, 1.0).otherwise(F.col("best")).alias("score"),
    )
