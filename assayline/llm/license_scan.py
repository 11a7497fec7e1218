"""Licence scans: licence words are found by their rarest, templates are fetched by them, and placed by relative position.

A template is a run of licence words with a mandatory key phrase in it.  It is indexed
under the word of its key phrase that the fewest texts have (the highest inverse
document frequency), with that word's position.  A text's words are looked up there;
each hit at word i of a template's word j proposes the template at word i - j, and the
template's other postings are intersected with the text at the same relative
positions.  It stands there if the whole key phrase and at least ``share`` of all its
words do.  A template whose key phrase stands in a text has its index word there, so
the lookup loses nothing, whatever the frequencies are.

All of it is built-in column functions.  A text is a row and stays where it is; what is
shuffled is the number of texts that have each key word, some hundred rows at most.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.operators.spread import evaluate_once

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word of a lower-cased text: ASCII letters and digits, and all that is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Part of a template's words that must stand in place.
SHARE = 0.8


@dataclass(frozen=True)
class Template:
    """A label, the words that tell it, and the phrase among them that must be whole; ``base`` ones are counted and placed."""

    label: str
    text: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_words(self) -> list[str]:
        return self.key.split()

    @property
    def key_at(self) -> int:
        """Where the key phrase starts."""
        n = len(self.key_words)
        found = [i for i in range(len(self.words) - n + 1) if self.words[i : i + n] == self.key_words]
        if not n or not found:
            raise ValueError(f"the key phrase of {self.label!r} is not in its text")
        return found[0]


def phrase(label: str, text: str, base: bool = False) -> Template:
    """A template that is its key phrase."""
    return Template(label, text, text, base)


# The phrases of the contract, and sentences of public licence notices.
TEMPLATES = (
    phrase("gpl", "gnu general public license", base=True),
    phrase("apache", "apache license", base=True),
    phrase("cc-by", "cc by", base=True),
    phrase("mit", "mit license", base=True),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "free software you can redistribute it"),
    phrase("lgpl", "gnu lesser general public license"),
    phrase("agpl", "gnu affero general public license"),
    Template("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("apache-2", "licensed under the apache license version 2 0", "apache license version 2 0"),
    phrase("cc-by-nc", "cc by nc"),
    phrase("cc-by-sa", "cc by sa"),
    phrase("cc-by-nd", "cc by nd"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    Template("cc0", "cc0 1 0 universal", "cc0 1 0"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    phrase("all-rights-reserved", "all rights reserved"),
)


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def texts_with(docs: DataFrame, text: str, wanted: Sequence[str]) -> dict[str, int]:
    """In how many texts each wanted word is; as many rows come back as there are wanted words."""
    if not wanted:
        return {}
    have = docs.select(F.explode(F.array_intersect(words_of(F.col(text)), F.array(*map(F.lit, wanted)))).alias("word"))
    return {r["word"]: r["n"] for r in have.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


def positional_index(templates: Sequence[Template], texts: dict[str, int]) -> dict[str, list[tuple[int, int]]]:
    """Postings (template, position) under the rarest word of each key phrase; ties go to the smaller word."""
    index: dict[str, list[tuple[int, int]]] = {}
    for t, template in enumerate(templates):
        word = min(template.key_words, key=lambda w: (texts.get(w, 0), w))
        index.setdefault(word, []).append((t, template.key_at + template.key_words.index(word)))
    return index


def _literal(index: dict[str, list[tuple[int, int]]]) -> Column:
    post = lambda t, j: F.struct(F.lit(t).alias("t"), F.lit(j).alias("j"))
    return F.create_map(*[x for word, posts in sorted(index.items()) for x in (F.lit(word), F.array(*[post(*p) for p in posts]))])


def scan_licenses(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: Sequence[Template] = TEMPLATES, share: float = SHARE
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and ``places``.

    ``places`` are the templates that stand in the text: label, base, start (words from 0)
    and part (of the template's words in place), by start, then template.  A place may
    begin before the text does or end behind it, if enough of it is inside.  n_base
    counts base places, first_word and last_word are their smallest and largest start
    (else null); labels are distinct, sorted and joined by commas; score is the largest
    part, 0 without places.

    Null and empty texts have no words, empty labels and score 0.  Rows are judged one by
    one, so null and repeated ids, repeated rows and empty tables need no care, and other
    columns of ``docs`` are not read.  No templates: no labels.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    index = positional_index(templates, texts_with(docs, text, sorted({w for t in templates for w in t.key_words})))
    cut = evaluate_once(rows, ["doc_id"], words=words_of(F.col("_text")))
    kinds = "array<struct<label: string, base: boolean, start: int, part: double>>"
    if index:
        rare = F.filter(F.transform("words", lambda w, i: F.when(w.isin(*index), i)), lambda i: i.isNotNull())
        proposed = lambda i: F.transform(F.element_at(_literal(index), F.get("words", i)), lambda p: F.struct(p["t"].alias("t"), (i - p["j"]).alias("start")))
        cut = evaluate_once(cut, ["doc_id", "words"], at=F.flatten(F.transform(rare, proposed)))
        every = F.array(*[
            F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.array(*map(F.lit, t.words)).alias("words"), F.lit(t.key_at + 1).alias("key"), F.lit(len(t.key_words)).alias("n"))
            for t in templates
        ])

        def judged(p: Column) -> Column:
            template = F.get(every, p["t"])
            agree = F.transform(template["words"], lambda w, j: F.coalesce(F.get("words", p["start"] + j) == w, F.lit(False)))
            part = F.size(F.filter(agree, lambda x: x)) / F.size(agree)
            whole = F.forall(F.slice(agree, template["key"], template["n"]), lambda x: x)
            return F.struct(template["label"].alias("label"), template["base"].alias("base"), p["start"].alias("start"), part.alias("part"), whole.alias("whole"), p["t"].alias("t"))

        stand = F.filter(F.transform("at", judged), lambda x: x["whole"] & (x["part"] >= share))
        order = F.array_sort(stand, lambda x, y: F.when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1)).otherwise(F.when(x["t"] < y["t"], -1).when(x["t"] > y["t"], 1).otherwise(0)))
        places = F.transform(order, lambda x: F.struct(x["label"].alias("label"), x["base"].alias("base"), x["start"].alias("start"), x["part"].alias("part")))
    else:
        places = F.array().cast(kinds)
    found = evaluate_once(cut, ["doc_id", F.size("words").cast("long").alias("n_words")], places=places)
    base = F.filter("places", lambda x: x["base"])
    names = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["label"]))), ",")
    starts = F.transform(base, lambda x: x["start"].cast("long"))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("places")).alias("labels"), F.coalesce(F.array_max(F.transform("places", lambda x: x["part"])), F.lit(0.0)).alias("score"), "places",
    )
