"""Licence scans against a version that tries every template at every word."""

from __future__ import annotations

import random
import re

from assayline.llm import license_scan
from assayline.llm.license_scan import TEMPLATES, Template, phrase, scan_licenses


def plain(text, templates, share):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found = []
    for t, x in enumerate(templates):
        for start in range(-len(x.words), len(words)):
            agree = [0 <= start + j < len(words) and words[start + j] == w for j, w in enumerate(x.words)]
            if sum(agree) >= share * len(agree) and all(agree[x.key_at : x.key_at + len(x.key_words)]):
                found.append((start, t, x.label, x.base, sum(agree) / len(agree)))
    base = [f[0] for f in found if f[3]]
    names = lambda fs: ",".join(sorted({f[2] for f in fs}))
    return len(words), len(base), min(base, default=None), max(base, default=None), names([f for f in found if f[3]]), names(found), max((f[4] for f in found), default=0.0), [(f[2], f[0]) for f in sorted(found)]


def texts():
    rng = random.Random(3)
    out = [None, "", "  \n", "MIT License", "mit-license, MIT LICENSE", "the apache licence", "CC BY-NC 4.0 cc by", "gnu general public\tlicense", "ünmit license élan MIT", "by cc by cc by"]
    for t in TEMPLATES:
        for _ in range(3):
            words = t.words
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = rng.choice(["x", "the", "license", "mit"])
            pad = " ".join(rng.choice(["word", "license", "of", "gnu", "the"]) for _ in range(rng.randrange(30)))
            out.append(f"{pad} {'/ '.join(words)}; {pad}")
    out.append("apache license " * 20_000)
    out += [out[3]] * 200
    return out


def test_every_template_everywhere(spark):
    rows = [(None if i % 7 == 0 else i % 40, t, i, "x") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long, labels string")
    got = sorted(repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, [(p.label, p.start) for p in r.places])) for r in scan_licenses(docs.repartition(4)).collect())
    assert got == sorted(repr((i, *plain(t, TEMPLATES, license_scan.SHARE))) for i, t, _, _ in rows)


def test_own_templates_and_none(spark):
    own = [Template("a", "one two three four", "three"), phrase("b", "four", base=True), Template("a", "two two", "two two")]
    docs = spark.createDataFrame([(1, "one two three four"), (2, "two two three x"), (3, "two three"), (4, "three four three four")], "doc_id long, text string")
    for share in (0.5, 0.75, 1.0):
        got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, [(p.label, p.start) for p in r.places]) for r in scan_licenses(docs, templates=own, share=share).collect()}
        assert got == {r.doc_id: plain(r.text, own, share) for r in docs.collect()}
    assert {(r.labels, r.score) for r in scan_licenses(docs, templates=[]).collect()} == {("", 0.0)}
    assert scan_licenses(docs.limit(0)).count() == 0


def test_plan_is_native_and_keeps_texts_in_place(spark):
    docs = spark.createDataFrame([(1, "mit license")], "doc_id long, text string")
    plan = scan_licenses(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange|Join", plan)
