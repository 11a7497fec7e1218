"""The pipeline against plain versions of its stages, each on its own input."""

from __future__ import annotations

import corpus_pipeline
import pytest
from brute import contamination, fingerprint, groups, mix_targets, repeats, words

from assayline.llm.common import table


@pytest.fixture(scope="module")
def steps(spark, data, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    docs, out = table(spark, data, "documents"), [table(spark, data, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, data).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns_stay(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1]) and steps[-1].columns == [*steps[0].columns, "copy"]


def test_toxic_documents_go_and_clean_ones_stay(spark, data, steps):
    labels = {r.doc_id: r.toxic for r in table(spark, data, "labels").collect()}
    kept = {i for i, _ in rows(steps[1])}
    clean = [i for i, y in labels.items() if y == 0]
    assert sum(i in kept for i in clean) > 0.97 * len(clean)
    assert kept <= {i for i, _ in rows(steps[0])} and len(kept) < steps[0].count()


def test_one_of_each_group(steps):
    before = rows(steps[1])
    prints = [fingerprint(t) for _, t in before]
    first = [min(before[i][0] for i in g) for g in groups(len(before), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)]
    assert sorted(first) == sorted(i for i, _ in rows(steps[2]))


def test_repeats_are_cut(steps):
    want = {i: (removed, kept) for i, _, removed, kept in repeats(rows(steps[2]), 20)}
    before = dict(rows(steps[2]))
    assert dict(rows(steps[3])) == {i: kept if removed else before[i] for i, (removed, kept) in want.items()}


def test_contaminated_documents_go(spark, data, steps):
    items = [(r.item_id, r.text) for r in table(spark, data, "benchmark").collect()]
    want = [i for i, t in rows(steps[3]) if not contamination(t, items)[3]]
    assert sorted(want) == sorted(i for i, _ in rows(steps[4])) and len(want) < steps[3].count()


def test_mix_comes_near_targets(steps):
    sizes: dict = {}
    for r in steps[4].collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    taken: dict = {}
    for r in steps[5].collect():
        taken[r.source] = taken.get(r.source, 0) + len(words(r.text))
    for source, target in mix_targets(sizes).items():
        assert abs(taken.get(source, 0) - target) <= 0.35 * max(target, 100)
    assert steps[5].groupBy("doc_id", "copy").count().where("count > 1").count() == 0


def test_run_gives_the_last_stage(spark, data, steps):
    assert sorted(map(str, corpus_pipeline.run(spark, data).collect())) == sorted(map(str, steps[-1].collect()))


def test_stages_bear_awkward_rows(spark, data, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted int, n_words long, removed string, size int, copy string, _batch int, fp long"
    rest = ("en", "s", 1, "sc", 7, 8, "r", 9, "c", 10, 11)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two three"), (4, "one two three"), (5, "word " * 20_000), (None, "some text"), (None, None)]
    docs = spark.createDataFrame([(*r, *rest) for r in rows] + [(9, "nulls everywhere", *[None] * 11)], schema)
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), data).count() == 0
        stage(spark, seen, data).write.parquet(str(tmp_path / name))
        seen = spark.read.parquet(str(tmp_path / name))
        if name == "simhash_near_dedup":
            assert sorted(map(str, (r.doc_id for r in seen.collect()))) == ["1", "4", "4", "5", "9", "None", "None"]
            assert {(r.score, r.predicted, r.size, r.copy, r._batch, r.fp) for r in seen.where("doc_id <> 9").collect()} == {("sc", 7, 9, "c", 10, 11)}
    assert seen.columns == [c for c in docs.columns if c != "copy"] + ["copy"]
    assert {r.doc_id for r in seen.where("doc_id in (4, 5, 9)").collect()} <= {4, 5, 9}
