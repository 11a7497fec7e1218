"""Learned operators: held-out results, exact parts against plain versions, edge rows."""

from __future__ import annotations

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayline.llm import language_model, nn_descent, quality, toxicity
from assayline.llm.common import checkpoint_dir, clear_pins
from assayline.llm.graph import components

EDGE = [(9001, None, "x"), (9002, "", "x"), (None, "plain words here", "x"), (9003, "word " * 30_000, "x")]


def labelled(n, mark, clean):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = [f"n{rng.randrange(500)}" for _ in range(rng.randrange(30, 90))]
        for _ in range(4):
            text.insert(rng.randrange(len(text)), rng.choice(mark if bad else clean))
        rows.append((i, " ".join(text), "x"))
        labels.append((i, int(bad)))
    return rows, labels


@pytest.mark.parametrize("score, label, folds, held_out", [(toxicity.score_toxicity, "toxic", 3, 1), (quality.score_quality, "quality", 5, 0)])
def test_classifier(spark, score, label, folds, held_out):
    rows, labels = labelled(600, ["awful", "vile!", "rotten"], ["nice", "good", "n7"])
    docs = spark.createDataFrame([*rows, *EDGE, rows[5]], "doc_id long, text string, extra string")
    table = spark.createDataFrame([*labels, (None, 1), (7, None), (99_999, 1)], f"doc_id long, {label} int")
    got = score(docs, table).collect()
    assert len(got) == len(rows) + len(EDGE) + 1 and all(0 <= r.score <= 1 for r in got)
    held = {r.doc_id: r.predicted for r in got if r.held_out}
    assert all(zlib.crc32(str(i).encode()) % folds == held_out for i in held)
    truth = dict(labels)
    assert np.mean([held[i] == truth[i] for i in held if i in truth]) > 0.95
    again = {r.doc_id: r.score for r in score(docs.repartition(5), table).collect() if r.doc_id}
    assert again == {r.doc_id: r.score for r in got if r.doc_id}
    none = score(docs, table.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert score(docs.limit(0), table).count() == 0


def test_held_out_labels_teach_nothing(spark):
    rows, labels = labelled(300, ["awful"], ["nice"])
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    flip = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    scores = [{r.doc_id: r.score for r in toxicity.score_toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect()} for x in (labels, flip)]
    assert scores[0] == scores[1]


def test_language_model(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        word = rng.randrange(50)
        text = []
        for _ in range(rng.randrange(1, 60)):
            word = (word * 3 + rng.randrange(2)) % 50
            text.append(f"Tok{word}")
        rows.append((i, " ".join(text), "x"))
    rows += [*EDGE[:3], (9003, "Tok1 " * 3000, "x"), rows[3]]
    got = language_model.score_documents(spark.createDataFrame(rows, "doc_id long, text string, _learn string"), batch_bytes=3000, bucket_bytes=200).collect()
    split = lambda t: [*(t or "").lower().split(), ""]
    fold = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 7
    counts = Counter(w for i, t, _ in rows if fold(i) not in (None, 2) for w in split(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (str(i), fold(i) == 2, len(split(t)), sum(counts[w] > 0 for w in split(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in split(t)), 6)) for i, t, _ in rows
    )
    assert want == sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got) and all(r.score < 0 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert language_model.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_class_factor_sums_to_one():
    h, c, sizes = language_model.tokens([b"a b c", b"", b"d " * 50])
    assert sizes.tolist() == [4, 1, 51] and c[3] == 0
    w = np.random.default_rng(1).standard_normal((language_model.ROWS * language_model.FEATURES, language_model.CLASSES)).astype(np.float32)
    rows = language_model.histories(h, c, sizes)
    p = [np.exp(language_model.log_likelihood(w, rows, np.full(len(c), k))) for k in range(language_model.CLASSES)]
    assert np.allclose(np.sum(p, axis=0), 1, atol=1e-5)


def nearest(vectors, every, top):
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], np.float32).astype(np.float64)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:top]
        out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


@pytest.mark.parametrize("exponent", [20, 70])
def test_nearest_of_large_components(spark, exponent):
    rng = np.random.default_rng(10)
    x = rng.standard_normal((300, 8)) * 2.0**exponent
    vectors = [(i, [float(np.float32(a)) for a in v]) for i, v in enumerate(x)]
    got: dict = {}
    for r in nn_descent.nearest(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), top=10, bucket_nodes=100).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = nearest(vectors, 20, 10)
    assert got.keys() == want.keys() and np.mean([len({*got[q]} & {*want[q]}) / 10 for q in want]) >= 0.9


def test_nearest(spark):
    rng = np.random.default_rng(9)
    centre = rng.standard_normal((30, 16))
    x = centre[rng.integers(0, 30, 1500)] + 0.4 * rng.standard_normal((1500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[200:700] = x[200]  # one vector that a third of all rows share
    vectors = [(i, [float(np.float32(a)) for a in v]) for i, v in enumerate(x)]
    odd = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] + [1.0] * 15), (2080, [float("inf")] * 16), (None, vectors[0][1])]
    table = spark.createDataFrame([(*v, "x") for v in [*vectors, *odd, vectors[40]]], "vec_id long, embedding array<float>, vec string")
    got: dict = {}
    for r in nn_descent.nearest(table, k=24, bucket_nodes=200).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r["rank"] == len(got[r.query_id])
        assert r.score == pytest.approx(float(np.dot(np.float32(x[r.query_id]).astype(float), np.float32(x[r.vec_id]).astype(float))), abs=1e-12)
    want = nearest(vectors, 20, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len({*got[q]} & {*want[q]}) / 20 for q in want]) >= 0.9
    assert got[220] == [i for i in range(200, 221) if i != 220]
    assert nn_descent.nearest(table.limit(0)).count() == 0
    few = nn_descent.nearest(spark.createDataFrame(vectors[:3], "vec_id long, embedding array<float>")).collect()
    assert [r.query_id for r in few] == [0, 0] and len(few) == 2
    assert nn_descent.nearest(spark.createDataFrame(vectors[:1], "vec_id long, embedding array<float>")).count() == 0


def pins(spark):
    folder = f"{checkpoint_dir(spark)}/pins".removeprefix("file://")
    return {*os.listdir(folder)} if os.path.isdir(folder) else set()


def test_a_round_leaves_no_estimate_behind(spark):
    """Eight rounds of descent keep the plan's size estimate flat, and leave one graph on disk."""
    rng = np.random.default_rng(12)
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((400, 8)))], "node long, vec array<double>")
    nodes = nodes.withColumn("vec", F.col("vec").cast("array<float>"))
    clear_pins(spark)
    before = pins(spark)
    graph, _ = nn_descent.build_graph(nodes, k=5, bucket_nodes=100)
    bits = []
    for turn in range(8):
        graph = nn_descent.descend(graph, 4, 5, turn)
        bits.append(graph._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
    assert max(bits) < 40, bits
    clear_pins(spark)
    assert pins(spark) == before


def test_components_of_a_long_chain(spark):
    """Some fifteen rounds: 100 000 links in a row and a star; plans stay small and only the answer stays on disk."""
    clear_pins(spark)
    before = pins(spark)
    chain = spark.range(100_000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    star = spark.range(200_001, 230_000).select(F.lit(200_000).cast("long").alias("u"), F.col("id").alias("v"))
    found = components(chain.union(star))
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 40
    roots = found.groupBy((F.col("node") >= 200_000).alias("in_star")).agg(F.count_distinct("root").alias("n"), F.count(F.lit(1)).alias("size")).collect()
    assert {(r.in_star, r.n, r["size"]) for r in roots} == {(False, 1, 100_001), (True, 1, 30_000)}
    assert len(pins(spark) - before) == 2
    clear_pins(spark)
