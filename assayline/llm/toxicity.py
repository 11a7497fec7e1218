"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Each shard of the labelled sample is learned online with per-coordinate rates and
L1, which leaves most weights at exactly zero; the shards' weights are averaged and
the few that are not zero are broadcast to score every document.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from assayline.llm import classify
from assayline.llm.common import ALNUM, mixed, word_hashes

#: Hashed features; the bias comes after them.
SIZE = 1 << 20
ALPHA, BETA, L1, L2, EPOCHS = 3.0, 1.0, 20.0, 0.0, 10
#: A feature is learned once this many documents of the shard have it.
MIN_DOCS = 4
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1


def features(text: bytes) -> np.ndarray:
    """Places of the words, of pairs of neighbours, and of pairs with one word skipped; repeats included."""
    h = word_hashes(text.translate(ALNUM).split())
    pair = h[:-1] * np.uint64(3) + h[1:]
    skip = h[:-2] * np.uint64(5) + h[2:] + np.uint64(1)
    return (mixed(np.concatenate((h, pair, skip))) & np.uint64(SIZE - 1)).astype(np.int64)


def fit(texts: list[bytes], labels: np.ndarray) -> np.ndarray:
    """Weights after ``EPOCHS`` passes of FTRL-proximal; the last is the bias, which is not regularised."""
    rows = [np.unique(features(t)) for t in texts]
    often = np.bincount(np.concatenate([*rows, np.empty(0, np.int64)]), minlength=SIZE) >= MIN_DOCS
    rows = [np.append(r[often[r]], SIZE) for r in rows]
    z, n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        zi, ni = z[i], n[i]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
        w[np.abs(zi) <= L1] = 0.0
        if len(i) and i[-1] == SIZE:
            w[-1] = -zi[-1] / ((BETA + np.sqrt(ni[-1])) / ALPHA)
        return w

    for _ in range(EPOCHS):
        for i, y in zip(rows, labels, strict=True):
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange(SIZE + 1))


def score_toxicity(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of ``docs``: the columns of ``keep`` (doc_id among them), score, predicted (score >= 0.7) and held_out.

    Learns from ``labels`` (doc_id, toxic) whose crc32(id) modulo 3 is not 1, at most
    about ``classify.SAMPLE_ROWS`` of them.  Only the text is scored: null and empty
    texts get the bias's score.  Without labelled rows every score is 0.5.  Repeated
    rows are scored one by one; rows with a null id are scored and not held out;
    columns named score, predicted or held_out may not be kept.
    """
    rows, _ = classify.sample(docs, labels, "toxic", FOLDS, HELD_OUT)
    weights = classify.fitted(rows, fit, SIZE + 1)
    return classify.with_fold(classify.scored(docs, weights, features, THRESHOLD, keep), FOLDS, HELD_OUT)
