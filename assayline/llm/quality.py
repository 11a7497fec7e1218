"""Quality: Naive Bayes support vectors over n-gram indicators.

Indicators of word and word-shape n-grams are scaled by the log ratio of their class
counts; a linear hinge-loss model is fitted on them by dual coordinate descent.  Each
shard of the labelled sample fits its own on four fifths of its rows, turns margins
into log odds on the rest (Platt), and the log odds are averaged.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from assayline.llm import classify
from assayline.llm.common import mixed, word_hashes

SIZE = 1 << 18
#: Smoothing of class counts, cost of a margin violation, passes.
SMOOTH, COST, EPOCHS = 1.0, 1.0, 15
#: A feature counts once this many documents of the shard have it.
MIN_DOCS = 3
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0

#: Kind of each byte: A for upper case, a for lower case and beyond ASCII, 0 for digits; white space as a space; others stand for themselves.
KIND = np.array([65 if 65 <= c < 91 else 97 if 97 <= c < 123 or c > 127 else 48 if 48 <= c < 58 else 32 if c in (9, 10, 11, 12, 13) else c for c in range(256)], np.uint8)


def shapes(text: bytes) -> list[bytes]:
    """Words with each run of bytes of a kind as one byte."""
    kind = KIND[np.frombuffer(text, np.uint8)]
    return kind[np.concatenate(([True], kind[1:] != kind[:-1]))].tobytes().split() if len(kind) else []


def features(text: bytes) -> np.ndarray:
    """Places of words and word pairs, and of one to three word shapes; repeats included."""
    h = word_hashes(text.lower().split())
    seen: dict[bytes, int] = {}
    kinds = [seen.setdefault(s, len(seen)) for s in shapes(text)]
    s = (mixed(word_hashes(list(seen))) if seen else np.empty(0, np.uint64))[np.array(kinds, np.int64)]
    pair, pair_s = h[:-1] * np.uint64(3) + h[1:], s[:-1] * np.uint64(7) + s[1:]
    three_s = s[:-2] * np.uint64(49) + s[1:-1] * np.uint64(11) + s[2:]
    return (mixed(np.concatenate((h, pair, s, pair_s, three_s))) & np.uint64(SIZE - 1)).astype(np.int64)


def platt(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """(a, b) of the log odds a * margin + b, by Newton steps with Platt's smoothed targets."""
    ones = label.sum()
    t = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (len(label) - ones + 2))
    x = np.stack([margin, np.ones(len(margin))], 1)
    ab = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -35, 35)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        ab = ab - np.linalg.solve(h, x.T @ (p - t) + 1e-3 * (ab - [1.0, 0.0]))
    return max(float(ab[0]), 1e-3), float(ab[1])


def fit(texts: list[bytes], labels: np.ndarray) -> np.ndarray:
    """Log-odds weights of unit-length indicator vectors; the last is the bias."""
    rows = [np.unique(features(t)) for t in texts]
    lengths = [classify.length(r) for r in rows]
    often = np.bincount(np.concatenate([*rows, np.empty(0, np.int64)]), minlength=SIZE) >= MIN_DOCS
    rows = [r[often[r]] for r in rows]
    y = np.where(labels == 1, 1.0, -1.0)
    rest = np.arange(len(rows)) % 5 == 4
    learn, held = np.flatnonzero(~rest), np.flatnonzero(rest)
    counts = {s: np.full(SIZE, SMOOTH) for s in (1.0, -1.0)}
    for i in learn:
        counts[y[i]][rows[i]] += 1
    ratio = np.log(counts[1.0] / counts[1.0].sum()) - np.log(counts[-1.0] / counts[-1.0].sum())
    values = [ratio[r] / n for r, n in zip(rows, lengths, strict=True)]
    norm = np.array([v @ v + 1 for v in values])  # 1: the bias
    rare = np.where(y < 0, (y[learn] > 0).sum() / max((y[learn] < 0).sum(), 1), 1.0)  # both classes weigh the same
    w, bias, alpha = np.zeros(SIZE), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rng.permutation(learn):
            r, v = rows[i], values[i]
            gradient = y[i] * (w[r] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), COST * rare[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * v
                bias += step
                alpha[i] = new
    w *= ratio
    if len(held):
        a, b = platt(np.array([w[rows[i]].sum() / lengths[i] + bias for i in held]), labels[held])
        w, bias = w * a, bias * a + b
    return np.append(w, bias)


def score_quality(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of ``docs``: the columns of ``keep`` (doc_id among them), score, predicted (score >= 0.3) and held_out.

    Learns from ``labels`` (doc_id, quality) whose crc32(id) modulo 5 is not 0, at most
    about ``classify.SAMPLE_ROWS`` of them.  Only the text is scored: null and empty
    texts get the bias's score.  Without labelled rows every score is 0.5.  Repeated
    rows are scored one by one; rows with a null id are scored and not held out;
    columns named score, predicted or held_out may not be kept.
    """
    rows, _ = classify.sample(docs, labels, "quality", FOLDS, HELD_OUT)
    weights = classify.fitted(rows, fit, SIZE + 1)
    return classify.with_fold(classify.scored(docs, weights, features, THRESHOLD, keep, unit_length=True), FOLDS, HELD_OUT)
