"""Suffix-array dedup over sparse suffix arrays.

Of all suffixes only those at minimisers are kept: in every window of ``length`` words
the run of ``gram`` words with the smallest hash, so windows with the same words keep the
same place.  Suffixes that share their first ``gram`` words meet in a bucket.  There they
are sorted and each compared with its neighbours, which gives how far its words agree
with any other suffix's to the right; sorted by the words before them, how far to the
left.  Both lengths go back to the documents: a window can repeat only if its minimiser
agrees far enough both ways, and only those windows are compared exactly, by hash, as in
:mod:`substring_dedup`.  Matches of neighbouring minimisers merge into maximal spans.

Words are one byte each in the suffixes (a match can only look longer, never shorter).
Equal suffixes of a batch are sent once, so a passage that a third of all documents
share stays small.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import BATCH_BYTES, BUCKET_BYTES, batches, rolling, split_by
from assayline.llm.substring_dedup import REPLY, REQUEST, Windows, answer, replied, requests, result, result_schema

SUFFIX = "bucket int, _batch long, grams binary, after binary, before binary, twice binary"
AGREE = "_batch long, bucket int, right binary, left binary"


def minimisers(words: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``gram`` words, and for every window of ``length`` words the start of its smallest (ties: the first)."""
    grams = rolling(words, gram)
    low = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    span, width = 1, length - gram + 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    return grams, (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


class Suffixes:
    """The windows of a batch and its kept suffixes."""

    def __init__(self, rows: pa.Table, length: int, gram: int):
        self.windows = w = Windows(rows, length)
        reach = length - gram
        grams, anchor = minimisers(w.words, length, gram) if len(w.words) >= length else (np.empty(0, np.uint64), np.empty(0, np.int64))
        anchor = anchor[w.starts] if len(w.starts) else np.empty(0, np.int64)
        at, self.kept_of_window = np.unique(anchor, return_inverse=True)
        self.before_window = anchor - w.starts
        # One byte per word, zero outside the document.
        doc = np.searchsorted(w.ends, at, "right")
        first, end = w.ends[doc] - w.n_words[doc], w.ends[doc]
        byte = np.append((w.words % np.uint64(255) + np.uint64(1)).astype(np.uint8), np.uint8(0))
        after = at[:, None] + gram + np.arange(reach)
        before = at[:, None] - 1 - np.arange(reach)
        after = byte[np.where(after < end[:, None], after, -1)]
        before = byte[np.where(before >= first[:, None], before, -1)]
        whole = np.concatenate([grams[at].astype(">u8").view(np.uint8).reshape(-1, 8), after, before], axis=1)
        _, self.first, self.record_of_kept, count = np.unique(as_keys(whole), return_index=True, return_inverse=True, return_counts=True)
        self.grams, self.after, self.before, self.twice = grams[at][self.first], after[self.first], before[self.first], count > 1

    def candidates(self, right: np.ndarray, left: np.ndarray, length: int) -> np.ndarray:
        """Windows whose minimiser agrees with some other suffix as far as the window reaches, to both sides."""
        record = self.record_of_kept[self.kept_of_window]
        return np.flatnonzero((left[record] >= self.before_window) & (right[record] >= length - self.before_window))


def as_keys(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as values that sort as the bytes do."""
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel() if len(rows) else np.empty(0, "S1")


def suffix_requests(s: Suffixes, batch: int, n_buckets: int) -> pa.Table:
    order, bounds = split_by(s.grams % np.uint64(n_buckets), n_buckets)
    got = np.flatnonzero(np.diff(bounds))
    blob = lambda x: pa.array([x[order[bounds[b] : bounds[b + 1]]].tobytes() for b in got], pa.binary())
    return pa.table(
        {
            "bucket": pa.array(got.astype(np.int32)),
            "_batch": pa.array([batch] * len(got), pa.int64()),
            "grams": blob(s.grams),
            "after": blob(s.after),
            "before": blob(s.before),
            "twice": blob(s.twice),
        }
    )


def agreement(grams: np.ndarray, side: np.ndarray) -> np.ndarray:
    """For each row, over how many bytes it agrees with the most similar other row of the same gram; -1 if there is no other."""
    order = np.argsort(as_keys(np.concatenate([grams.astype(">u8").view(np.uint8).reshape(-1, 8), side], axis=1)), kind="stable")
    g, x = grams[order], side[order]
    most = np.full(len(g), -1, np.int64)
    same = np.logical_and.accumulate(x[1:] == x[:-1], axis=1).sum(axis=1)
    same[g[1:] != g[:-1]] = -1
    most[1:] = same
    most[:-1] = np.maximum(most[:-1], same)
    out = np.empty(len(g), np.int64)
    out[order] = most
    return out


def remove_repeats(
    docs: DataFrame,
    length: int = 50,
    gram: int = 15,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: tuple[str, ...] = (),
    batch_bytes: int = BATCH_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Remove each word in a passage of ``length`` words or more that also starts earlier (smaller id, or same document, earlier start).

    Returns, and treats nulls, repeated rows, other columns and empty tables, as
    :func:`substring_dedup.remove_repeats` does.
    """
    reach = length - gram
    rows, total = batches(docs, doc_id, text, keep, batch_bytes)
    words = total / 6
    suffix_buckets = max(1, math.ceil(words * 2 / (reach + 2) * (2 * reach + 9) / bucket_bytes))
    window_buckets = max(1, math.ceil(words * 10 / bucket_bytes))

    def ask_suffixes(key: tuple, batch: pa.Table) -> pa.Table:
        return suffix_requests(Suffixes(batch, length, gram), key[0].as_py(), suffix_buckets)

    def compare(bucket: pa.Table) -> pa.Table:
        grams = [np.frombuffer(x, np.uint64) for x in bucket["grams"].to_pylist()]
        side = lambda c: np.frombuffer(b"".join(bucket[c].to_pylist()), np.uint8).reshape(-1, reach)
        g, twice = np.concatenate(grams), np.frombuffer(b"".join(bucket["twice"].to_pylist()), bool)
        right, left = (np.where(twice, reach, agreement(g, side(c))) for c in ("after", "before"))
        right = np.where(right >= 0, right + gram, 0).astype(np.uint8)
        left = np.maximum(left, 0).astype(np.uint8)
        bounds = np.cumsum([0, *map(len, grams)])
        blob = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
        return pa.table({"_batch": bucket["_batch"].cast(pa.int64()), "bucket": bucket["bucket"].cast(pa.int32()), "right": blob(right), "left": blob(left)})

    def candidates(s: Suffixes, found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Windows to compare, and which of them are the first of their hash."""
        order, bounds = split_by(s.grams % np.uint64(suffix_buckets), suffix_buckets)
        right, left = np.zeros(len(s.grams), np.int64), np.zeros(len(s.grams), np.int64)
        for b, r, x in zip(found["bucket"].to_pylist(), found["right"].to_pylist(), found["left"].to_pylist(), strict=True):
            part = order[bounds[b] : bounds[b + 1]]
            right[part], left[part] = np.frombuffer(r, np.uint8), np.frombuffer(x, np.uint8)
        windows = s.candidates(right, left, length)
        return windows, np.sort(np.unique(s.windows.hashes[windows], return_index=True)[1])

    def ask_windows(key: tuple, batch: pa.Table, found: pa.Table) -> pa.Table:
        s = Suffixes(batch, length, gram)
        windows, first = candidates(s, found)
        w = s.windows
        return requests(w.hashes[windows[first]], w.ids[w.docs[windows[first]]], key[0].as_py(), window_buckets)

    def apply(batch: pa.Table, found: pa.Table) -> pa.Table:
        kind = np.array(found["kind"].to_pylist(), np.int64)
        s = Suffixes(batch, length, gram)
        windows, first = candidates(s, found.filter(pa.array(kind == 0)))
        late = np.ones(len(windows), bool)
        late[first] = replied(s.windows.hashes[windows[first]], found.filter(pa.array(kind == 1)), window_buckets)
        return result(s.windows, s.windows.covered(windows[late], length), keep)

    agree = rows.groupBy("_batch").applyInArrow(ask_suffixes, SUFFIX).groupBy("bucket").applyInArrow(compare, AGREE)
    asked = rows.groupBy("_batch").cogroup(agree.groupBy("_batch")).applyInArrow(ask_windows, REQUEST)
    late = asked.groupBy("bucket").applyInArrow(answer, REPLY)
    none = F.lit(None).cast("binary")
    both = agree.select("_batch", "bucket", "right", "left", none.alias("late"), F.lit(0).alias("kind")).union(
        late.select("_batch", "bucket", none, none, "late", F.lit(1))
    )
    return rows.groupBy("_batch").cogroup(both.groupBy("_batch")).applyInArrow(apply, result_schema(docs, keep))
