"""Substring dedup: Rabin-Karp hashes of all word windows, counted in Spark; repeated windows become removal intervals.

Plan: documents are dealt into batches by hashed id (the only shuffle of text).
Each batch hashes every window of ``length`` words, keeps the first occurrence of each
hash (this pre-aggregation keeps a passage that a third of all documents share from
filling one bucket) and sends the hashes to buckets.  A bucket sorts its hashes and
answers, one bit for each hash in the order received, whether an earlier document has
the same window.  The batch, computed again from the same shuffled rows, applies the
bits: windows merge into maximal intervals and their words go.

Windows are compared by a 64-bit hash; two different windows meet with probability
2**-64 per pair.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from assayline.llm.common import BATCH_BYTES, BUCKET_BYTES, batches, ordered, rolling, runs, split_by, word_hashes

REQUEST = "bucket int, _batch long, hashes binary, ids binary, counts binary"
REPLY = "_batch long, bucket int, late binary"


class Windows:
    """All windows of a batch: hashes, positions, and which are the first of their hash in the batch."""

    def __init__(self, rows: pa.Table, length: int):
        self.rows, self.ids, self.texts = ordered(rows)
        each = [word_hashes(t.split()) for t in self.texts]
        self.n_words = np.array([len(h) for h in each], np.int64)
        self.ends = np.cumsum(self.n_words)
        self.words = words = np.concatenate(each) if each else np.empty(0, np.uint64)
        doc = np.repeat(np.arange(len(each)), self.n_words)
        inside = np.flatnonzero(np.arange(len(words)) + length <= self.ends[doc]) if len(words) else np.empty(0, np.int64)
        self.starts, self.docs = inside, doc[inside]
        every = rolling(words, length)
        self.hashes = every[inside] if len(every) else np.empty(0, np.uint64)

    def firsts(self) -> np.ndarray:
        """Indices, ascending, of the windows whose hash the batch has not had before."""
        return np.sort(np.unique(self.hashes, return_index=True)[1])

    def covered(self, windows: np.ndarray, length: int) -> np.ndarray:
        """Which words of the batch lie in one of the given windows."""
        edge = np.zeros(int(self.n_words.sum()) + 1, np.int64)
        np.add.at(edge, self.starts[windows], 1)
        np.add.at(edge, self.starts[windows] + length, -1)
        return np.cumsum(edge[:-1]) > 0


def requests(hashes: np.ndarray, ids: np.ndarray, batch: int, n_buckets: int) -> pa.Table:
    """Hashes by bucket, in their order, with run-length coded document ids."""
    order, bounds = split_by(hashes % np.uint64(n_buckets), n_buckets)
    hashes, ids = hashes[order], ids[order]
    out: dict[str, list] = {"bucket": [], "hashes": [], "ids": [], "counts": []}
    for b in np.flatnonzero(np.diff(bounds)):
        part = slice(bounds[b], bounds[b + 1])
        at = runs(ids[part])
        out["bucket"].append(int(b))
        out["hashes"].append(hashes[part].tobytes())
        out["ids"].append(ids[part][at].tobytes())
        out["counts"].append(np.diff(np.append(at, bounds[b + 1] - bounds[b])).astype(np.uint32).tobytes())
    n = len(out["bucket"])
    return pa.table(
        {
            "bucket": pa.array(out["bucket"], pa.int32()),
            "_batch": pa.array([batch] * n, pa.int64()),
            "hashes": pa.array(out["hashes"], pa.binary()),
            "ids": pa.array(out["ids"], pa.binary()),
            "counts": pa.array(out["counts"], pa.binary()),
        }
    )


def answer(bucket: pa.Table) -> pa.Table:
    """For each hash of a bucket: 1 if a smaller document id sent it too.  Ids of different batches differ."""
    hashes = [np.frombuffer(x, np.uint64) for x in bucket["hashes"].to_pylist()]
    ids = [
        np.repeat(np.frombuffer(d, np.int64), np.frombuffer(c, np.uint32)) for d, c in zip(bucket["ids"].to_pylist(), bucket["counts"].to_pylist(), strict=True)
    ]
    h, d = np.concatenate(hashes), np.concatenate(ids)
    order = np.lexsort((d, h))
    h = h[order]
    late = np.zeros(len(h), bool)
    late[order[1:]] = h[1:] == h[:-1]
    bounds = np.cumsum([0, *map(len, hashes)])
    return pa.table(
        {
            "_batch": bucket["_batch"].cast(pa.int64()),
            "bucket": bucket["bucket"].cast(pa.int32()),
            "late": pa.array([np.packbits(late[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
        }
    )


def replied(hashes: np.ndarray, replies: pa.Table, n_buckets: int) -> np.ndarray:
    """The answers, in the order in which ``hashes`` were sent."""
    order, bounds = split_by(hashes % np.uint64(n_buckets), n_buckets)
    late = np.zeros(len(hashes), bool)
    for b, bits in zip(replies["bucket"].to_pylist(), replies["late"].to_pylist(), strict=True):
        n = bounds[b + 1] - bounds[b]
        late[order[bounds[b] : bounds[b + 1]]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
    return late


def kept(windows: Windows, gone: np.ndarray) -> tuple[list[int], list[bytes], list[list[dict[str, int]]]]:
    """Per document: words removed, remaining words joined by a space, removal intervals [start, end)."""
    removed, texts, spans = [], [], []
    for text, end, n in zip(windows.texts, windows.ends, windows.n_words, strict=True):
        mask = gone[end - n : end]
        removed.append(int(mask.sum()))
        words = text.split()
        texts.append(b" ".join(words[i] for i in np.flatnonzero(~mask)) if removed[-1] else b" ".join(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))) if removed[-1] else ()
        spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)])
    return removed, texts, spans


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def result(windows: Windows, gone: np.ndarray, keep: tuple[str, ...]) -> pa.Table:
    removed, texts, spans = kept(windows, gone)
    return pa.table(
        {"doc_id": windows.rows["doc_id"], "text": windows.rows["text"]}
        | {c: windows.rows[c] for c in keep}
        | {
            "n_words": pa.array(windows.n_words, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "kept_text": pa.array(texts, pa.binary()).cast(pa.string()),
            "removed": pa.array(spans, SPANS),
        }
    )


def result_schema(docs: DataFrame, keep: tuple[str, ...]) -> str:
    types = dict(docs.dtypes)
    own = "n_words long, n_removed long, kept_text string, removed array<struct<start: int, end: int>>"
    return ", ".join(["doc_id long", "text binary", *(f"`{c}` {types[c]}" for c in keep), own])


def remove_repeats(
    docs: DataFrame,
    length: int = 20,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: tuple[str, ...] = (),
    batch_bytes: int = BATCH_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Remove each word in a window of ``length`` words that also starts earlier (smaller id, or same document, earlier start).

    Returns doc_id, text (the input's bytes), the columns of ``keep``, n_words, n_removed,
    kept_text (the remaining words, joined by one space) and removed (maximal word intervals).

    Null or empty text: no words, nothing removed.  Null ids come before all others.
    Rows that share an id are documents of their own, ordered by their text; of two
    identical rows one counts as earlier.  Columns not in ``keep`` are dropped, so
    their names cannot clash; no documents give no rows.
    """
    rows, total = batches(docs, doc_id, text, keep, batch_bytes)
    n_buckets = max(1, math.ceil(total / 6 * 10 / bucket_bytes))

    def ask(key: tuple, batch: pa.Table) -> pa.Table:
        w = Windows(batch, length)
        first = w.firsts()
        return requests(w.hashes[first], w.ids[w.docs[first]], key[0].as_py(), n_buckets)

    def apply(batch: pa.Table, replies: pa.Table) -> pa.Table:
        w = Windows(batch, length)
        first = w.firsts()
        late = np.ones(len(w.hashes), bool)
        late[first] = replied(w.hashes[first], replies, n_buckets)
        return result(w, w.covered(np.flatnonzero(late), length), keep)

    replies = rows.groupBy("_batch").applyInArrow(ask, REQUEST).groupBy("bucket").applyInArrow(answer, REPLY)
    return rows.groupBy("_batch").cogroup(replies.groupBy("_batch")).applyInArrow(apply, result_schema(docs, keep))
