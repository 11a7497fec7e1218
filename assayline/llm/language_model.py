"""Language-model scoring: a hashed maximum-entropy model with class-factored softmax.

p(word | history) = p(class | history) * p(word | class).  A word's class follows from
its last bytes, so no table of classes is needed.  The class factor is a softmax over
``CLASSES`` with weights hashed from features of the history: the previous word, the
pair of previous classes, and two features that skip (the word before the previous
one, and the classes two and three back).  It is trained on all training tokens by
distributed gradient updates: each partition makes its updates from the current
weights, ``BATCH`` tokens at a time, and the partitions' changes are averaged by
tokens.  The word factor is the word's smoothed share of its class, counted over all
training tokens.

Counts and their look-up are one exchange: a batch of documents sends each of its
distinct words' hash with its training count to the word's bucket, and gets back, in
order, the totals, along with each bucket's sums.  Hot words arrive once per batch.
Words are told apart by a 64-bit hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import BATCH_BYTES, BUCKET_BYTES, batches, mixed, ordered, remainder, split_by, word_hashes

CLASSES = 64
#: Hashed histories per feature, and features.
ROWS, FEATURES = 1 << 11, 4
#: Rows of weights that are summed apart.
PIECE = 64
#: Tokens per update, learning rate, passes over the training tokens.
BATCH, RATE, PASSES = 4096, 0.5, 1
FOLDS, HELD_OUT = 7, 2
END = b""

REQUEST = "bucket int, _batch long, words binary, counts binary, classes binary"
REPLY = "_batch long, bucket int, counts binary, sums binary"


def words_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All tokens in a row, and tokens per text.  A text ends with one end token, which has no bytes."""
    each = [t.lower().split() for t in texts]
    return [w for words in each for w in (*words, END)], np.array([len(w) + 1 for w in each], np.int64)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and class of every token, and tokens per text."""
    flat, sizes = words_of(texts)
    return word_hashes(flat), classes(flat), sizes


def classes(words: list[bytes]) -> np.ndarray:
    """By the last three bytes; the end token has class 0 to itself."""
    tails = [w[-3:] for w in words]
    known = {t: mixed(word_hashes([t]))[0] % np.uint64(CLASSES - 1) + np.uint64(1) for t in set(tails)}
    known[END] = np.uint64(0)
    return np.fromiter(map(known.__getitem__, tails), np.int64, len(tails))


def histories(h: np.ndarray, c: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows of the weights, one column per feature; before a text's start words and classes are zero."""
    at = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)

    def back(x: np.ndarray, k: int) -> np.ndarray:
        y = np.zeros(len(x), np.uint64)
        y[k:] = x[:-k]
        y[at < k] = 0
        return y

    k = c.astype(np.uint64) + np.uint64(1)
    one, two, three = (back(k, i) for i in (1, 2, 3))
    keys = (back(h, 1), one * np.uint64(101) + two, back(h, 2) + np.uint64(1), two * np.uint64(103) + three)
    return np.stack([(mixed(x * np.uint64(FEATURES) + np.uint64(f)) % np.uint64(ROWS)).astype(np.int64) + f * ROWS for f, x in enumerate(keys)], 1)


def scores(w: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Score of every class, at most zero."""
    s = w[rows[:, 0]]
    for f in range(1, rows.shape[1]):
        s += w[rows[:, f]]
    s -= s.max(axis=1, keepdims=True)
    return s


def log_likelihood(w: np.ndarray, rows: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Natural logarithm of the softmax at each row's class."""
    s = scores(w, rows)
    own = s[np.arange(len(c)), c]
    return own - np.log(np.exp(s, out=s).sum(axis=1))


def update(w: np.ndarray, g2: np.ndarray, rows: np.ndarray, c: np.ndarray) -> None:
    """One gradient step, with rates per row by the squares of its gradients so far."""
    grad = scores(w, rows)
    np.exp(grad, out=grad)
    grad /= grad.sum(axis=1, keepdims=True)
    grad[np.arange(len(c)), c] -= 1
    for f in range(rows.shape[1]):
        order = np.argsort(rows[:, f], kind="stable")
        r = rows[order, f]
        first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
        step = np.add.reduceat(grad[order], first, axis=0)
        r = r[first]
        g2[r] += (step * step).mean(axis=1)
        w[r] -= (RATE / np.sqrt(g2[r] + 1.0))[:, None] * step


def train(rows: DataFrame) -> np.ndarray:
    """Class weights from all of ``rows`` (text): ``PASSES`` rounds; in each a partition sends its changed weights once."""
    spark = rows.sparkSession
    w = np.zeros((ROWS * FEATURES, CLASSES), np.float32)
    for _ in range(PASSES):
        shared = spark.sparkContext.broadcast(w)

        def learn(record_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, n = shared.value.copy(), 0  # noqa: B023
            g2 = np.zeros(len(own), np.float32)
            for batch in record_batches:
                texts = [t or b"" for t in batch.column("text").to_pylist()]
                at = 0
                while at < len(texts):
                    size, to = 0, at
                    while to < len(texts) and (to == at or size + len(texts[to]) < 1 << 20):
                        size, to = size + len(texts[to]), to + 1
                    h, c, sizes = tokens(texts[at:to])
                    x = histories(h, c, sizes)
                    for i in range(0, len(c), BATCH):
                        update(own, g2, x[i : i + BATCH], c[i : i + BATCH])
                    n, at = n + len(c), to
            if n:
                change = (own - shared.value) * np.float32(n)  # noqa: B023
                parts = [change[i : i + PIECE].tobytes() for i in range(0, len(change), PIECE)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array(np.full(len(parts), float(n))), pa.array(parts, pa.binary())], ["part", "n", "change"])

        def total(group: pa.Table) -> pa.Table:
            s = np.zeros(PIECE * CLASSES)
            for x in group["change"].to_pylist():
                s += np.frombuffer(x, np.float32)
            mean = (s / sum(group["n"].to_pylist())).astype(np.float32)
            return pa.table({"part": pa.array([group["part"][0].as_py()]), "change": pa.array([mean.tobytes()], pa.binary())})

        changes = rows.mapInArrow(learn, "part long, n double, change binary")
        w = w.copy()
        for r in changes.groupBy("part").applyInArrow(total, "part long, change binary").toLocalIterator():
            w[r["part"] * PIECE : (r["part"] + 1) * PIECE] += np.frombuffer(r["change"], np.float32).reshape(PIECE, CLASSES)
        shared.unpersist()
    return w


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, where each is first, and for each token its value's place."""
    return np.unique(h, return_index=True, return_inverse=True)


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10 probabilities of the text).

    Learns from rows whose crc32(id) modulo 7 is not 2; rows with a null id are
    neither learned from nor held out.  base_score sums log10((c + 1) / (N + V + 1)) with
    c, N and V counted in training tokens.  score sums the class factor and
    (c + 1) / (N_class + V_class + 1), so over all known words and one unknown word of
    each class it sums to one.

    Null and empty texts are one end token.  Repeated rows are learned and scored each.
    Without training rows N and V are 0 and the class factor is uniform.  Other columns
    are not read; no documents give no rows.
    """
    own = remainder(F.col(doc_id).cast("long"), FOLDS)
    learned = docs.where(own != HELD_OUT).select(F.col(text).cast("binary").alias("text"))
    weights = docs.sparkSession.sparkContext.broadcast(train(learned))
    marked = docs.withColumns({"_learn": F.coalesce(own != HELD_OUT, F.lit(False)), "_held": F.coalesce(own == HELD_OUT, F.lit(False))})
    rows, total = batches(marked, doc_id, text, ("_learn", "_held"), batch_bytes)
    n_buckets = max(1, math.ceil(total / 6 / 3 * 11 / bucket_bytes))

    def ask(key: tuple, batch: pa.Table) -> pa.Table:
        rows, _, texts = ordered(batch)
        flat, sizes = words_of(texts)
        words, first, place = distinct(word_hashes(flat))
        learn = np.repeat(np.array(rows["_learn"].to_pylist(), np.int64), sizes)
        counts = np.bincount(place, weights=learn, minlength=len(words)).astype(np.uint32)
        order, bounds = split_by(words % np.uint64(n_buckets), n_buckets)
        parts = [order[bounds[b] : bounds[b + 1]] for b in range(n_buckets)]
        kinds = classes([flat[i] for i in first]).astype(np.uint8)
        blob = lambda x: pa.array([x[p].tobytes() for p in parts], pa.binary())
        return pa.table(
            {
                "bucket": pa.array(np.arange(n_buckets, dtype=np.int32)),
                "_batch": pa.array([key[0].as_py()] * n_buckets, pa.int64()),
                "words": blob(words),
                "counts": blob(counts),
                "classes": blob(kinds),
            }
        )

    def answer(bucket: pa.Table) -> pa.Table:
        words = [np.frombuffer(x, np.uint64) for x in bucket["words"].to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint32) for x in bucket["counts"].to_pylist()])
        kinds = np.concatenate([np.frombuffer(x, np.uint8) for x in bucket["classes"].to_pylist()])
        _, first, place = distinct(np.concatenate(words))
        sums = np.bincount(place, weights=counts, minlength=len(first)).astype(np.int64)
        kind = kinds[first]
        known = sums > 0
        by_class = np.concatenate([np.bincount(kind, weights=sums, minlength=CLASSES), np.bincount(kind[known], minlength=CLASSES)]).astype(np.int64)
        bounds = np.cumsum([0, *map(len, words)])
        replies = sums[place].astype(np.uint32 if len(sums) == 0 or sums.max() < 1 << 32 else np.uint64)
        return pa.table(
            {
                "_batch": bucket["_batch"].cast(pa.int64()),
                "bucket": bucket["bucket"].cast(pa.int32()),
                "counts": pa.array([replies[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
                "sums": pa.array([by_class.tobytes()] * len(words), pa.binary()),
            }
        )

    def apply(batch: pa.Table, replies: pa.Table) -> pa.Table:
        rows, _, texts = ordered(batch)
        flat, sizes = words_of(texts)
        h = word_hashes(flat)
        words, at, place = distinct(h)
        c = classes([flat[i] for i in at])[place]
        order, bounds = split_by(words % np.uint64(n_buckets), n_buckets)
        counts = np.zeros(len(words), np.int64)
        by_class = np.zeros(2 * CLASSES, np.int64)
        for b, x, s in zip(replies["bucket"].to_pylist(), replies["counts"].to_pylist(), replies["sums"].to_pylist(), strict=True):
            part = order[bounds[b] : bounds[b + 1]]
            if len(part):
                counts[part] = np.frombuffer(x, np.uint32 if len(x) == 4 * len(part) else np.uint64)
            by_class += np.frombuffer(s, np.int64)
        n, v = int(by_class[:CLASSES].sum()), int(by_class[CLASSES:].sum())
        seen = counts[place]
        log_seen = np.log10(seen + 1)
        base = log_seen - math.log10(n + v + 1)
        word = log_seen - np.log10(by_class[:CLASSES] + by_class[CLASSES:] + 1)[c]
        x = histories(h, c, sizes)
        kind = np.concatenate([log_likelihood(weights.value, x[i : i + BATCH], c[i : i + BATCH]) for i in range(0, len(c), BATCH)])
        first = np.cumsum(sizes) - sizes
        per_doc = lambda values: np.add.reduceat(values, first) if len(first) else values[:0]
        return pa.table(
            {
                "doc_id": rows["doc_id"],
                "held_out": rows["_held"],
                "n_tokens": pa.array(sizes),
                "n_known": pa.array(per_doc((seen > 0).astype(np.int64))),
                "train_tokens": pa.array([n] * len(sizes), pa.int64()),
                "base_score": pa.array(per_doc(base)),
                "score": pa.array(per_doc(word + kind.astype(np.float64) / math.log(10))),
            }
        )

    replies = rows.groupBy("_batch").applyInArrow(ask, REQUEST).groupBy("bucket").applyInArrow(answer, REPLY)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("_batch").cogroup(replies.groupBy("_batch")).applyInArrow(apply, schema)
