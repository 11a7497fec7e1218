"""Vector code compression: product quantisation by k-means whose assignments are kept by Drake-Hamerly adaptive bounds.

A vector is cut into parts; a part's code is the index of its nearest codebook entry.
Between rounds each vector keeps, per part, an upper bound on the distance to its entry,
its ``b`` next closest entries with lower bounds, and one outer bound on all others.
When entries move, bounds loosen by the way that their entries moved.  Entries from
position m of that order on are too far if the upper bound is below all later lower
bounds, so only the first m are compared again: none for most vectors, all entries
where even the outer bound is too weak.  After each round b becomes as small as all
but one in a hundred comparisons allow.

Bounds are in single precision and rounded outwards, so they only ever say "surely not";
whatever they leave uncertain is decided by squared distances of integers, which are
exact.  The codes are therefore those of comparing everything.

Vectors and bounds are rows in Parquet, written once per round; tasks add up the parts of
each entry, and one row per task and entry is shuffled.  The driver holds the codebooks
(``entries`` times the vector) and nothing that grows with the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import pin, unpin

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Closest entries kept at first and at least, as a part of all entries.
NEAR_FIRST, NEAR_LEAST = 1 / 8, 1 / 32
#: Scaled components are kept within this, so that squared distances fit into 64 bits.
LARGEST = 1 << 26
#: Vectors that are compared with all entries at a time.
CHUNK = 2048
#: A table of labels of up to so many rows (some megabytes) is broadcast, a larger one joined by shuffle.
BROADCAST_LABELS = 100_000


def whole_vectors(vectors: DataFrame, vec: str) -> DataFrame:
    """Rows whose vector is not null and holds neither null nor non-finite components."""
    finite = F.forall(F.col(vec), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where(F.coalesce(finite, F.lit(False)))


def floored(c: Column, scale: int, largest: int) -> Column:
    """floor(scale * c) as an integer within +-largest."""
    return F.greatest(F.lit(-largest), F.least(F.lit(largest), F.floor(F.greatest(F.lit(-2.0**62), F.least(F.lit(2.0**62), c.cast("double") * scale))))).cast("int")


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows: of all pairs, or of ``x`` to its own rows if ``y`` has three axes."""
    most = int(max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)))
    if y.ndim == 2 and 4 * most * most * max(1, x.shape[1]) < 1 << 53:  # exact in doubles, by a matrix product
        a, b = x.astype(np.float64), y.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    if y.ndim == 2:
        return np.stack([((x - e) ** 2).sum(1) for e in y], 1)
    return ((x[:, None, :] - y) ** 2).sum(2)


def above(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 + 1e-6) + 1e-6


def below(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 - 1e-6) - 1e-6


@dataclass
class Bounds:
    """Per vector: its entry, the b next closest ones in order, and bounds: upper, b lower ones, outer.  ``deep`` is how many were compared."""

    entry: np.ndarray
    near: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    deep: np.ndarray


def in_order(d: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Per row, the order by (distance, entry)."""
    first = np.argsort(e, axis=1, kind="stable")
    return np.take_along_axis(first, np.argsort(np.take_along_axis(d, first, 1), axis=1, kind="stable"), 1)


def compare_all(x: np.ndarray, book: np.ndarray, b: int) -> Bounds:
    """Bounds from the distances to every entry."""
    d, k = squared(x, book), len(book)
    some = np.argpartition(d, b + 1, axis=1)[:, : b + 2] if b + 2 < k else np.broadcast_to(np.arange(k), d.shape)
    own = np.argmin(d, axis=1)  # the first of equals
    far = np.take_along_axis(d, some, 1)
    order = in_order(np.where(some == own[:, None], -1, far), some)
    some, far = np.take_along_axis(some, order, 1), np.take_along_axis(far, order, 1)
    outer = below(far[:, b + 1]) if b + 1 < k else np.full(len(x), np.inf)
    lower = np.concatenate([below(far[:, 1 : b + 1]), outer[:, None]], 1)
    return Bounds(own, some[:, 1 : b + 1], above(d[np.arange(len(x)), own]), lower, np.full(len(x), b + 1))


def compare_some(x: np.ndarray, book: np.ndarray, moved: np.ndarray, old: Bounds) -> Bounds:
    """Bounds after the entries have moved by ``moved``; only uncertain vectors are compared."""
    n, b = old.near.shape
    entry, near = old.entry.copy(), old.near.copy()
    upper = old.upper + moved[entry]
    lower = old.lower - np.concatenate([moved[near], np.full((n, 1), moved.max())], 1)
    deep = np.zeros(n, np.int64)
    later = np.minimum.accumulate(lower[:, ::-1], axis=1)[:, ::-1]  # below all entries from a position on
    at = np.flatnonzero(~(upper < later[:, 0]))
    own = squared(x[at], book[entry[at]][:, None, :])[:, 0]
    upper[at] = above(own)
    sure = upper[at, None] < later[at]
    m = np.where(sure.any(1), sure.argmax(1), b + 1)
    deep[at] = m
    few = (m > 0) & (m <= b)
    if few.any():
        rows, m, top = at[few], m[few], int(m[few].max())
        who = np.concatenate([entry[rows, None], near[rows, :top]], 1)
        d = np.concatenate([own[few, None], squared(x[rows], book[who[:, 1:]])], 1)
        out = np.arange(top + 1)[None, :] > m[:, None]
        order = in_order(np.where(out, np.iinfo(np.int64).max, d), np.where(out, len(book) + np.arange(top + 1)[None, :], who))
        who, d = np.take_along_axis(who, order, 1), np.take_along_axis(d, order, 1)
        entry[rows], upper[rows] = who[:, 0], above(d[:, 0])
        near[rows, :top] = who[:, 1:]
        lower[rows, :top] = np.where(out[:, 1:], lower[rows, :top], below(d[:, 1:]))
    lost = at[deep[at] == b + 1]
    for i in range(0, len(lost), CHUNK):
        rows = lost[i : i + CHUNK]
        new = compare_all(x[rows], book, b)
        entry[rows], near[rows], upper[rows], lower[rows] = new.entry, new.near, new.upper, new.lower
    return Bounds(entry, near, upper, lower, deep)


def matrix(column: pa.Array, n: int, kind: type) -> np.ndarray:
    """A column of lists of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(n, -1)


def lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows as a column of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel(), kind))


def assign(state: DataFrame, books: np.ndarray, moved: np.ndarray | None, b: int, old_b: int) -> DataFrame:
    """The next state: rows with their entries, nearest others, bounds and depths after the codebooks (part, entry, position) have moved."""
    parts, k, _ = books.shape

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                rows = batch.slice(i, CHUNK)
                n = rows.num_rows
                x = matrix(rows.column("x"), n, np.int64).reshape(n, parts, -1)
                if moved is not None:
                    entries = matrix(rows.column("entries"), n, np.int64).reshape(n, parts, old_b + 1)
                    bounds = matrix(rows.column("bounds"), n, np.float64).reshape(n, parts, old_b + 2)
                made = []
                for p in range(parts):
                    if moved is None:
                        made.append(compare_all(x[:, p], books[p], b))
                        continue
                    # A smaller b: the outer bound is now one on the entries left out, too.
                    lower = np.concatenate([bounds[:, p, 1 : b + 1], bounds[:, p, b + 1 :].min(axis=1, keepdims=True)], 1)
                    made.append(compare_some(x[:, p], books[p], moved[p], Bounds(entries[:, p, 0], entries[:, p, 1 : b + 1], bounds[:, p, 0], lower, None)))
                entries = np.concatenate([np.concatenate([m.entry[:, None], m.near], 1) for m in made], 1)
                up, low = (lambda v: np.nextafter(v.astype(np.float32), np.float32(np.inf))), (lambda v: np.nextafter(v.astype(np.float32), np.float32(-np.inf)))
                bounds = np.concatenate([np.concatenate([up(m.upper)[:, None], low(m.lower)], 1) for m in made], 1)
                deep = np.stack([m.deep for m in made], 1)
                columns = [rows.column("vec_id"), rows.column("label"), rows.column("x"), lists(entries.astype(np.int16), pa.int16()), lists(bounds, pa.float32()), lists(deep.astype(np.int16), pa.int16())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "x", "entries", "bounds", "deep"])

    kinds = dict(state.dtypes)
    return pin(state.mapInArrow(each, f"vec_id long, label {kinds['label']}, x array<int>, entries array<smallint>, bounds array<float>, deep array<smallint>"))


def gathered(state: DataFrame, parts: int, k: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per part and entry the number and the sum of its parts; and how many comparisons were of each depth."""
    size = len(state.first()["x"]) // parts

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, depth = np.zeros((parts, k), np.int64), np.zeros((parts, k, size), np.int64), np.zeros(b + 2, np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = matrix(batch.column("x"), n, np.int64).reshape(n, parts, size)
            entry = matrix(batch.column("entries"), n, np.int64).reshape(n, parts, -1)[:, :, 0]
            depth += np.bincount(matrix(batch.column("deep"), n, np.int64).ravel(), minlength=b + 2)
            for p in range(parts):
                order = np.argsort(entry[:, p], kind="stable")
                own, start = np.unique(entry[order, p], return_index=True)
                count[p, own] += np.diff(np.append(start, n))
                total[p, own] += np.add.reduceat(x[order, p], start, axis=0)
        p, e = np.nonzero(count)
        if len(p):
            rows = [(p, e, count[p, e], total[p, e]), (np.full(b + 2, -1), np.arange(b + 2), depth, np.zeros((b + 2, size), np.int64))]
            p, e, n, s = (np.concatenate(c) for c in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n), lists(s, pa.int64())], ["part", "entry", "n", "total"])

    added = state.select("x", "entries", "deep").mapInArrow(each, "part int, entry int, n long, total array<long>")
    sums = added.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(size)]).alias("total"))
    count, total, depth = np.zeros((parts, k), np.int64), np.zeros((parts, k, size), np.int64), np.zeros(b + 2, np.int64)
    for r in sums.collect():  # at most entries + depths
        if r["part"] < 0:
            depth[r["entry"]] = r["n"]
        else:
            count[r["part"], r["entry"]], total[r["part"], r["entry"]] = r["n"], r["total"]
    return count, total, depth


def adapted(depth: np.ndarray, b: int, least: int) -> int:
    """The smallest b that would have been enough for all but one in a hundred of the comparisons that b was enough for."""
    tried = depth[1 : b + 1]
    if not tried.sum():
        return least
    enough = int(np.searchsorted(np.cumsum(tried), 0.99 * tried.sum())) + 1
    return min(b, max(least, enough))


def compress(
    vectors: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, codes, error) per vector, and the codebooks (part, entry, position) as integers.

    Components become floor(scale * x).  Each part's codebook starts as that part of the
    ``entries`` smallest ids (null ids last, equal ids by vector; fewer rows: fewer
    entries).  ``rounds`` times every part goes to its nearest entry (ties: the lower
    one) and every entry becomes the floor of its parts' mean, one without parts stays;
    then parts are assigned once more.  ``codes`` are entry indexes in the order of the
    parts, ``error`` is the sum of their exact squared distances.

    Rows whose vector is null, or holds null or non-finite components, are dropped.
    Vectors shorter than the longest, or not divisible into parts, count as if zeros
    followed; scaled components beyond +-2**26 as +-2**26 (distances then fit into 64
    bits for parts of up to 256 components).  Repeated rows, ids and null ids keep a
    row each; other columns are not read; nothing in gives nothing, and empty codebooks.
    """
    rows = whole_vectors(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vec).alias("vec")), "vec")
    longest = rows.agg(F.max(F.size("vec"))).first()[0]
    if longest is None:
        return rows.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    size = max(1, -(-longest // parts)) * parts
    x = F.transform("vec", lambda c: floored(c, scale, LARGEST))
    even = F.when(F.size(x) == size, x).otherwise(F.concat(x, F.array_repeat(F.lit(0), F.lit(size) - F.size(x))))
    state = pin(rows.select("vec_id", "label", even.alias("x")))
    first = state.orderBy(F.asc_nulls_last("vec_id"), "x").select("x").limit(entries).collect()
    books = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    k = books.shape[1]
    b = old_b = min(k - 1, max(1, round(k * NEAR_FIRST)))
    moved = None
    for _ in range(rounds):
        before, state = state, assign(state, books, moved, b, old_b)
        unpin(before)
        count, total, depth = gathered(state, parts, k, b)
        new = np.where(count[:, :, None] > 0, total // np.maximum(count, 1)[:, :, None], books)
        moved = np.stack([above(((p - q) ** 2).sum(1)) for p, q in zip(new, books, strict=True)])
        old_b, b, books = b, b if moved is None else adapted(depth, b, min(b, max(1, round(k * NEAR_LEAST)))), new
    before, state = state, assign(state, books, moved, b, old_b)
    if rounds:
        unpin(before)

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                x = matrix(batch.column("x"), n, np.int64).reshape(n, parts, -1)
                code = matrix(batch.column("entries"), n, np.int64).reshape(n, parts, -1)[:, :, 0]
                error = sum(((x[:, p] - books[p, code[:, p]]) ** 2).sum(1) for p in range(parts))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), lists(code.astype(np.int32), pa.int32()), pa.array(error, pa.int64())], ["vec_id", "label", "codes", "error"])

    done = state.select("vec_id", "label", "x", "entries").mapInArrow(decided, f"vec_id long, label {dict(rows.dtypes)['label']}, codes array<int>, error long")
    return done, books


def digest(books: np.ndarray) -> str:
    """SHA-256 of the entries' components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(vectors: DataFrame, **how: object) -> DataFrame:
    """Per vector: vec_id, code (two hex digits a part), error, label_error (summed over equal labels, nulls together) and codebooks_sha256.

    Rules and edge cases as in :func:`compress`.
    """
    done, books = compress(vectors, **how)  # type: ignore[arg-type]
    done = pin(done)
    totals = done.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    if (totals := pin(totals)).count() <= BROADCAST_LABELS:
        totals = F.broadcast(totals)
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return done.join(totals, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
