"""Embedding whitening: blockwise QR over all rows, then singular values and directions of its factor.

Each distinct vector counts once.  Tasks turn blocks of centred rows into triangular
factors, factors meet sixteen at a time and are factored again, so what a task holds is
bounded by the vector's length, whatever the number of rows.  The last factor has the
covariance's eigenvectors as right singular vectors (``bidiagonal``); no product of rows
is ever formed, so small eigenvalues keep their digits.  A last pass measures how far
the whitened fit list is from unit covariance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.bidiagonal import right_singular
from assayline.llm.code_compression import floored, lists, matrix, whole_vectors
from assayline.llm.common import pin, unpin

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: floor(64 * c) is kept within this, so that sums over two thousand million rows fit into 64 bits.
LARGEST = (1 << 31) - 1
#: Rows that are factored at a time, and factors that meet.
BLOCK, FAN = 4096, 16


def added(frame: DataFrame, each: object, kind: str, size: int) -> np.ndarray:
    """Arrays of ``size`` numbers, one from each task, added up in Spark."""
    rows = frame.mapInArrow(each, f"at int, value {kind}").groupBy("at").agg(F.sum("value").alias("value")).collect()  # type: ignore[arg-type]
    out = np.zeros(size, np.int64 if kind == "long" else np.float64)
    for r in rows:
        out[r["at"]] = r["value"]
    return out


def parts(x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(x.size, dtype=np.int32)), pa.array(x.ravel())], ["at", "value"])


def triangle(rows: np.ndarray) -> np.ndarray:
    """The triangular factor of some rows, square."""
    size = rows.shape[1]
    r = np.linalg.qr(rows, mode="r")
    return np.concatenate([r, np.zeros((size - len(r), size))]) if len(r) < size else r


def factor(fit: DataFrame, n: int, total: np.ndarray) -> np.ndarray:
    """R with R'R = the sum of (x - mean)(x - mean)' over ``fit`` (x)."""
    size = len(total)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, size))
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(i, BLOCK)
                centred = (matrix(rows.column("x"), rows.num_rows, np.int64) * n - total) / n
                r = triangle(np.concatenate([r, centred]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), lists(r.reshape(1, -1), pa.float64())], ["id", "r"])

    def meet(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["id"].to_numpy(), kind="stable")
        stacked = matrix(rows["r"].combine_chunks(), rows.num_rows, np.float64)[order].reshape(-1, size)
        return pa.table({"id": pa.array([int(rows["id"].to_numpy().min())], pa.int64()), "r": lists(triangle(stacked).reshape(1, -1), pa.float64())})

    factors = pin(fit.mapInArrow(local, "id long, r array<double>"))
    while (count := factors.count()) > FAN:
        before = factors
        factors = pin(factors.groupBy(F.pmod(F.xxhash64("id"), F.lit(-(-count // FAN))).alias("group")).applyInArrow(meet, "id long, r array<double>"))
        unpin(before)
    rows = sorted((r["id"], r["r"]) for r in factors.collect())
    unpin(factors)
    return triangle(np.array([r for _, r in rows]).reshape(-1, size))


def whiten(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Per row and component: vec_id, component (from 1), n, deviation, whitened, explained and identity_error.

    x = floor(64 * c) + 1000000 for each entry c.  The fit list is each distinct x once: n of
    them, with sums S.  Components are the covariance's unit eigenvectors by falling
    eigenvalue e, their largest entry positive.  deviation is the exact sum of
    (n * x - S)^2, null where it does not fit into 64 bits; whitened is x - S/n on the
    component, over sqrt(e); explained is e over the trace; identity_error is the largest
    entry of the whitened fit list's covariance minus the identity.

    Rows whose vector is null, or holds null or non-finite entries, are dropped.  Vectors
    shorter than the longest count as if zeros followed, floor(64 * c) beyond +-(2**31 - 1)
    as that.  A direction without variance (a singular value of at most 1e-10 of the
    largest) is no component, so equal vectors, a single one and an empty table give no
    rows.  Repeated rows, ids and null ids keep their rows; other columns are not read.
    """
    rows = whole_vectors(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vec).alias("vec")), "vec")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    none = vectors.sparkSession.createDataFrame([], schema)
    size = rows.agg(F.max(F.size("vec"))).first()[0]
    if not size:
        return none
    x = F.transform("vec", lambda c: floored(c, SCALE, LARGEST))
    even = F.when(F.size(x) == size, x).otherwise(F.concat(x, F.array_repeat(F.lit(0), F.lit(size) - F.size(x))))
    rows = pin(rows.select("vec_id", even.alias("x")))
    fit = pin(rows.select("x").distinct())
    n = fit.count()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros(size, np.int64)
        for batch in batches:
            s += matrix(batch.column("x"), batch.num_rows, np.int64).sum(0) if batch.num_rows else 0
        yield parts(s)

    total = added(fit, sums, "long", size)  # of x without the shift, which centring takes away again
    r = factor(fit, n, total)
    square, directions = right_singular(r, components)
    k = len(square)
    if not k:
        return none
    explained = square / float((r * r).sum())
    scaled = directions / np.sqrt(square / n)

    def projected(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        off = matrix(batch.column("x"), batch.num_rows, np.int64) * n - total
        return off, (off / n) @ scaled

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros((k + 1, k))
        for batch in batches:
            if batch.num_rows:
                w = projected(batch)[1]
                s += np.concatenate([w.T @ w, w.sum(0)[None]])
        yield parts(s)

    m = added(fit, moments, "double", (k + 1) * k).reshape(k + 1, k) / n
    error = float(np.abs(m[:k] - np.outer(m[k], m[k]) - np.eye(k)).max())

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                off, w = projected(part)
                fits = (off.astype(np.float64) ** 2).sum(1) < 2.0**62
                square_sum = np.where(fits[:, None], off, 0)
                square_sum = (square_sum * square_sum).sum(1)
                at = np.repeat(np.arange(len(w)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(w))), pa.array(np.full(len(at), n, np.int64)),
                        pa.array(square_sum[at], pa.int64(), mask=~fits[at]), pa.array(w.ravel()), pa.array(np.tile(explained, len(w))), pa.array(np.full(len(at), error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(answer, schema)
