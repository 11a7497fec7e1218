"""Vector codes and whitening against plain versions that compare and multiply everything."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from assayline.llm import bidiagonal, code_compression, whitening

INF, NAN = float("inf"), float("nan")


def vectors(n, size, centres, seed, noise=0.3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((centres, size))[rng.integers(0, centres, n)] + noise * rng.standard_normal((n, size))
    x[n // 3 : 2 * n // 3] = x[0]  # a vector that a third of all rows share
    return np.float32(x)


def odd_rows(size):
    """Rows that take no part."""
    return [(-1, None, 1), (-2, [NAN] * size, 1), (-3, [None] + [1.0] * (size - 1), 1), (-4, [INF] * size, None)]


def plain_codes(rows, parts=4, entries=256, rounds=4):
    x = [[int(np.floor(np.float64(c) * 1024)) for c in v] for _, v, _ in rows]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, x[i]))[:entries]
    d = len(x[0]) // parts
    cut = np.array(x, np.int64).reshape(len(x), parts, d)
    books = cut[first].transpose(1, 0, 2).copy()
    far = lambda: np.stack([((cut[:, p, None] - books[p][None]) ** 2).sum(2) for p in range(parts)], 1)
    for _ in range(rounds):
        own = far().argmin(2)
        for p in range(parts):
            for e in range(books.shape[1]):
                if (own[:, p] == e).any():
                    got = cut[own[:, p] == e, p]
                    books[p, e] = got.sum(0) // len(got)
    dist = far()
    own, error = dist.argmin(2), dist.min(2).sum(1)
    by = defaultdict(int)
    for (_, _, label), e in zip(rows, error, strict=True):
        by[label] += int(e)
    sha = hashlib.sha256(",".join(str(c) for c in books.ravel()).encode()).hexdigest()
    return sorted((str(i), "".join(f"{c:02x}" for c in o), int(e), by[label], sha) for (i, _, label), o, e in zip(rows, own, error, strict=True))


@pytest.mark.parametrize("n, size, centres", [(1500, 16, 12), (40, 8, 5), (1, 4, 1)])
def test_codes(spark, n, size, centres):
    x = vectors(n, size, centres, 3)
    rows = [(i * 3 % (n + 7), [float(c) for c in v], None if i % 3 == 0 else i % 5) for i, v in enumerate(x)]
    rows += [(None, rows[0][1], 9), rows[n // 2]]
    table = spark.createDataFrame([(*r, "x") for r in [*rows, *odd_rows(size)]], "vec_id long, embedding array<float>, label int, code string")
    got = sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in code_compression.coded(table.repartition(5)).collect())
    assert got == plain_codes(rows)


def test_codes_of_nothing_and_of_ragged_and_huge_vectors(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1), (2, [3e38, -3e38, 0.0, 1.0, 5.0], 1), (3, [], 2)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in code_compression.coded(table).collect()}
    assert len(got) == 3 and {len(r.code) for r in got.values()} == {8} and all(r.error == 0 for r in got.values())
    assert code_compression.coded(table.limit(0)).count() == 0 and code_compression.coded(table.where("vec_id > 9")).count() == 0


def test_bounds_skip_comparisons_and_lose_no_tie():
    """Many equal distances: the kept order gives the same entry as comparing all, and most vectors are not compared."""
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (4000, 4)) * 7 + rng.integers(0, 2, (4000, 4))
    book = np.unique(x, axis=0)[::19][:64]
    state, b, skipped = code_compression.compare_all(x, book, 8), 8, 0
    for turn in range(8):
        assert (code_compression.squared(x, book).argmin(1) == state.entry).all()
        new = book.copy()
        for e in range(0, 64, turn + 1):
            if (state.entry == e).any():
                new[e] = x[state.entry == e].sum(0) // (state.entry == e).sum()
        moved, book = code_compression.above(((new - book) ** 2).sum(1)), new
        state = code_compression.compare_some(x, book, moved, state)
        skipped += int((state.deep <= b).sum())
    assert skipped > len(x)


def test_large_integers_are_exact():
    x = np.array([[1 << 26, -(1 << 26)], [0, 1]], np.int64)
    assert code_compression.squared(x, -x).tolist() == [[1 << 55, (1 << 52) + ((1 << 26) - 1) ** 2], [(1 << 52) + ((1 << 26) - 1) ** 2, 4]]


def plain_whitening(x, k):
    """From the covariance of the distinct integer vectors, by a symmetric eigensolver."""
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    off = (fit * n - total) / n
    value, vector = np.linalg.eigh(off.T @ off / n)
    value, vector = value[::-1], vector[:, ::-1]
    k = min(k, int((value > 1e-9 * value[0]).sum()))
    exact = [sum(int(a) ** 2 for a in row) for row in (x * n - total)]
    return n, exact, ((x * n - total) / n) @ vector[:, :k] / np.sqrt(value[:k]), value[:k] / value.sum()


@pytest.mark.parametrize("n, size", [(900, 20), (9, 24), (300, 5)])
def test_whitening(spark, monkeypatch, n, size):
    monkeypatch.setattr(whitening, "FAN", 2)
    x = vectors(n, size, 7, 4)
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)] + [(None, [float(c) for c in x[1]], 1), (5, [float(c) for c in x[5]], 1)]
    table = spark.createDataFrame([(*r, "x") for r in [*rows, *odd_rows(size)]], "vec_id long, embedding array<float>, label int, x string")
    got = whitening.whiten(table.repartition(7)).collect()
    whole = np.floor(np.array([v for _, v, _ in rows], np.float64) * 64).astype(np.int64) + 1_000_000
    count, deviation, want, explained = plain_whitening(whole, 16)
    assert len(got) == len(rows) * want.shape[1]
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r.component):
        assert r.n == count and r.identity_error < 1e-9
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        by[r.vec_id].append((r.component, r.deviation, r.whitened))
    sign = np.sign(want[np.abs(want).argmax(0), range(want.shape[1])])
    ids = [i for i, _, _ in rows]
    large = ids.index(None)
    first = {c: w for c, _, w in by[None]}
    flip = [1 if abs(first[c + 1] - want[large, c]) <= abs(first[c + 1] + want[large, c]) else -1 for c in range(want.shape[1])]
    assert len(sign) == len(flip)
    for i, row, exact in zip(ids, want, deviation, strict=True):
        assert {d for _, d, _ in by[i]} == {exact}
        assert np.allclose([w for c, _, w in by[i][: len(row)]] if ids.count(i) == 1 else [w for _, _, w in by[i][::2]], row * flip, atol=1e-6)


def test_whitening_without_variance(spark):
    table = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<float>")
    assert whitening.whiten(table).count() == 0 and whitening.whiten(table.limit(0)).count() == 0
    ragged = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0]), (3, []), (4, [3e38, -3e38])], "vec_id long, embedding array<float>")
    got = whitening.whiten(ragged).collect()
    assert {r.vec_id for r in got} == {1, 2, 3, 4} and all(np.isfinite(r.whitened) for r in got) and all(r.deviation is None for r in got if r.vec_id == 4)


@pytest.mark.parametrize("kind", ["random", "pairs", "zero columns", "graded", "low rank"])
def test_singular_vectors(kind):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((80, 30))
    if kind == "pairs":
        x = np.repeat(np.eye(30)[:15], 4, 0) * 3.0
    elif kind == "zero columns":
        x[:, [3, 9]] = 0
    elif kind == "graded":
        x *= 10.0 ** (-np.arange(30) / 6)
    elif kind == "low rank":
        x = x[:, :5] @ rng.standard_normal((5, 30))
    r = whitening.triangle(x)
    value, vector = bidiagonal.right_singular(r, 30)
    want = np.linalg.svd(x)[1] ** 2
    assert np.allclose(value, want[: len(value)], rtol=1e-11) and (want[len(value) :] < 1e-18 * want[0]).all()
    assert np.abs(vector.T @ vector - np.eye(len(value))).max() < 1e-11
    assert np.abs(x.T @ (x @ vector) - vector * value).max() < 1e-12 * value[0]
