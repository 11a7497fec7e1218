"""Singular values and right singular vectors of a small triangular factor: Householder bidiagonals, dqds, twisted factorisations.

Sizes are those of a vector, not of a table: the factor comes from a QR decomposition
that Spark has done over all rows.
"""

from __future__ import annotations

import math

import numpy as np

EPS = float(np.finfo(np.float64).eps)


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal a and superdiagonal b of B, and orthogonal V, with R = U B V' for some orthogonal U."""
    r, n = np.array(r, np.float64), len(r)
    v = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        """Unit vector h so that x - 2 h (h'x) has zeros after its first entry; None if it has them."""
        scale = np.abs(x).max(initial=0)
        if len(x) < 2 or np.abs(x[1:]).max() == 0 or scale == 0:
            return None
        h = x / scale
        h[0] += math.copysign(np.linalg.norm(h), h[0])
        return h / np.linalg.norm(h)

    for k in range(n):
        if (h := reflector(r[k:, k])) is not None:
            r[k:, k:] -= 2 * np.outer(h, h @ r[k:, k:])
        if k + 1 < n and (h := reflector(r[k, k + 1 :])) is not None:
            r[k:, k + 1 :] -= 2 * np.outer(r[k:, k + 1 :] @ h, h)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ h, h)
    return np.diag(r).copy(), np.diag(r, 1).copy(), v


def sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float]:
    """One differential quotient-difference step: the next q and e, and the smallest d (negative or nan: the shift is too large)."""
    d, least = q[0] - shift, q[0] - shift
    new_q, new_e = [], []
    for i in range(len(q) - 1):
        x = d + e[i]
        t = q[i + 1] / x if x else math.inf
        new_q.append(x)
        new_e.append(e[i] * t)
        d = d * t - shift
        if not d >= least:
            least = d
    new_q.append(d)
    return new_q, new_e, least


def squares(q: list[float], e: list[float]) -> list[float]:
    """Squared singular values of the bidiagonal with squared diagonal q > 0 and squared superdiagonal e > 0, by dqds; descending."""
    found: list[float] = []
    todo = [(list(q), list(e), 0.0)]
    while todo:
        q, e, moved = todo.pop()
        least = 0.0
        for _ in range(60 * len(q) + 100):
            while len(q) > 1 and e[-1] <= (8 * EPS) ** 2 * (moved + q[-1]):
                found.append(moved + q.pop())
                e.pop()
                least = 0.0
            if len(q) == 1:
                break
            cut = next((i for i in range(len(e)) if e[i] <= EPS**2 * moved), None)
            if cut is not None:
                todo.append((q[cut + 1 :], e[cut + 1 :], moved))
                q, e, least = q[: cut + 1], e[:cut], 0.0
                continue
            if q[0] < q[-1] and moved == 0 and least == 0:  # the small end has to be the last
                q, e = q[::-1], e[::-1]
            for shift in (least * 0.998, least * 0.75, least * 0.25, 0.0):
                new_q, new_e, low = sweep(q, e, shift)
                if low >= 0 and not math.isnan(low):
                    break
            q, e, moved, least = new_q, new_e, moved + shift, low
        found += [moved + x for x in q]
    return sorted(found, reverse=True)


def twisted(a: np.ndarray, b: np.ndarray, value: float, other: int = 0) -> tuple[np.ndarray, float]:
    """A unit eigenvector of B'B for ``value``, twisted where the residual is smallest (``other``: next smallest), and the value it gives.

    B'B = L D L' with D = a**2 and L = b / a; the factors of L D L' - value from the top and
    from the bottom meet at the twist.
    """
    n = len(a)
    l = b / a[:-1]
    off = a[:-1] * b
    tiny = EPS * EPS * max(abs(value), float((a * a).max()))
    down, up = np.zeros(n - 1), np.zeros(n - 1)
    s, p = np.empty(n), np.empty(n)
    s[0] = -value
    for i in range(n - 1):
        d = s[i] + a[i] * a[i]
        down[i] = off[i] / (d if abs(d) > tiny else tiny)
        s[i + 1] = down[i] * l[i] * s[i] - value
    p[-1] = a[-1] * a[-1] - value
    for i in range(n - 2, -1, -1):
        d = b[i] * b[i] + p[i + 1]
        t = a[i] * a[i] / (d if abs(d) > tiny else tiny)
        up[i] = l[i] * t
        p[i] = p[i + 1] * t - value
    gamma = np.abs(s + p + value)
    k = int(np.argsort(np.where(np.isnan(gamma), np.inf, gamma), kind="stable")[min(other, n - 1)])
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -up[i] * z[i]
    if not np.isfinite(z).all():
        z = np.nan_to_num(z / np.abs(z[np.isfinite(z)]).max(initial=1.0), posinf=1.0, neginf=-1.0)
    z /= np.linalg.norm(z)
    w = a * z
    w[:-1] += b * z[1:]
    return z, float(w @ w)


def right_singular(r: np.ndarray, top: int, rank_tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` largest squared singular values of a square matrix, descending, and their right singular vectors as columns.

    Singular values of at most ``rank_tol`` times the largest count as zero and are left
    out.  A vector's largest entry is positive.
    """
    n, scale = len(r), float(np.abs(r).max(initial=0))
    if not scale:
        return np.zeros(0), np.zeros((n, 0))
    a, b, v = bidiagonalise(r / scale)
    # A zero on the diagonal, or a zero link, makes factors break off: neither changes a value by more than rounding does.
    floor = EPS * EPS * max(np.abs(a).max(), np.abs(b).max(initial=0))
    a[np.abs(a) < floor] = floor
    links = np.abs(b) > EPS * 0.1 * np.minimum(np.abs(a[:-1]), np.abs(a[1:]))
    blocks, start = [], 0
    for end in [*(np.flatnonzero(~links) + 1), n]:
        blocks.append((start, int(end)))
        start = int(end)
    pairs = sorted(((x, lo, hi) for lo, hi in blocks for x in squares((a[lo:hi] ** 2).tolist(), (b[lo : hi - 1] ** 2).tolist())), reverse=True)
    most = pairs[0][0]
    pairs = [p for p in pairs if p[0] > rank_tol**2 * most][:top]
    values, vectors = [], np.zeros((n, len(pairs)))
    for j, (value, lo, hi) in enumerate(pairs):
        near = [i for i in range(j) if values[i] - value <= 1e-5 * values[i]]
        for turn in range(hi - lo):
            y = np.zeros(n)
            y[lo:hi], better = twisted(a[lo:hi], b[lo : hi - 1], value, turn)
            # One more step from the value that the vector itself gives.
            y[lo:hi], better = twisted(a[lo:hi], b[lo : hi - 1], better if abs(better - value) <= 1e-8 * value else value, turn)
            for _ in range(2):  # vectors of almost equal values are made orthogonal
                y -= vectors[:, near] @ (vectors[:, near].T @ y)
            if (size := np.linalg.norm(y)) > 0.1:
                break
        values.append(better if abs(better - value) <= 1e-8 * value else value)
        vectors[:, j] = y / size
    out = v @ vectors
    out *= np.where(out[np.abs(out).argmax(axis=0), np.arange(len(pairs))] < 0, -1.0, 1.0)
    return np.array(values) * scale**2, out
