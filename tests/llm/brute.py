"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from xxhash import xxh64_intdigest


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def repeats(docs, length):
    """(id, text) in order -> list of (id, n_words, n_removed, kept)."""
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, (d[1] or "").encode()))
    seen, out = set(), []
    for i, text in docs:
        w = words(text)
        gone = set()
        for s in range(len(w) - length + 1):
            key = tuple(w[s : s + length])
            if key in seen:
                gone.update(range(s, s + length))
            seen.add(key)
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def contamination(text, items, window=13):
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    w, hit, found = tokens(text), set(), set()
    for item_id, item in items:
        v = tokens(item)
        n = min(window, len(v))
        phrases = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for s in range(len(w) - n + 1 if n else 0):
            if tuple(w[s : s + n]) in phrases:
                hit.update(range(s, s + n))
                found.add("" if item_id is None else str(item_id))
    return len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)


def near_items(text, texts, items, slop, window=13):
    """Items without an occurring phrase, of which some phrase's two rarest terms are near their distance in ``text``."""
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    often, w, found = Counter(x for t in texts for x in tokens(t)), tokens(text), set()
    for item_id, item in items:
        v = tokens(item)
        n = min(window, len(v))
        for s in range(len(v) - n + 1 if n else 0):
            p = v[s : s + n]
            order = sorted(range(n), key=lambda k: often[p[k]])  # noqa: B023
            a, b = order[0], order[min(1, n - 1)]
            if any(w[i] == p[a] and w[j] == p[b] and (i != j or n == 1) and abs(j - i - b + a) <= slop for i in range(len(w)) for j in range(max(0, i + b - a - slop), min(len(w), i + b - a + slop + 1))):
                found.add("" if item_id is None else str(item_id))
    return sorted(found - set(contamination(text, items, window)[2]))


def fingerprint(text):
    w = words(low(text))
    if not w:
        return 0
    h = [xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(n, linked):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                parent[root(i)] = root(j)
    out = defaultdict(list)
    for i in range(n):
        out[root(i)].append(i)
    return list(out.values())


def mix_targets(sizes, weights=(5, 2, 1), cap=3):
    """{source: size} -> {source: target}, by resharing until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed: dict = {}
    while True:
        free = [s for s in names if s not in fixed]
        left = sum(sizes.values()) - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > cap * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in above}
