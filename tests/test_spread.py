"""Skew-safe building blocks against brute force, with one key holding most rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from assayline.operators import spread


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for i in range(600):
        key = "hot" if rng.random() < 0.6 else rng.choice("abc")
        out.append((key, rng.randrange(200), i, rng.choice([None, rng.randrange(50)])))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, t int, id int, v int").repartition(7)


def by_key(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    return groups


def test_top_n(df, rows):
    got = {(r.k, r.id) for r in spread.top_n(df, ["k"], [F.col("t").asc(), F.col("id").asc()], 5, spread=F.col("id"), salts=8).collect()}
    want = {(k, r[2]) for k, g in by_key(rows).items() for r in g[:5]}
    assert got == want


def test_previous_value(df, rows):
    got = {r.id: r.p for r in spread.previous_value(df, ["k"], ["t", "id"], "id", F.expr("t div 20"), "p").collect()}
    want = {}
    for g in by_key(rows).values():
        for a, b in zip([None, *g], g):
            want[b[2]] = a[2] if a else None
    assert got == want


def test_carry_forward(df, rows):
    got = {r.id: r.c for r in spread.carry_forward(df, ["k"], ["t", "id"], "v", F.expr("t div 20"), "c").collect()}
    want = {}
    for g in by_key(rows).values():
        last = None
        for r in g:
            last = r[3] if r[3] is not None else last
            want[r[2]] = last
    assert got == want


@pytest.mark.parametrize("cap", [1, 7, 40, 1000])
def test_stride_sample(df, rows, cap):
    got = {r.id for r in spread.stride_sample(df, ["k"], ["t", "id"], cap, F.expr("t div 20")).collect()}
    want = set()
    for g in by_key(rows).values():
        n = len(g)
        want |= {r[2] for r in g} if n <= cap else {g[i * n // cap][2] for i in range(cap)}
    assert got == want


def test_running_total(spark):
    rows = [("k" if i % 3 else "j", i, i % 7) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, pos int, v int")
    got = {(r.k, r.pos): r.s for r in spread.running_total(df, ["k"], "pos", "v", "s", width=16).collect()}
    total, want = {}, {}
    for k, pos, v in rows:
        total[k] = total.get(k, 0) + v
        want[(k, pos)] = total[k]
    assert got == want


def test_chunks_keep_every_row(df, rows):
    out = spread.chunked(df, "k", F.col("id").cast("string"), 50).collect()
    assert sorted(r.id for r in out) == sorted(r[2] for r in rows)
    sizes = {}
    for r in out:
        sizes[(r.k, r.chunk)] = sizes.get((r.k, r.chunk), 0) + 1
    assert max(sizes.values()) < 120


# --------------------------------------------------------------------------- ranges
@pytest.fixture(scope="module")
def busy(spark):
    """3 000 rows of one key on one day (and of a null key), few of others."""
    rng = random.Random(3)
    rows = [("hot", 19_000, i, rng.choice([None, rng.randrange(50)])) for i in range(3000)] + [(None, 19_000, 3000 + i, i % 4 or None) for i in range(500)]
    rows += [("a", 18_000 + i, 4000 + i, i) for i in range(90)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, t int, id int, v int").repartition(5)


def in_order(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    return groups.values()


def test_a_busy_day_is_cut_into_ranges_over_all_tasks(busy):
    rows, df = busy
    cut = spread.in_ranges(df, ["k"], ["t", "id"], 200).groupBy("k", "_seg").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t", "id")).alias("lo"), F.max(F.struct("t", "id")).alias("hi")).collect()
    assert sum(r.n for r in cut) == len(rows) and max(r.n for r in cut) <= 600
    assert len([r for r in cut if r.k == "hot"]) >= 10 and len([r for r in cut if r.k == "a"]) == 1
    hot = sorted((r for r in cut if r.k == "hot"), key=lambda r: r["_seg"])
    assert all(tuple(x.hi) < tuple(y.lo) for x, y in zip(hot, hot[1:]))


def test_prefix_scans_over_ranges(busy):
    rows, df = busy
    want = {}
    for g in in_order(rows):
        last = None
        for p, r in enumerate(g):
            last = r[3] if r[3] is not None else last
            want[r[2]] = (p, len(g), g[p - 1][2] if p else None, last, sum(x[3] or 0 for x in g[: p + 1]))
    order = ["t", "id"]
    got = {r.id: (r.pos, r.n_rows) for r in spread.positions(df, ["k"], order, rows_per_range=200).where("k IS NOT NULL").collect()}
    assert got == {i: w[:2] for i, w in want.items() if i in got} and len(got) == 3090
    got = {r.id: r.p for r in spread.previous_value(df, ["k"], order, "id", None, "p", rows_per_range=200).where("k IS NOT NULL").collect()}
    assert got == {i: want[i][2] for i in got} and len(got) == 3090
    got = {r.id: r.c for r in spread.carry_forward(df, ["k"], order, "v", None, "c", rows_per_range=200).where("k IS NOT NULL").collect()}
    assert got == {i: want[i][3] for i in got} and len(got) == 3090
    some = {r.id for r in spread.stride_sample(df.where("k = 'hot'"), ["k"], order, 7, rows_per_range=200).collect()}
    assert some == {i for i, w in want.items() if i < 3000 and w[0] in {k * 3000 // 7 for k in range(7)}}
    got = {r.id: r.s for r in spread.running_total(df.where("k = 'hot'").withColumn("v", F.coalesce("v", F.lit(0))), ["k"], "id", "v", "s", rows_per_range=200).collect()}
    assert got == {i: want[i][4] for i in got} and len(got) == 3000
