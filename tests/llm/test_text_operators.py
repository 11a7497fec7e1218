"""Operators on texts and urls against plain versions, on small tables with every awkward row."""

from __future__ import annotations

import random
from functools import reduce
from operator import xor

import duckdb
import pytest
from pyspark.sql import functions as F
from brute import contamination, fingerprint, groups, low, mix_targets, near_items, repeats, words

from assayline.llm import decontam, graph, mixing, simhash, substring_dedup, suffix_dedup, url_filter
from assayline.llm.queries import OP1_SQL

SCHEMA = "doc_id long, text string, source string, n_words string, _batch string"


def corpus(seed, passage, vocabulary=40):
    """Texts of a few words, with shared passages, nulls, empties, copies, a long one, and clashing column names."""
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(vocabulary)) + rng.choice(["", ".", "É"])
    shared = [[word() for _ in range(passage + rng.randrange(10))] for _ in range(4)]
    rows = []
    for i in range(60):
        text = [word() for _ in range(rng.randrange(0, 40))]
        if i % 3 == 0:
            text += rng.choice(shared) + [word() for _ in range(5)]
        rows.append((i * 7 % 61, rng.choice([" ", "\n", "  \t"]).join(text), f"s{i % 4}", "x", "y"))
    rows += [(100, None, None, None, None), (101, "", "s0", "x", "y"), (102, "  \n", None, "x", "y"), (103, " ".join(word() for _ in range(4000)), "s1", "x", "y")]
    rows += [(None, " ".join(shared[0]), "s2", "x", "y"), rows[3], (rows[4][0], rows[6][1], "s3", "x", "y"), (104, "one", "s9", "x", "y")]
    return rows


@pytest.mark.parametrize("operator, length", [(substring_dedup.remove_repeats, 6), (suffix_dedup.remove_repeats, 14)])
def test_repeats(spark, operator, length):
    rows = corpus(1, length)
    settings = {"gram": 5} if operator is suffix_dedup.remove_repeats else {}
    got = operator(spark.createDataFrame(rows, SCHEMA), length, keep=("source",), batch_bytes=700, bucket_bytes=500, **settings).collect()
    want = repeats([r[:2] for r in rows], length)
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=key) == sorted(want, key=key)
    assert all(sum(s["end"] - s["start"] for s in r.removed) == r.n_removed for r in got)
    assert sum(w[2] for w in want) > 100
    assert operator(spark.createDataFrame([], SCHEMA), length).count() == 0


def test_repeats_of_one_hot_passage(spark):
    passage = " ".join(f"p{i}" for i in range(80))
    rows = [(i, f"a{i} {passage} z{i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for operator in (substring_dedup.remove_repeats, suffix_dedup.remove_repeats):
        got = operator(docs, batch_bytes=20_000).select("doc_id", "n_removed").collect()
        assert {(r.doc_id == 0, r.n_removed) for r in got} == {(True, 0), (False, 80)}


@pytest.mark.parametrize("broadcast_terms", [0, 100_000])
def test_contamination(spark, broadcast_terms):
    rows = corpus(2, 13)
    items = [(i, (r[1] or "")[k : k + 120].upper()) for i, (r, k) in enumerate(zip(rows[:20], range(0, 40, 2), strict=True))]
    items += [(50, None), (51, ""), (None, "w1 w2"), (3, "W5 w6 w7"), (52, "w9")]
    got = decontam.judge_documents(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string"), keep=("doc_id", "text"), broadcast_terms=broadcast_terms).collect()
    assert [(r.n_words, r.n_hit, r.items, r.contaminated) for r in got] == [contamination(r.text, items) for r in got]
    assert got[0].asDict().keys() == {"doc_id", "text", "n_words", "n_hit", "items", "near_items", "contaminated"}
    assert sum(r.contaminated for r in got) > 5 and len(got) == len(rows)
    none = decontam.judge_documents(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], "item_id long, text string"))
    assert none.where("n_hit > 0 OR contaminated").count() == 0 and none.count() == len(rows)
    assert decontam.judge_documents(spark.createDataFrame([], SCHEMA), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_proximity(spark):
    item = [(1, " ".join(f"t{i}" for i in range(13)))]
    docs = [(1, "t0 t1 x t2"), (2, "t0 y t1"), (3, "t0"), (4, item[0][1])]
    got = decontam.judge_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(item, "item_id long, text string"), slop=3)
    assert {r.doc_id: (r.items, r.near_items) for r in got.collect()}[4] == (["1"], [])


@pytest.mark.parametrize("partitions", [1, 7])
@pytest.mark.parametrize("broadcast_terms", [0, 100_000])
def test_proximity_within_each_document(spark, partitions, broadcast_terms):
    """Near items by the document alone, however rows are put together."""
    filler = [f"c{i}" for i in range(11)]
    items = [(1, " ".join(["r1", *filler, "r2"])), (2, " ".join(["a", "a"])), (3, " ".join([*filler, "r3", "r4"])), (4, " ".join(["r5", "r6", *filler]))]
    middle = " ".join(f"m{i}" for i in range(11))
    texts = [
        "r4", "r3 r4", "r5", "r6", "r6 x r5", f"r1 {middle} r2", f"r1 x x x {middle} r2", f"r1 x x x x {middle} r2", "r1", middle, "r2", "a", "a x a", "", None, "r5 r6", "r3", "r4",
        *[" ".join(filler)] * 90, items[0][1],
    ]
    rng = random.Random(6)
    texts += [" ".join(rng.choice(["r1", "r2", "r3", "r4", "r5", "r6", "a", "x", "c1"]) for _ in range(rng.randrange(12))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).repartition(partitions)
    got = decontam.judge_documents(docs, spark.createDataFrame(items, "item_id long, text string"), broadcast_terms=broadcast_terms).collect()
    near = {r.doc_id: r.near_items for r in got}
    assert [near[i] for i in range(len(texts))] == [near_items(t, texts, items, 3) for t in texts]
    assert near[0] == near[11] == near[7] == [] and near[1] == ["3"] and near[5] == near[6] == ["1"] and near[15] == ["4"]


@pytest.mark.parametrize("node_rows", [4096, 8])
def test_near_duplicates(spark, node_rows):
    rng = random.Random(3)
    base = [[f"v{rng.randrange(900)}" for _ in range(300)] for _ in range(12)]
    rows = [(i, None) for i in range(900, 903)] + [(910, ""), (911, "One"), (912, "one"), (913, "one two"), (None, "one")]
    for i in range(150):
        text = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            text[rng.randrange(300)] = f"v{rng.randrange(900)}"
        rows.append((i, " ".join(text)))
    rows.append(rows[20])
    got = simhash.near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string"), node_rows=node_rows).collect()
    prints = [fingerprint(t) for _, t in rows]
    want = []
    for g in groups(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3):
        least = min((rows[i][0] for i in g if rows[i][0] is not None), default=None)
        want += [(rows[i][0], f"{prints[i]:016x}", least) for i in g]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in got)
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("node_rows", [4096, 1000])
def test_near_links_across_a_split_node(spark, node_rows):
    """Pairs with one differing bit in each of three parts, so one large node alone can find them; all else is 4 or more bits apart."""
    code = [c for c in range(1 << 16) if not c.bit_count() % 2 and not reduce(xor, (k for k in range(16) if c >> k & 1), 0)]
    first = [0x1234 << 48 | c for c in code]
    other = [f ^ (1 << 40 | 1 << 31 | 1 << 15) for f in first]
    far = [f ^ 0xFE << 40 for f in first]
    values = spark.createDataFrame([(f,) for f in first + other + far], "fp long")
    links = simhash.near_links(values, node_rows=node_rows).distinct().collect()
    assert len(code) == 2048 and {frozenset((r.u, r.v)) for r in links} == {frozenset(p) for p in zip(first, other, strict=True)}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1400)] + [(5000, 5000), (None, 3), (6001, 6000), (6000, 6001)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert len({got[i] for i in range(201)}) == len({got[i] for i in range(1000, 1400)}) == 1
    assert got[6000] == got[6001] and len(set(got.values())) == 3 and 5000 not in got


def test_mixing(spark):
    rows = corpus(4, 5)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.plan_mix(docs).collect()
    sizes: dict = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len(words(r[1]))
    targets = mix_targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source]) and r.taken == r.copies * r.size <= 3 * r.size
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan_mix(docs.repartition(3)).collect()))
    once = docs.dropDuplicates(["doc_id", "text"])
    copies = mixing.mix(once).collect()
    assert len(copies) == sum(r.copies for r in mixing.plan_mix(once).collect())
    assert mixing.plan_mix(spark.createDataFrame([], SCHEMA)).count() == 0 == mixing.mix(spark.createDataFrame([], SCHEMA)).count()


def test_mixing_reaches_targets(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(1, 50), f"s{rng.randrange(5)}") for i in range(4000)]
    got = mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) < 0.02 * r["max(target)"] for r in got)


def test_mixing_reaches_targets_on_ties(spark):
    """Sources whose documents share id and size, or are all one document."""
    rows = [(None, f"w{i} w w w", "a") for i in range(1000)] + [(7, "w w w w", "b")] * 1000 + [(i, "w w w w", "c") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.plan_mix(docs)
    got = {r.source: (r.t, r.g, r.n) for r in plan.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.count("*").alias("n")).collect()}
    assert {n for _, _, n in got.values()} == {1000} and all(abs(t - g) < 0.02 * g for t, g, _ in got.values())
    assert sorted(map(str, plan.collect())) == sorted(map(str, mixing.plan_mix(docs.repartition(7)).collect()))


def test_many_rules_make_no_longer_plan(spark):
    """100 000 rules: the plan has as many lines as with five, and a url runs the patterns that its tokens fetch."""
    many = [*url_filter.RULES, *(url_filter.Rule("block" if i % 2 else "allow", f"host{i}.example.com", f"/p{i}/") for i in range(100_000))]
    urls = [(i, f"http://www.host{i}.example.com/p{i}/x") for i in range(0, 100_000, 9973)] + [(-1, "http://host5.example.com/p6/"), (-2, "http://a.org/")]
    table = spark.createDataFrame(urls, "page_id long, url string").withColumn("_tokens", F.lit("mine"))
    judged = url_filter.judge_urls(table, rules=many)
    got = {r.page_id: (r.rule, r.verdict, r["_tokens"]) for r in judged.collect()}
    assert got == {i: (f"host{i}.example.com/p{i}/", "block" if i % 2 else "allow", "mine") for i in range(0, 100_000, 9973)} | {-1: (None, "allow", "mine"), -2: ("org/", "allow", "mine")}
    lines = lambda df: len(df._jdf.queryExecution().executedPlan().toString().splitlines())
    assert lines(judged) == lines(url_filter.judge_urls(table))


def test_urls(spark):
    urls = [
        None, "", "no scheme", "http://", "https://A.Example.ORG/es/x?y=/en/1", "https://example.org/en/12", "https://example.org/en/2", "http://xexample.org/en/1",
        "http://org/", "http://org", "http://www.x.com/fr/#a", "http://com/de/", "http://x.com:80/fr/", "ftp://x.com/fr?z", "http://a://b.org/c", "http://spam-farm.x.net/",
        "http://b.org/\nx", "http://é.org/é",
    ]
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

    def judge(url):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = low(rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))])
            rest = rest[len(host) :]
            path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "block" if "spam-farm." in host else "allow"

    rows = [(i, u, "x") for i, u in enumerate(urls)] + [(None, urls[4], "x"), (4, urls[4], "x")]
    table = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = url_filter.judge_urls(table).collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [judge(r.url) for r in got] and len(got) == len(rows)
    assert url_filter.judge_urls(table.limit(0)).count() == 0
    plan = url_filter.judge_urls(table)._jdf.queryExecution().toString()
    assert "Python" not in plan.split("Physical Plan")[1] and "Exchange" not in plan.split("Physical Plan")[1]


def test_url_patterns_in_host_and_path(spark):
    blocked = ["http://foo.net/best-casino-list", "http://foo.net/x/a-spam-farm.html", "http://foo.net/a.cheap-pills.b", "http://casino.net/", "http://x-spam-farm.net/cheap-pills"]
    allowed = ["http://foo.net/casino-list", "http://foo.net/best-Casino-list", "http://foo.net/best-casinos-list", "http://casino/-x", "http://foo.net/?a-casino-b", "http://foo.net/farm-spam.", "http://foo.org/a-casino-b"]
    rows = [(i, u) for i, u in enumerate(blocked + allowed)]
    got = [tuple(r) for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert [r[4] for r in sorted(got)] == ["block"] * len(blocked) + ["allow"] * len(allowed)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    assert sorted(got) == sorted(con.execute(OP1_SQL).fetchall())


def test_rarest_token_leads():
    rule = url_filter.Rule("block", "shop.example.com", "/a/b")
    assert rule.tokens == ["h:shop", "h:example", "h:com", "p:a"]
    assert url_filter.rarest_token_index([rule], {"h:shop": 5, "h:example": 2, "h:com": 9, "p:a": 3}) == {"h:example": [0]}
