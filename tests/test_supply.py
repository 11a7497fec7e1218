"""Look-alikes, three-valued lookups, agent servers, licences."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from assayline.operators import supply
from assayline.sources import packages

NOW = "2024-01-31 00:00:00"


def edits(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(cur[-1] + 1, prev[j] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_lookalikes_both_ways_match_brute_force(spark):
    rng = random.Random(3)
    names = set()
    for _ in range(150):
        w = list(rng.choice(supply.POPULAR_PACKAGES))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w) + 1)
            rng.choice([lambda: w.insert(i, "q"), lambda: w.pop(min(i, len(w) - 1)) if len(w) > 1 else None])()
        names.add("".join(w))
    want = {}
    for n in names:
        best = min(((edits(n.lower(), p.lower()), i, p) for i, p in enumerate(supply.POPULAR_PACKAGES)))
        if 0 < best[0] <= 2:
            want[n] = best[2]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    inline = {r.name: r.top for r in df.select("name", F.inline(supply.nearest_popular(F.col("name")))).collect()}
    popular = spark.createDataFrame([(p, i) for i, p in enumerate(supply.POPULAR_PACKAGES)], "top string, pos int")
    keyed = {r.name: r.top for r in supply.lookalikes_by_key(df, popular).collect()}
    assert inline == want == keyed


def test_unknown_is_not_missing(spark):
    deps = spark.createDataFrame([("r", n) for n in ("gone", "old", "new", "here")], "repo_id string, name string")
    reg = spark.createDataFrame(
        [("gone", False, "2024-01-30 12:00:00"), ("old", False, "2024-01-29 12:00:00"), ("here", True, "2024-01-30 12:00:00")],
        "name string, exists boolean, checked_at string",
    ).withColumn("checked_at", F.to_timestamp("checked_at"))
    found = supply.missing_packages(deps, reg, F.lit(NOW).cast("timestamp")).collect()
    assert [r.package for r in found] == ["gone"]


def test_package_verdicts(spark):
    req = spark.createDataFrame([("gone", "1"), ("unseen", "1"), ("bad", "1"), ("mild", "1"), ("reakt", "1"), ("fine-one-here", "1"), ("nolatest", None)], "name string, version string")
    reg = spark.createDataFrame([("gone", False), ("bad", True), ("mild", True), ("reakt", True), ("fine-one-here", True), ("nolatest", True)], "name string, exists boolean")
    adv = spark.createDataFrame([("bad", "1", "A", "HIGH"), ("mild", "1", "B", "LOW")], "name string, version string, vuln_id string, raw_severity string")
    latest = spark.createDataFrame([], "name string, version string")
    got = {r.name: r.verdict for r in supply.package_verdict(req, reg, adv, latest).collect()}
    assert got == {"gone": "block", "unseen": "warn", "bad": "block", "mild": "warn", "reakt": "warn", "fine-one-here": "safe", "nolatest": "warn"}


def test_lockfile_layouts(spark):
    docs = spark.createDataFrame(
        [
            ("v3", '{"packages":{"":{"version":"1"},"node_modules/a":{"version":"1"},"node_modules/a/node_modules/@s/b":{"version":"2"},"node_modules/c":{}},"dependencies":{"z":{"version":"9"}}}'),
            ("v1", '{"dependencies":{"d":{"version":"3"},"e":{}}}'), ("bad", "{"),
        ],
        "repo_id string, content string",
    )
    assert {tuple(r) for r in packages.flatten_lockfile(docs).collect()} == {("v3", "a", "1"), ("v3", "@s/b", "2"), ("v1", "d", "3")}


def test_latest_stable(spark):
    v = spark.createDataFrame([("p", x) for x in ("1.9.0", "1.10.0", "2.0.0-rc.1", "junk")], "name string, version string")
    assert supply.latest_stable_version(v).collect()[0].version == "1.10.0"


def test_long_names_find_their_lookalike(spark):
    long = "@scope/" + "averylongpackagename" * 4
    names = spark.createDataFrame([(long[:40] + "x" + long[41:],), (long[:-1],), ("q" + long,), ("ab",), (long,)], "name string")
    popular = spark.createDataFrame([(long, 1), ("abc", 2), ("a", 3)], "top string, pos int")
    got = {r.name: (r.top, r.distance) for r in supply.lookalikes_by_key(names, popular).collect()}
    assert got == {long[:40] + "x" + long[41:]: (long, 1), long[:-1]: (long, 1), "q" + long: (long, 1), "ab": ("abc", 1)}


def test_a_hundred_thousand_workspace_globs_in_one_repository(spark):
    many = spark.range(100_000).select(F.concat(F.lit('"packages/p'), F.col("id").cast("string"), F.lit('"')).alias("g")).agg(F.concat_ws(",", F.collect_list("g")).alias("g"))
    root = many.select(F.lit("r").alias("repo_id"), F.lit("package.json").alias("path"), F.concat(F.lit('{"workspaces":["apps/*","**/lib/",'), "g", F.lit("]}")).alias("content"))
    paths = ["packages/p7/package.json", "packages/p99999/package.json", "packages/p100000/package.json", "packages/p7/x/package.json", "apps/a/package.json", "apps/a/b/package.json", "x/y/lib/package.json", "lib/package.json", "apps/node_modules/package.json", "apps/.x/package.json"]
    files = spark.createDataFrame([("r", p, f'{{"name":"{p}"}}') for p in paths] + [("other", "apps/a/package.json", '{"name":"no"}')], "repo_id string, path string, content string")
    got = {(r.repo_id, r["name"]) for r in packages.workspace_package_names(root.unionByName(files)).collect()}
    assert got == {("r", p) for p in ("packages/p7/package.json", "packages/p99999/package.json", "apps/a/package.json", "x/y/lib/package.json", "lib/package.json", "apps/.x/package.json")}
