"""Correlation, differences, digests, lineage and records on small fixtures."""

from __future__ import annotations

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from assayline.functions import digest
from assayline.operators import evidence as E
from assayline.operators import policy as P
from assayline.sources import evidence as S
from assayline.sources import sinks


@pytest.mark.parametrize("seed", range(6))
def test_fuzzy_duplicates_against_brute_force(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([4, 12, 60])
    rows = [
        (rng.choice("st"), rng.choice(["r", "q", None]), rng.choice(["a", "b", None]), f"p{rng.randrange(5)}", i) for i in range(n)
    ]
    want = {
        (a[3], b[3]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and a[1] == b[1] and a[2] != b[2]
    }
    df = spark.createDataFrame(rows, "subject_id string, rule string, location string, producer_id string, pos int").repartition(3)
    got = {(r["left"], r["right"]) for r in E.fuzzy_duplicates(df).collect()}
    assert got == want


def test_same_payload_with_other_key_order_agrees(spark):
    rows = [("f1", "a", '{"x":1,"y":2}'), ("f1", "b", '{"y": 2, "x": 1}'), ("f2", "a", '{"x":1}'), ("f2", "b", '{"x":2}')]
    df = spark.createDataFrame(rows, "fingerprint string, producer_id string, payload string")
    got = {r.fingerprint: (r.producer_ids, r.disagreement) for r in E.correlate(df, S.canonical_document(F.col("payload"))).collect()}
    assert got == {"f1": (["a", "b"], False), "f2": (["a", "b"], True)}


def snap(spark, rows):
    return spark.createDataFrame(rows, "fingerprint string, severity_status string, severity_value string")


def test_diff_changes(spark):
    base = snap(spark, [("a", "known", "low"), ("b", "known", "high"), ("c", "known", "high"), ("d", "mixed", None), ("e", "known", "low")])
    head = snap(spark, [("b", "known", "high"), ("c", "known", "low"), ("d", "known", "low"), ("e", "known", "critical"), ("z", "known", "low")])
    got = {r.fingerprint: r.change for r in E.diff_snapshots(base, head).collect()}
    assert got == {"a": "fixed", "b": "unchanged", "c": "improved", "d": "severity-unassessed", "e": "worsened", "z": "added"}


def test_tree_digest_ignores_order_and_duplicates_but_not_content(spark):
    def one(rows):
        df = spark.createDataFrame([("k", r) for r in rows], "k string, m string")
        return digest.tree_digest(df.repartition(5), ["k"], F.col("m")).collect()[0].digest

    base = one(["a", "b", "c"])
    assert one(["c", "a", "b", "a"]) == base
    assert one(["a", "b"]) != base


def test_missing_endpoint_is_unavailable_with_one_gap(spark):
    subjects = spark.createDataFrame([("u",)], "subject_id string")
    decl = spark.createDataFrame(
        [("u", "v", "built-from", None, None)] * 2, "from_subject_id string, to_subject_id string, relation string, status string, evidence_ref string"
    )
    edges = E.resolve_lineage(subjects, decl)
    assert [r.status for r in edges.collect()] == ["unavailable"]
    assert E.lineage_gaps(edges).count() == 1


def test_policy_truth_table(spark):
    table = [
        ("satisfied", "required", "BLOCK", "PASS", 0), ("failed", "required", "BLOCK", "BLOCK", 1), ("failed", "advisory", "REVIEW", "REVIEW", 2),
        ("missing", "required", "BLOCK", "INCOMPLETE", 3), ("stale", "advisory", "REVIEW", "REVIEW", 2), ("error", "required", "REVIEW", "INCOMPLETE", 3),
    ]
    rows = [(f"e{i}", "k", req, fail, status) for i, (status, req, fail, _, _) in enumerate(table)]
    df = spark.createDataFrame(rows, "evaluation_id string, check_id string, requirement string, on_failure string, status string")
    got = {r.evaluation_id: (r.decision, r.exit_code) for r in P.policy_decision(df).collect()}
    assert got == {f"e{i}": (d, c) for i, (*_, d, c) in enumerate(table)}


def test_truncate_utf8_matches_the_byte_rule(spark):
    from assayline.functions.text import truncate_utf8

    texts = ["abc", "aé", "aéé", "日本語", "a😀b", "😀😀", "", "éa"]
    for n in range(1, 9):
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        for row in df.select("t", truncate_utf8(F.col("t"), n).alias("x")).collect():
            raw = row.t.encode()
            if len(raw) <= n:
                assert (row.x.value, row.x.truncated) == (row.t, False)
                continue
            clipped = raw[:n].decode("utf-8", errors="replace")
            while len(clipped.encode()) > n:
                clipped = clipped[:-1]
            assert (row.x.value, row.x.truncated) == (clipped, True), (row.t, n)


def test_sarif_chunks_hold_all_results(spark):
    rows = [("s", "r", None, f"m{i}", "a.ts", i + 1) for i in range(95)]
    df = spark.createDataFrame(rows, "subject_id string, rule string, level string, message string, uri string, line int")
    docs = sinks.export_sarif(df, 20).collect()
    assert len(docs) > 1
    assert sum(d.document.count('"ruleId"') for d in docs) == 95


def test_archive_escapes(spark):
    rows = [
        ("ok", 1, "a/b", "file", 1, None), ("ok", 2, "a/l", "symlink", 1, "../b"), ("up", 1, "a/l", "symlink", 1, "x/../../../b"),
        ("dot", 1, "a/../b", "file", 1, None), ("dup", 1, "a", "file", 1, None), ("dup", 2, "a", "file", 1, None),
        ("big", 1, "a", "file", 60, None), ("big", 2, "b", "file", 60, None), ("back", 1, "a/l", "symlink", 1, "../../a/b"),
    ]
    df = spark.createDataFrame(rows, "archive_id string, pos int, path string, kind string, size bigint, link_target string")
    got = {r.archive_id: r.code for r in P.archive_issues(df, max_bytes=100).collect()}
    assert got == {"ok": None, "up": "LINK_ESCAPE", "dot": "TRAVERSAL", "dup": "DUPLICATE", "big": "LIMIT", "back": "LINK_ESCAPE"}


def test_every_use_of_an_exception_is_answered(spark):
    from assayline.operators import policy

    t = lambda d: F.to_timestamp(F.lit(d))
    requests = spark.createDataFrame([(1, "e1"), (2, "none"), (3, "bare"), (4, "two"), (5, "denied-last")], "request_id int, exception_id string")
    requests = requests.select("*", F.lit("s").alias("subject_id"), F.lit("o").alias("observation_id"), t("2024-01-10").alias("at"))
    exceptions = spark.createDataFrame([(e, "s", ["o"], "d") for e in ("e1", "bare", "two", "denied-last")], "exception_id string, scope_subject_id string, scope_observation_ids array<string>, request_digest string")
    exceptions = exceptions.select("*", t("2024-01-01").alias("requested_at"), t("2024-01-02").alias("effective_from"), t("2024-02-01").alias("expires_at"))
    approvals = spark.createDataFrame(
        [("e1", "a", "approved", "2024-01-02"), ("two", "a", "approved", "2024-01-02"), ("two", "b", "denied", "2024-01-03"),
         ("denied-last", "a", "approved", "2023-01-02"), ("denied-last", "b", "denied", "2024-01-03")],
        "exception_id string, approval_id string, decision string, decided_at string",
    ).select("*", F.col("exception_id").alias("target_exception_id"), F.lit("d").alias("target_digest"), t("2024-01-20").alias("valid_until"))
    approvals = approvals.withColumn("decided_at", F.to_timestamp("decided_at"))
    got = {r.request_id: (r.applicable, r.reason) for r in policy.applicable_exceptions(requests, exceptions, approvals).collect()}
    assert got == {1: (True, "applicable"), 2: (False, "exception-missing"), 3: (False, "approval-missing"), 4: (True, "applicable"), 5: (False, "approval-denied")}


def test_subject_without_baseline_is_all_new(spark):
    from assayline.operators import evidence

    current = spark.createDataFrame([("s", "p", "f1"), ("s", "p", "f2"), ("t", "p", "f1")], "subject_id string, policy_digest string, fingerprint string")
    base = spark.createDataFrame([("s", "s", "p", None, "f1"), ("s", "s", "p", "2020-01-01", "f2")], "subject_id string, baseline_subject_id string, policy_digest string, expires_at string, accepted string")
    got = {(r.subject_id, r.fingerprint): (r.baseline_status, r.verdict) for r in evidence.compare_baseline(current, base.withColumn("expires_at", F.to_timestamp("expires_at")), F.to_timestamp(F.lit("2024-01-01"))).collect()}
    assert got == {("s", "f1"): ("matched", "accepted"), ("s", "f2"): ("matched", "new"), ("t", "f1"): ("unavailable", "new")}


def walk_of(value, depth=0):
    """nodes, depth, properties, items by recursion."""
    members = list(value.values()) if isinstance(value, dict) else value if isinstance(value, list) else []
    below = [walk_of(v, depth + 1) for v in members]
    return (1 + sum(b[0] for b in below), max([depth, *(b[1] for b in below)]), (len(members) if isinstance(value, dict) else 0) + sum(b[2] for b in below), (len(members) if isinstance(value, list) else 0) + sum(b[3] for b in below))


def random_json(rng, depth):
    kind = rng.randrange(8) if depth else rng.randrange(4)
    if kind > 5:
        return [random_json(rng, depth - 1) for _ in range(rng.randrange(4))]
    if kind > 3:
        return {rng.choice(["a", "b:,{", 'q"]', "\\", "7", "é", "x\n"]) + str(i): random_json(rng, depth - 1) for i in range(rng.randrange(4))}
    return [None, True, -1.5e3, 'a "quoted", {text}: [\\]'][kind]


def test_json_structure_in_columns(spark):
    rng = random.Random(12)
    values = [random_json(rng, rng.randrange(6)) for _ in range(400)] + [[], {}, [[]], [{}], {"a": []}, "[[[", 3]
    texts = [json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2])) for v in values]
    texts += ['"' + "x" * 200_000 + '"', "[" + ",".join(['"\\\\\\""'] * 20_000) + "]"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, raw string")
    got = {r.doc_id: r.s for r in docs.select("doc_id", S.json_structure(F.col("raw")).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i])[1:] == walk_of(json.loads(t)) and got[i].valid, t[:100]


def test_json_bounds_agree_with_a_walk(spark):
    rng = random.Random(13)
    texts = [json.dumps(random_json(rng, 6)) for _ in range(300)] + [None, "", "{", "[1,]", "NaN", '{"a":1,"a":[1,2,3,4]}', "[" * 1500 + "]" * 1500, '["\u0001"]', " [1] ", "1 2", '{"a": Infinity}', "x" * 500]
    docs, seen = spark.createDataFrame(list(enumerate(texts)), "doc_id int, raw string"), set()
    for limits in ({}, {"max_depth": 2}, {"max_nodes": 6, "max_items": 3}, {"max_properties": 2, "max_items": 2, "max_depth": 3, "max_bytes": 400}):
        lim = {**S.JSON_LIMITS, **limits}
        got = {r.doc_id: r.bounds_code for r in S.json_bounds(docs, **limits).collect()}
        want = {i: "TOO_LARGE" if t is not None and len(t.encode()) > lim["max_bytes"] else S._structure_code(t, lim) for i, t in enumerate(texts)}
        assert got == want
        seen |= {*want.values()}
    assert seen >= {"OK", "TOO_LARGE", "INVALID_JSON", "TOO_DEEP", "TOO_MANY_ITEMS", "TOO_MANY_PROPERTIES"}


def test_plain_documents_do_not_reach_python(spark):
    docs = spark.createDataFrame([(1, '{"a":[1,2]}')], "doc_id int, raw string")
    judged = S.json_bounds(docs)
    assert [r.bounds_code for r in judged.collect()] == ["OK"]
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Union", 1)
    assert "Python" not in above and below.count("ArrowEvalPython") == 1 and "isnull" in below.split("ArrowEvalPython", 1)[1]


def test_archives_are_judged_in_one_exchange_by_archive(spark):
    rows = [
        # the size is passed before a bad link, though a negative size brings the total back
        ("a", 1, "x", "file", 200, None), ("a", 2, "l", "symlink", 0, "../../t"), ("a", 3, "y", "file", -150, None),
        # a member without a path is a member
        ("b", 1, "x", "file", 1, None), ("b", 2, None, "file", 1, None),
        ("c", 1, "x", "file", 1, None), ("c", 2, "y", "file", 1, None), ("c", 3, "x", "file", 1, None), ("c", 4, "x", "file", 1, None),
        ("d", 1, "x", "file", 1, None),
        *[("e", i, f"p{i}", "file", 1, None) for i in range(6)],
    ]
    df = spark.createDataFrame(rows, "archive_id string, pos int, path string, kind string, size long, link_target string")
    found = P.archive_issues(df.repartition(4), 5, 120)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # the counts of the largest, and the members
    assert plan.count("Exchange hashpartitioning(archive_id") <= 3 and "SortMergeJoin" not in plan
    assert {r.archive_id: r.code for r in found.collect()} == {"a": "LIMIT", "b": "TRAVERSAL", "c": "DUPLICATE", "d": None, "e": "LIMIT"}


def test_archives_beyond_the_ordered_size_are_over_the_limit(spark, monkeypatch):
    monkeypatch.setattr(P, "ROWS_PER_RANGE", 10)
    df = spark.range(40).selectExpr("CASE WHEN id < 30 THEN 'big' ELSE 'small' END AS archive_id", "id AS pos", "concat('p', id) AS path", "'file' AS kind", "1L AS size", "CAST(NULL AS string) AS link_target")
    assert {r.archive_id: r.code for r in P.archive_issues(df, 10, 100).collect()} == {"big": "LIMIT", "small": None}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_digest_tree_moves_its_members_once(spark):
    df = spark.range(300).selectExpr("id % 3 AS k", "concat('m', id % 90) AS m")
    tree = digest.tree_digest(df, ["k"], F.col("m"), sums={"n": F.lit(1).cast("bigint")})
    assert _plan(tree).count("Exchange ") == 2
    assert {r.k: r.n for r in tree.collect()} == {0: 100, 1: 100, 2: 100}


def test_facts_of_baselines_are_joined_without_moving_fingerprints_by_subject(spark):
    current = spark.range(50).selectExpr("concat('s', id % 2) AS subject_id", "'p' AS policy_digest", "concat('f', id) AS fingerprint")
    base = spark.range(60).selectExpr(
        "concat('s', id % 2) AS subject_id", "'s0' AS baseline_subject_id", "'p' AS policy_digest", "CAST(NULL AS timestamp) AS expires_at", "concat('f', id * 2) AS accepted"
    )
    found = E.compare_baseline(current, base, F.lit("2024-01-01").cast("timestamp"))
    # the facts' size is known when the join is planned
    assert "FileScan parquet [subject_id" in _plan(found)
    assert {(r.baseline_status, r.verdict) for r in found.collect()} == {("matched", "accepted"), ("matched", "new"), ("mismatched", "new")}


def test_observations_are_judged_without_a_list_of_issues(spark):
    docs = spark.createDataFrame(
        [(1, "s", '{"version":"2.1.0","runs":[{"results":[' + ",".join(
            '{"ruleId":"r%d","locations":[{"physicalLocation":{"artifactLocation":{"uri":"%s"},"region":{"startLine":1}}}]}' % (i, u)
            for i, u in enumerate(["a%20b", "a+b", "x%2", "%zz", "100%", "%C3%A9", "plain", "%2e%2e/x"])
        ) + "]}]}")], "doc_id int, subject_id string, raw string",
    )
    found = S.import_sarif(docs)
    assert sorted(r.path for r in found.collect()) == ["a b", "a+b", "plain", "é"]
    # what a generator's argument computes is interpreted, so it is a column
    generators = [line for line in _plan(found).split("\n") if "Generate inline(" in line]
    assert generators and all("Generate inline(array(_computed" in g for g in generators)
    odd = found.unionByName(found.withColumns({"severity": F.lit(None).cast("string"), "path": F.lit("../x")})).unionByName(found.withColumn("confidence_score", F.lit(2.0)))
    same = E.validate_rows(odd).select(((F.size("issues") == 0) == E.observation_is_valid()).alias("same"), E.observation_is_valid().alias("ok")).collect()
    assert all(r.same for r in same) and {r.ok for r in same} == {True, False}
