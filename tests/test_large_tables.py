"""What keeps narrow, compressible rows from meeting in few tasks, and wide keys from being shuffled."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayline.functions.digest import packed, unpacked
from assayline.operators import evidence, provenance, studies


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_of_commits_are_dealt_out_once_for_distinct_rows_and_join(spark, data):
    import workloads

    workloads.load_all()
    plan = plan_of(workloads.QUERIES["file_trailers"](spark, data))
    assert plan.count("REPARTITION_BY_NUM") == 2


def test_repeated_files_of_a_commit_count_once(spark):
    commits = spark.sql("SELECT 'r' AS repo_id, 1L AS sha, TIMESTAMP '2024-01-01' AS ts, 'Co-Authored-By: Claude <a@b>' AS body")
    files = spark.createDataFrame([("r", 1, "a"), ("r", 1, "a"), ("r", 2, "a")], "repo_id string, sha long, path string")
    assert [(r.path, r.n_commits, r.agents) for r in provenance.file_trailers(commits, files).collect()] == [("a", 1, ["Claude"])]


def test_entrypoints_meet_files_without_distinct_rows(spark):
    manifests = spark.createDataFrame([("p", '{"main":"./a.js","types":"./b.ts","bin":"x","exports":["./c.js","./"]}'), (None, '{"main":"./a.js"}')], "package string, content string")
    files = spark.createDataFrame([("p", "a.js"), ("p", "a.js"), ("p", None), (None, "a.js"), ("q", "b.ts")], "package string, path string")
    found = studies.missing_entrypoints(manifests, files)
    plan = plan_of(found)
    assert "LeftAnti" in plan and "HashAggregate" not in plan and plan.count("REPARTITION_BY_NUM") == 3
    assert sorted((r.package or "", r.field, r.issue) for r in found.collect()) == [
        ("", "main", "missing file a.js"), ("p", "bin", "must be a package-relative path"), ("p", "exports[0]", "missing file c.js"),
        ("p", "exports[1]", "escapes the package root"), ("p", "types", "missing file b.ts"),
    ]


def test_packed_keys_are_as_different_as_their_texts(spark):
    digest = "sha256:" + "0a" * 32
    texts = [digest, digest.upper(), digest + "0", digest[:-1], "sha256:same", "sha256:", "", "\x01", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", packed(F.col("t")).alias("k"))
    got = rows.select("t", F.length("k").alias("n"), F.hex("k").alias("h"), unpacked(F.col("k")).alias("back")).collect()
    assert all(r.back == r.t for r in got) and len({r.h for r in got}) == len(texts)
    assert {r.t: r.n for r in got}[digest] == 33


def test_groups_are_shuffled_by_packed_fingerprints(spark):
    digest = "sha256:" + "ab" * 32
    rows = [(digest, "p", "1"), (digest, "q", "2"), ("other", "p", "1"), ("other", "p", "1"), (None, "p", None)]
    found = evidence.correlate(spark.createDataFrame(rows, "fingerprint string, producer_id string, payload string"), F.col("payload"))
    assert "hashpartitioning(_f" in plan_of(found)
    assert {(r.fingerprint, tuple(r.producer_ids), r.n_payloads, r.disagreement) for r in found.collect()} == {
        (digest, ("p", "q"), 2, True), ("other", ("p",), 2, False), (None, ("p",), 1, None),
    }


def test_evidence_meets_attempts_by_a_digest_of_the_binding(spark, data):
    import workloads

    workloads.load_all()
    plan = plan_of(workloads.QUERIES["audit_release_evidence"](spark, data))
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert any("_b#" in j for j in joins)


def test_results_of_a_subject_are_shuffled_once(spark, data):
    import workloads

    workloads.load_all()
    plan = plan_of(workloads.QUERIES["export_sarif"](spark, data))
    assert plan.count("REPARTITION_BY_NUM") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_a_bill_of_material_is_parsed_in_one_pass(spark, data):
    import workloads

    workloads.load_all()
    plan = plan_of(workloads.QUERIES["export_bom"](spark, data))
    assert "Exchange" not in plan and plan.count("Scan parquet") == 2


def test_fuzzy_groups_without_subject_or_producer_make_no_pairs(spark):
    rows = [("s", None, "p", "a", 1), ("s", "", "q", "b", 2), (None, "r", "p", "a", 3), (None, "r", "q", "b", 4), ("s", None, None, "c", 5), ("s", None, "p", None, 6)]
    found = evidence.fuzzy_duplicates(spark.createDataFrame(rows, "subject_id string, rule string, producer_id string, location string, pos long"))
    assert "Aggregate" not in plan_of(found).split("Join", 1)[1]
    assert {tuple(r) for r in found.collect()} == {("p", "q"), ("q", "p"), ("p", "p")}


def test_records_are_joined_by_packed_digests(spark):
    members = spark.createDataFrame(
        [(1, "a", "sha256:x", 1, False, "none"), (1, "b", "sha256:x", 1, False, "none"), (1, "c", "sha256:y", 1, False, "none"), (1, "d", None, 1, False, "none"), (1, "e", "sha256:z", 1, False, "none")],
        "record_id long, path string, digest string, size long, required boolean, redaction string",
    )
    payloads = spark.createDataFrame([(1, "sha256:y", "p")], "record_id long, digest string, payload string")
    found = evidence.record_integrity(members, payloads)
    assert "_d#" in "".join(line for line in plan_of(found).splitlines() if "Join" in line)
    assert {(r.path, r.error) for r in found.collect()} == {
        ("a", "member digest is duplicated"), ("b", "member digest is duplicated"), ("c", "digest mismatch"), ("e", "payload is missing"),
    }
