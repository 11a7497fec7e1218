"""Every label that the driver's tables never fire, one row each."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from assayline import schemas
from assayline.operators import evidence, inventory, policy, studies

GOOD = {
    "observation_id": "urn:uuid:00000000-0000-4000-8000-000000000000", "subject_id": "s", "origin_kind": "imported", "producer_id": "p", "run_id": "r",
    "rule": "a.b", "coverage_class": "imported", "category": "c", "title": "t", "location_kind": "source", "path": "src/a.js", "start_line": 3,
    "severity": "high", "confidence_level": "high", "confidence_score": 0.5, "raw_digest": "sha256:x",
}
BAD = [
    ({}, []),
    ({"rule": "r" * 900, "title": "t" * 900}, []),
    ({"observation_id": "urn:uuid:1"}, ["observation_id is malformed"]),
    ({"observation_id": None}, ["observation_id is malformed"]),
    ({"subject_id": ""}, ["subject_id is missing"]),
    ({"origin_kind": "guess"}, ["origin_kind is not allowed"]),
    ({"rule": "has space"}, ["rule is malformed"]),
    ({"raw_digest": None}, ["raw digest required"]),
    ({"coverage_class": "native"}, ["coverage_class must match origin kind"]),
    ({"category": None}, ["category is missing or out of bounds"]),
    ({"title": "a\x00b"}, ["title is missing or out of bounds"]),
    ({"severity": "awful"}, ["severity is not allowed"]),
    ({"confidence_level": None}, ["confidence_level is not allowed"]),
    ({"confidence_score": 1.5}, ["confidence_score is out of range"]),
    ({"path": "../a"}, ["path is unsafe"]),
    ({"start_line": 0}, ["start_line is required"]),
    ({"location_kind": "package"}, ["package is required"]),
]


def test_observation_issues(spark):
    names = [f.name for f in schemas.OBSERVATIONS.fields]
    rows = spark.createDataFrame([tuple((GOOD | change).get(n) for n in names) for change, _ in BAD], schemas.OBSERVATIONS)
    got = [r.issues for r in evidence.validate_rows(rows.coalesce(1)).collect()]
    assert got == [issues for _, issues in BAD]


def test_invalid_evidence_stays_in_its_group(spark):
    from assayline.plans import inspection

    names = [f.name for f in schemas.OBSERVATIONS.fields]
    rows = [GOOD, GOOD | {"confidence_score": 2.0}, GOOD | {"subject_id": "other"}]
    got = inspection.group(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schemas.OBSERVATIONS)).collect()
    assert {(r.subject_id, r.n_payloads, r.n_invalid, r.severity_status, r.severity_value) for r in got} == {("s", 2, 1, "unavailable", None), ("other", 1, 0, "known", "high")}


@pytest.mark.parametrize("confidence, severities, issues", [(1.5, ["high"], ["minimum confidence is out of range"]), (0.5, [], ["severities are missing"])])
def test_policy_document_issues(spark, confidence, severities, issues):
    row = [("p", "k", "required", "BLOCK", severities, confidence, False, ["o"])]
    schema = "policy_id string, check_id string, requirement string, on_failure string, severities array<string>, minimum_confidence double, approval_required boolean, authorities array<string>"
    assert [r.issues for r in policy.policy_document_issues(spark.createDataFrame(row, schema)).collect()] == [issues]


@pytest.mark.parametrize(
    "change, reason",
    [({"current_ref": ""}, "current-reference-invalid"), ({"target_ref": None}, "target-reference-invalid"), ({"reason": "  "}, "target-reference-invalid"), ({}, "allowed")],
)
def test_rollback_reasons(spark, change, reason):
    row = {
        "approved": True, "current_ref": "a", "target_ref": "b", "current_kind": "policy", "target_kind": "policy", "current_identity": "x", "target_identity": "x",
        "preserve_history": True, "reason": "why", "replacement_ref": "",
    } | change
    values = [F.lit(v).cast("boolean" if k in ("approved", "preserve_history") else "string").alias(k) for k, v in row.items()]
    rows = spark.range(1).select(*values).withColumn("replacement_ref", F.nullif("replacement_ref", F.lit("")))
    assert rows.select(policy.rollback_reason()).first()[0] == reason


def test_passing_evaluation_has_a_reason(spark):
    checks = spark.createDataFrame([(1, "k", "required", "BLOCK", "satisfied"), (2, "k", "required", "BLOCK", "failed")], "evaluation_id int, check_id string, requirement string, on_failure string, status string")
    evals = spark.createDataFrame([(1, "matched"), (2, "matched"), (3, "mismatched")], "evaluation_id int, subject_match string")
    got = {(r.evaluation_id, r.code) for r in policy.policy_reasons(checks, evals).collect()}
    assert got == {(1, "requirements-satisfied"), (2, "check-failed-block"), (3, "identity-mismatch")}


def test_inventory_is_incomplete_when_something_cannot_be_read(spark):
    files = spark.createDataFrame([("a", "x.js", "app.get('/a\x01b', h)"), ("b", "x.js", "app.get('/ok', h)"), ("c", "x.js", None)], "repo_id string, path string, content string")
    counts = inventory.surface_counts(files, inventory.surface_inventory(files))
    assert {r.repo_id: r.status for r in counts.collect()} == {"a": "incomplete", "b": "complete", "c": "incomplete"}


def test_plugged_in_signals_count(spark):
    from assayline.plans.project_scan import ProjectScan

    class Files:
        id = "every-file"

        def detect(self, files):
            return files.select("repo_id", "path", F.lit("x").alias("name"), F.lit(1.0).alias("weight"), F.lit(True).alias("fired"), F.lit("").alias("detail"))

    class Repos:
        id = "every-repo"

        def detect(self, files):
            return files.select("repo_id", F.lit(0.2).alias("prior")).distinct()

    files = spark.createDataFrame([("r", "a.js", "x")], "repo_id string, path string, content string")
    commits = spark.createDataFrame([], schemas.COMMITS)
    touched = spark.createDataFrame([], schemas.COMMIT_FILES)
    likelihood = lambda **k: ProjectScan(**k).provenance(files, commits, touched).first().ai_likelihood
    assert (likelihood(), likelihood(repo_signals=[Repos()]), likelihood(file_signals=[Files()])) == (0.0, 0.2, 1.0)


def test_a_share_that_ends_in_a_half_is_rounded_from_exact_lines(spark):
    from assayline.operators import provenance

    files = spark.createDataFrame([("r", "a.ts", 215), ("r", "b.ts", 785)], "repo_id string, path string, n_lines long")
    signals = spark.createDataFrame([("r", "a.ts", provenance.COMMIT_WEIGHT, True)], "repo_id string, path string, weight double, fired boolean")
    prior = spark.createDataFrame([("r", provenance.ARTIFACT_BOOST)], "repo_id string, prior double")
    found = provenance.combine_signals(files, signals, prior)
    findings = spark.createDataFrame([], "repo_id string, file string, severity string")
    # (215 * 0.8 + 785 * 0.1) / 1000 = 25.05 %
    assert provenance.repo_provenance(found, findings).first().ai_authored_percent == 25.1


def test_entry_points_and_manifests(spark):
    files = [
        ("r", "package.json", '{"scripts":{"a":"1","b\\u0001":"2"},"dependencies":{"koa":"1"},"optionalDependencies":{"x":"1"},"peerDependencies":[]}'), ("r", "sub/package.json", '{"scripts":{"no":"1"}}'), ("r", "src/a.TS", ""),
        ("r", "src/a.spec.js", ""), ("r", "tests/data.json", ""), ("r", "vite.config.mjs", ""), ("r", "tsconfig.base.json", ""), ("r", "README.md", ""), ("r", "config.ts", ""), ("q", "package.json", "{oops"), ("n", "package.json", None),
    ]
    df = spark.createDataFrame(files, "repo_id string, path string, content string")
    got = {(r.path, r.kind, r["name"]) for r in inventory.entry_points(df).where("repo_id = 'r'").collect()}
    assert got == {
        ("package.json", "config", None), ("package.json", "script", "a"), ("sub/package.json", "config", None), ("src/a.TS", "source", None), ("src/a.spec.js", "test", None), ("tests/data.json", "test", None),
        ("vite.config.mjs", "config", None), ("tsconfig.base.json", "config", None), ("README.md", "config", None), ("config.ts", "config", None),
    }
    got = {(r.repo_id, r.kind, r["name"], r.detail) for r in inventory.manifest_inventory(df).collect()}
    assert got == {("r", "script", "a", None), ("r", "package", "koa", "dependencies"), ("r", "framework", "koa", "dependencies"), ("r", "package", "x", "optionalDependencies"), ("q", "unreadable", "manifest", None), ("n", "unreadable", "manifest", None)}
    whole = inventory.target_inventory(df)
    assert {r.repo_id: r.status for r in inventory.surface_counts(df, whole).collect()} == {"r": "complete"}


def test_reasons_of_a_decision_in_order(spark):
    checks = spark.createDataFrame([(1, f"c{i:05d}", "required", "BLOCK", "failed", f"w{i}", "o", "a") for i in range(3000)] + [(2, "x", "advisory", "REVIEW", "satisfied", "", "o", "a"), (9, "y", "required", "BLOCK", "failed", "", "o", "a")],
        "evaluation_id int, check_id string, requirement string, on_failure string, status string, reason string, owner string, next_action string")
    evals = spark.createDataFrame([(1, "mismatched", "two subjects"), (2, "matched", None), (3, "matched", None)], "evaluation_id int, subject_match string, match_reason string")
    got = policy.decision_reasons(checks, evals).collect()
    one = sorted((r.position, r.code, r.check_id, r.detail, r.owner) for r in got if r.evaluation_id == 1)
    assert one[0] == (0, "identity-mismatch", None, "two subjects", "target-owner") and one[1:] == [(i + 1, "check-failed-block", f"c{i:05d}", f"w{i}", "o") for i in range(3000)]
    assert {(r.evaluation_id, r.position, r.code, r.owner) for r in got if r.evaluation_id != 1} == {(2, 0, "requirements-satisfied", "policy-owner"), (3, 0, "requirements-satisfied", "policy-owner")}


EVIDENCE = {
    "evidence_id": 1, "record_id": 1, "kind": "retest", "subject_id": "s", "before_subject_id": "b", "observation_id": "o", "finding_id": "f", "rule": "D1", "recipe_digest": "r", "trust_policy_digest": "t", "approval_digest": "a",
    "executes": True, "run_status": "completed", "verdict": "confirmed", "negative_control": "passed", "outcome_finding_id": "f", "outcome_verdict": "confirmed", "outcome_digest": "e", "counter_verdict": "not-reproduced", "counter_digest": "c",
    "retest_status": "still-reproduced", "emitted_attempt_id": "x",
}
FAULTS = [
    ({}, []), ({"kind": "proof", "before_subject_id": None, "retest_status": None}, []), ({"before_subject_id": "s"}, ["retest subjects are not distinct"]), ({"before_subject_id": "zz"}, ["subject before the retest is not in the record"]),
    ({"subject_id": "b2"}, ["observation does not bind the subject", "no attempt with the exact binding", "emitted attempt does not match the binding"]),
    ({"record_id": 2}, ["target subject is not in the record", "subject before the retest is not in the record", "observation is not in the record", "no attempt with the exact binding", "emitted attempt does not match the binding", "emitted attempt is not in the record"]),
    ({"rule": "D2"}, ["rule does not match the observation", "no attempt with the exact binding", "emitted attempt does not match the binding"]), ({"executes": False}, ["proof was not executed to completion"]), ({"run_status": None}, ["proof was not executed to completion"]),
    ({"negative_control": "failed"}, ["negative control did not pass"]), ({"outcome_finding_id": None}, ["outcome does not bind the finding"]), ({"outcome_verdict": None}, ["outcome does not match the verdict"]), ({"counter_verdict": "confirmed"}, ["negative-control outcome is missing"]),
    ({"counter_digest": None}, ["evidence digests of both controls are missing"]), ({"retest_status": "not-attemptable"}, ["retest is not release-grade"]), ({"retest_status": "cleared"}, ["cleared retest binds another proof"]),
    ({"verdict": "not-reproduced", "outcome_verdict": "not-reproduced"}, ["still-reproduced retest binds another proof", "no attempt with the exact binding", "emitted attempt does not match the binding"]),
    ({"verdict": "inconclusive", "retest_status": "inconclusive", "outcome_verdict": "inconclusive"}, ["verdict is not release-grade", "retest is not release-grade", "no attempt with the exact binding", "emitted attempt does not match the binding"]),
    ({"approval_digest": "twice", "emitted_attempt_id": None}, ["several attempts with the exact binding"]), ({"emitted_attempt_id": "y1"}, ["emitted attempt does not match the binding"]), ({"emitted_attempt_id": "gone"}, ["emitted attempt does not match the binding", "emitted attempt is not in the record"]),
    ({"outcome_digest": None}, ["evidence digests of both controls are missing", "no attempt with the exact binding", "emitted attempt does not match the binding"]),
]


def test_every_reason_of_a_release_audit(spark):
    kinds = ", ".join(f"{n} {'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'string'}" for n, v in EVIDENCE.items())
    evidence = spark.createDataFrame([tuple((EVIDENCE | change | {"evidence_id": i}).values()) for i, (change, _) in enumerate(FAULTS)], kinds)
    subjects = spark.createDataFrame([(1, "s"), (1, "b"), (1, "b2"), (1, "s")], "record_id int, subject_id string")
    observations = spark.createDataFrame([(1, "o", "s", "D1")], "record_id int, observation_id string, subject_id string, rule string")
    base = {k: EVIDENCE[k] for k in policy.EXECUTION_KEYS} | {"attempt_id": "x", "executed": True, "signature_status": "verified", "approval_status": "approved", "verdict": "confirmed", "evidence_digest": "e"}
    changes = [{}, {"approval_digest": "twice", "attempt_id": "y1"}, {"approval_digest": "twice", "attempt_id": "y2"}, {"executed": False, "attempt_id": "z"}, {"signature_status": "invalid", "attempt_id": "z2"}, {"trust_policy_digest": None, "attempt_id": "z3"}]
    attempts = spark.createDataFrame([tuple((base | c).values()) for c in changes], ", ".join(f"{n} {'boolean' if n == 'executed' else 'int' if n == 'record_id' else 'string'}" for n in base))
    got = {r.evidence_id: (r.reasons, r.status) for r in policy.audit_release_evidence(evidence, subjects, observations, attempts).collect()}
    assert got == {i: (want, "not-auditable" if want else "auditable") for i, (_, want) in enumerate(FAULTS)}
    assert {w for _, ws in FAULTS for w in ws} >= {"target subject is not in the record", "several attempts with the exact binding"} and len({w for _, ws in FAULTS for w in ws}) == 20


def test_every_issue_of_an_adjudication(spark):
    rows = [("ok", "a", "confirmed", "x"), ("ok", "b", "confirmed", "x"), ("one", "a", "confirmed", "x"), ("open", "a", "confirmed", "x"), ("open", "b", "not-reproduced", "x"), ("early", "a", "confirmed", "x"), ("early", "b", "not-reproduced", "x"),
        ("self", "a", "confirmed", "x"), ("self", "b", "not-reproduced", "x"), ("author", "a", "confirmed", "x"), ("author", "b", "not-reproduced", "x"), ("third", "a", "confirmed", "x"), ("third", "b", "not-reproduced", "x"), ("extra", "a", "confirmed", "x"), ("extra", "b", "confirmed", "x"),
        ("out", "a", "out-of-scope", "x"), ("out", "b", "out-of-scope", None), ("out2", "a", "out-of-scope", "x"), ("out2", "b", "confirmed", None)]
    reviews = spark.createDataFrame([(s, r, l, 5, "high", True, None, why) for s, r, l, why in rows], "sample_id string, reviewer string, label string, reviewed_at int, confidence string, changed_finding boolean, limitation string, exclusion_reason string")
    res = [("early", "confirmed", 5, "third-reviewer", "c", None), ("self", "confirmed", 9, "third-reviewer", "a", None), ("author", "confirmed", 9, "third-reviewer", "me", None), ("third", "confirmed", 9, "third-reviewer", "c", None), ("extra", "confirmed", 9, "documented-consensus", "a", None), ("out2", "out-of-scope", 9, "documented-consensus", "a", None)]
    resolutions = spark.createDataFrame(res, "sample_id string, resolved_label string, resolved_at int, method string, reviewer string, exclusion_reason string")
    names = ["ok", "one", "open", "early", "self", "author", "third", "extra", "out", "out2", "none"]
    samples = spark.createDataFrame([(n, "d1" if n == "ok" else "d2") for n in names], "sample_id string, detector string")
    done = studies.adjudicated_samples(samples, reviews, resolutions, author="me")
    got = {r.sample_id: (r.final_label, r.issues) for r in done.collect()}
    assert got == {
        "ok": ("confirmed", []), "one": ("confirmed", ["wrong number of reviews"]), "open": (None, ["unresolved disagreement"]), "early": ("confirmed", ["resolution before labels were frozen"]), "self": ("confirmed", ["third reviewer is not independent"]),
        "author": ("confirmed", ["third reviewer is not independent"]), "third": ("confirmed", []), "extra": ("confirmed", ["resolution without disagreement"]), "out": ("out-of-scope", ["exclusion without a reason"]), "out2": ("out-of-scope", ["exclusion without a reason"]), "none": (None, ["wrong number of reviews"]),
    }
    report = {(r.scope, r.detector): r for r in studies.adjudication_report(done, 1).collect()}
    assert report["detector", "d1"].valid and not report["study", None].valid and report["study", None].denominator == 9 and report["study", None].high == 19 and report["study", None].changed == 19
