"""Decisions: policy checks, exceptions, approvals, authority, constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayline.functions.digest import canonical_json, sha256_tag
from assayline.functions.severity import lookup
from assayline.functions.text import safe_https_url
from assayline.operators.evidence import labels
from assayline.operators.spread import ROWS_PER_RANGE, positions

EXIT_CODES = {"PASS": 0, "BLOCK": 1, "REVIEW": 2, "INCOMPLETE": 3}
_UNAVAILABLE = ["missing", "stale", "unsupported", "error"]


def _first(*cases: tuple[Column, str], default: str) -> Column:
    """The reason of the first condition that holds (NULL conditions do not hold)."""
    return reduce(lambda acc, c: acc.when(c[0], c[1]), cases[1:], F.when(cases[0][0], cases[0][1])).otherwise(default)


def _has(col: Column, pattern: str) -> Column:
    return F.coalesce(col.rlike(pattern), F.lit(False))


# --------------------------------------------------------------------------- policy decision
def check_reason() -> Column:
    """Reason code a check contributes, NULL when it is satisfied."""
    status, required = F.col("status"), F.col("requirement") == "required"
    return (
        F.when((status == "failed") & (F.col("on_failure") == "BLOCK"), "check-failed-block")
        .when(status == "failed", "check-failed-review")
        .when(status.isin(_UNAVAILABLE) & required, F.concat(F.lit("required-check-"), status))
        .when(status.isin(_UNAVAILABLE), "advisory-check-unavailable")
    )


def policy_reasons(checks: DataFrame, evaluations: DataFrame | None = None) -> DataFrame:
    """Rows ``(evaluation_id, check_id, code)``; identity reasons have no check.

    With ``evaluations`` given, one that passes has the reason ``requirements-satisfied``.
    """
    rows = checks.select("evaluation_id", "check_id", check_reason().alias("code")).where(F.col("code").isNotNull())
    if evaluations is not None:
        code = F.when(F.col("subject_match") == "mismatched", "identity-mismatch").when(
            F.col("subject_match") == "unresolved", "identity-unresolved"
        )
        identity = evaluations.select("evaluation_id", F.lit(None).cast("string").alias("check_id"), code.alias("code"))
        passed = policy_decision(checks, evaluations).where("decision = 'PASS'")
        passed = passed.select("evaluation_id", F.lit(None).cast("string").alias("check_id"), F.lit("requirements-satisfied").alias("code"))
        rows = identity.where(F.col("code").isNotNull()).unionByName(rows).unionByName(passed)
    return rows


def policy_decision(checks: DataFrame, evaluations: DataFrame | None = None) -> DataFrame:
    """``evaluation_id, decision, exit_code, n_reasons``: INCOMPLETE > BLOCK > REVIEW > PASS.

    Only booleans and a count are aggregated; the reasons stay rows
    (:func:`policy_reasons`), so an evaluation may have any number of checks.
    """
    code = check_reason()
    flags = checks.select("evaluation_id", code.alias("_c"))
    agg = flags.groupBy("evaluation_id").agg(
        F.coalesce(F.bool_or(F.col("_c").startswith("required-check-")), F.lit(False)).alias("_inc"),
        F.coalesce(F.bool_or(F.col("_c") == "check-failed-block"), F.lit(False)).alias("_block"),
        F.coalesce(F.bool_or(F.col("_c").isin("check-failed-review", "advisory-check-unavailable")), F.lit(False)).alias("_rev"),
        F.count("_c").alias("_n"),
    )
    if evaluations is not None:
        agg = evaluations.select("evaluation_id", "subject_match").join(agg, "evaluation_id", "left").fillna(
            {"_inc": False, "_block": False, "_rev": False, "_n": 0}
        )
        broken = F.col("subject_match").isin("mismatched", "unresolved")
        agg = agg.withColumn("_inc", F.col("_inc") | broken).withColumn("_n", F.col("_n") + broken.cast("int"))
    decision = (
        F.when(F.col("_inc"), "INCOMPLETE").when(F.col("_block"), "BLOCK").when(F.col("_rev"), "REVIEW").otherwise("PASS")
    )
    return agg.select(
        "evaluation_id", decision.alias("decision"), lookup(decision, EXIT_CODES).alias("exit_code"), F.col("_n").alias("n_reasons")
    )


# What a reason says that no check brings.
SATISFIED_DETAIL = "All recorded policy checks are satisfied with current evidence for the exact subject."
SATISFIED_ACTION = "Preserve the evaluation and its evidence bindings."
IDENTITY_ACTION = "Resolve and evaluate the exact immutable subject before making a release decision."


def decision_reasons(checks: DataFrame, evaluations: DataFrame) -> DataFrame:
    """``evaluation_id, position, code, check_id, detail, owner, next_action``: why each evaluation was decided as it was.

    ``checks`` bring ``reason, owner, next_action`` besides what :func:`check_reason` reads, ``evaluations``
    bring ``evaluation_id, subject_match, match_reason``.  An identity reason comes first, then the checks
    by id; an evaluation without any has the one reason that it passes.  Positions count
    from 0 and are exact for an evaluation of any size.
    """
    c, none = F.col, F.lit(None).cast("string")
    own = checks.select(
        "evaluation_id", F.lit(1).alias("_rank"), check_reason().alias("code"), "check_id", c("reason").alias("detail"), "owner", "next_action"
    ).where(c("code").isNotNull())
    code = F.when(c("subject_match") == "mismatched", "identity-mismatch").when(c("subject_match") == "unresolved", "identity-unresolved")
    identity = evaluations.select(
        "evaluation_id", F.lit(0).alias("_rank"), code.alias("code"), none.alias("check_id"), c("match_reason").alias("detail"),
        F.lit("target-owner").alias("owner"), F.lit(IDENTITY_ACTION).alias("next_action"),
    ).where(c("code").isNotNull())
    given = identity.unionByName(own.join(evaluations.select("evaluation_id"), "evaluation_id", "left_semi"))
    passed = evaluations.select("evaluation_id").join(given.select("evaluation_id").distinct(), "evaluation_id", "left_anti").select(
        "evaluation_id", F.lit(2).alias("_rank"), F.lit("requirements-satisfied").alias("code"), none.alias("check_id"),
        F.lit(SATISFIED_DETAIL).alias("detail"), F.lit("policy-owner").alias("owner"), F.lit(SATISFIED_ACTION).alias("next_action"),
    )
    ordered = positions(given.unionByName(passed), ["evaluation_id"], ["_rank", "check_id", "code", "detail"], out="position")
    return ordered.select("evaluation_id", c("position").cast("bigint").alias("position"), "code", "check_id", "detail", "owner", "next_action")


def policy_input_issues(checks: DataFrame) -> DataFrame:
    """``evaluation_id, check_id, issues`` of checks whose status, evidence and freshness disagree.

    Columns besides those of a check: ``evaluated_at, checked_at, source_updated_at,
    valid_until, freshness, n_evidence, n_observations, n_distinct_observations``.
    """
    c = F.col
    status, fresh = c("status"), c("freshness")
    repeats = checks.groupBy("evaluation_id", "check_id").agg(F.count(F.lit(1)).alias("_n"))
    issues = labels(
        (c("_n") > 1, "policy check ids must be unique"),
        ((c("requirement") == "advisory") & (c("on_failure") != "REVIEW"), "advisory checks cannot block"),
        (c("n_observations") != c("n_distinct_observations"), "check repeats observation ids"),
        (status.isin("satisfied", "failed", "stale") & (c("n_evidence") == 0), "status requires evidence"),
        (status.isin("missing", "unsupported") & (c("n_evidence") > 0), "status cannot claim evidence"),
        (status.isin("satisfied", "failed") & (fresh != "current"), "status requires current evidence"),
        ((status == "stale") & (fresh != "stale"), "stale checks require stale freshness"),
        (status.isin("missing", "unsupported", "error") & (fresh != "unknown"), "status requires unknown freshness"),
        (c("checked_at") > c("evaluated_at"), "freshness check occurs after evaluation"),
        (c("source_updated_at") > c("checked_at"), "source update occurs after freshness check"),
        (
            (fresh == "current") & F.coalesce(c("valid_until") <= c("evaluated_at"), F.lit(True)),
            "current evidence requires a future boundary",
        ),
        (
            (fresh == "stale") & F.coalesce(c("valid_until") > c("evaluated_at"), F.lit(True)),
            "stale evidence requires an elapsed boundary",
        ),
        ((fresh == "unknown") & c("valid_until").isNotNull(), "unknown freshness cannot claim a boundary"),
    )
    return (
        checks.join(repeats, ["evaluation_id", "check_id"])
        .select("evaluation_id", "check_id", issues.alias("issues"))
        .where(F.size("issues") > 0)
    )


def uncovered_policy_checks(policies: DataFrame, checks: DataFrame) -> DataFrame:
    """Configured checks without a supplied result."""
    return policies.select("policy_id", "check_id").distinct().join(
        checks.select("policy_id", "check_id").distinct(), ["policy_id", "check_id"], "left_anti"
    )


def dangling_references(references: DataFrame, observations: DataFrame, members: DataFrame) -> DataFrame:
    """References of checks to observations of another subject, or to digests not in the record.

    ``references``: ``evaluation_id, subject_id, check_id, kind, ref`` with kind
    ``observation`` or ``digest``; one left join per kind on a whole key.  Both sides are merged:
    observations often come out of a generator, whose rows the size estimate does not
    count, and a broadcast of them would pass the driver.
    """
    seen = observations.select(F.col("observation_id").alias("ref"), "subject_id").distinct().hint("merge")
    bad_observation = references.where(F.col("kind") == "observation").join(seen, ["ref", "subject_id"], "left_anti")
    digests = members.where(F.col("redaction") != "omitted").select("evaluation_id", F.col("digest").alias("ref")).distinct().hint("merge")
    bad_digest = references.where(F.col("kind") == "digest").join(digests, ["evaluation_id", "ref"], "left_anti")
    cols = ["evaluation_id", "check_id", "kind", "ref"]
    return bad_observation.select(*cols).unionByName(bad_digest.select(*cols))


# The two built-in policies.
POLICY_PROFILES = [
    ("policy-free", "critical-findings", "required", "BLOCK", ["critical"], 0.0, "current", "allow-incomplete", "not-required",
     "not-required", False, False, []),
    ("policy-pro", "high-confidence-findings", "required", "BLOCK", ["critical", "high"], 0.8, "current", "complete", "required",
     "advisory", True, True, ["release-owner"]),
]
POLICY_SCHEMA = (
    "policy_id string, check_id string, requirement string, on_failure string, severities array<string>, "
    "minimum_confidence double, freshness string, coverage string, artifact_match string, attack_check string, "
    "exceptions_enabled boolean, approval_required boolean, authorities array<string>"
)


def policy_profiles(df: DataFrame) -> DataFrame:
    """The built-in policies as rows (``df`` only lends its session).

    Two fixed rows, broadcast: joined by severity, a shuffle would send each severity's findings to one task.
    """
    return F.broadcast(df.sparkSession.createDataFrame(POLICY_PROFILES, POLICY_SCHEMA))


def policy_document_issues(policies: DataFrame) -> DataFrame:
    """``policy_id, check_id, issues`` for policy rows that break a rule."""
    repeats = policies.groupBy("policy_id", "check_id").agg(F.count(F.lit(1)).alias("_n"))
    issues = labels(
        (F.col("_n") > 1, "policy check ids must be unique"),
        ((F.col("requirement") == "advisory") & (F.col("on_failure") != "REVIEW"), "advisory checks cannot block"),
        (F.col("approval_required") & (F.size("authorities") == 0), "required approvals need named authorities"),
        (~F.col("minimum_confidence").between(0.0, 1.0), "minimum confidence is out of range"),
        (~F.size("severities").between(1, 5), "severities are missing"),
    )
    return (
        policies.join(repeats, ["policy_id", "check_id"])
        .select("policy_id", "check_id", issues.alias("issues"))
        .where(F.size("issues") > 0)
    )


# --------------------------------------------------------------------------- exceptions
def exception_reason(subject_id: Column, observation_id: Column, at: Column) -> Column:
    """Why an exception with its approval does or does not apply; the order matters."""
    c = F.col
    return _first(
        (
            ~c("target_exception_id").eqNullSafe(c("exception_id")) | ~c("target_digest").eqNullSafe(c("request_digest")),
            "target-mismatch",
        ),
        (c("decided_at") < c("requested_at"), "decision-before-request"),
        (c("decided_at") >= c("expires_at"), "decision-after-exception-expiry"),
        (c("decision") == "denied", "approval-denied"),
        (c("valid_until") > c("expires_at"), "approval-outlives-exception"),
        (at < c("effective_from"), "not-yet-effective"),
        (at >= c("expires_at"), "expired"),
        (at >= c("valid_until"), "approval-expired"),
        (subject_id != c("scope_subject_id"), "subject-mismatch"),
        (~F.array_contains("scope_observation_ids", observation_id), "observation-out-of-scope"),
        default="applicable",
    )


def applicable_exceptions(requests: DataFrame, exceptions: DataFrame, approvals: DataFrame) -> DataFrame:
    """``request_id, exception_id, applicable, reason``, one row for every use of an exception.

    ``requests``: ``request_id, exception_id, subject_id, observation_id, at``; the request id
    is unique.  Each approval is judged by itself: one that applies is enough, else
    the newest decision (by time, then approval id) gives the reason.
    """
    known = exceptions.withColumn("_exception", F.lit(True))
    decided = approvals.withColumn("_approval", F.lit(True))
    joined = requests.join(known, "exception_id", "left").join(decided, "exception_id", "left")
    reason = (
        F.when(F.col("_exception").isNull(), "exception-missing")
        .when(F.col("_approval").isNull(), "approval-missing")
        .otherwise(exception_reason(F.col("subject_id"), F.col("observation_id"), F.col("at")))
    )
    best = F.max(F.struct((F.col("_r") == "applicable").alias("ok"), "decided_at", "approval_id", F.col("_r").alias("reason")))
    judged = joined.withColumn("_r", reason).groupBy("request_id", "exception_id").agg(best.alias("b"))
    return judged.select("request_id", "exception_id", F.col("b.ok").alias("applicable"), F.col("b.reason").alias("reason"))


def exception_audit(exceptions: DataFrame, approvals: DataFrame) -> DataFrame:
    """Audit rows with a digest of the projected event."""
    j = exceptions.join(approvals, "exception_id")
    event = canonical_json(
        exceptionId=F.col("exception_id"), approvalId=F.col("approval_id"), requestDigest=F.col("request_digest"),
        decision=F.col("decision"), subjectId=F.col("scope_subject_id"),
        observationIds=F.array_sort("scope_observation_ids"),
    )
    return j.select(
        "exception_id", "approval_id", "decision", F.array_sort("scope_observation_ids").alias("observation_ids"),
        sha256_tag(event).alias("event_digest"),
    )


def exception_time_state(now: Column) -> Column:
    """State of an exception's approval window as shown in exports."""
    c = F.col
    return _first(
        (~c("target_digest").eqNullSafe(c("request_digest")), "target-mismatch"),
        (c("decision") == "denied", "denied"),
        (c("decided_at") < c("requested_at"), "decision-before-request"),
        (c("decided_at") >= c("expires_at"), "decision-after-exception-expiry"),
        (c("valid_until") > c("expires_at"), "approval-outlives-exception"),
        (now < c("effective_from"), "not-yet-effective"),
        (now >= c("expires_at"), "expired"),
        (now >= c("valid_until"), "approval-expired"),
        default="within-time-window",
    )


# --------------------------------------------------------------------------- approvals and authority
# Actions, whether they need approval, and what they touch.
ACTIONS = {
    "inspect": (False, "none"), "propose": (False, "none"), "mutate": (True, "filesystem"), "install": (True, "filesystem"),
    "execute": (True, "process"), "network": (True, "network"), "except": (True, "identity"), "sign": (True, "identity"),
    "publish": (True, "hosted"), "upload": (True, "network"), "policy": (True, "identity"), "billing": (True, "hosted"),
}


def request_digest() -> Column:
    """Digest a receipt must carry for its own request fields."""
    return sha256_tag(
        canonical_json(
            requestId=F.col("request_id"), action=F.col("receipt_action"), actor=F.col("actor"), target=F.col("target"),
            files=F.col("files"), policyEffect=F.col("policy_effect"),
        )
    )


def _receipt_shape_ok() -> Column:
    return (F.col("decided_at") >= F.col("requested_at")) & (F.col("decided_at") < F.col("expires_at"))


def authorize_actions(requests: DataFrame, receipts: DataFrame) -> DataFrame:
    """``request_id, allowed, reason`` for requested actions against their receipts.

    ``requests``: ``request_id, action, at``; ``receipts`` carry the approved fields and
    ``request_digest``.  The authority matrix is fixed, so it is an expression.
    """
    known = F.col("action").isin(list(ACTIONS))
    needs = F.col("action").isin([a for a, (need, _) in ACTIONS.items() if need])
    joined = requests.join(receipts.withColumn("_have", F.lit(True)), "request_id", "left")
    at = F.col("at")
    reason = _first(
        (~known, "receipt-invalid"),
        (~needs, "approval-not-required"),
        (F.col("_have").isNull(), "approval-missing"),
        (~F.coalesce(_receipt_shape_ok(), F.lit(False)), "receipt-invalid"),
        (F.col("receipt_action") != F.col("action"), "action-mismatch"),
        (F.col("request_digest") != request_digest(), "receipt-invalid"),
        ((at < F.col("requested_at")) | (at >= F.col("expires_at")) | (at < F.col("decided_at")), "expired"),
        (F.col("decision") != "approved", "denied"),
        default="usable",
    )
    return joined.select(
        "request_id", reason.isin("usable", "approval-not-required").alias("allowed"), reason.alias("reason")
    )


def remediation_allowed(proposals: DataFrame, receipts: DataFrame, at: Column) -> DataFrame:
    """``proposal_id, allowed``: a usable mutate receipt that covers target, effect and every file."""
    j = proposals.select(
        "proposal_id", "request_id", F.col("target").alias("p_target"), F.col("files").alias("p_files"),
        F.col("policy_effect").alias("p_effect"),
    ).join(receipts, "request_id", "left")
    usable = (
        (F.col("decision") == "approved") & (F.col("request_digest") == request_digest())
        & (at >= F.col("requested_at")) & (at < F.col("expires_at")) & (at >= F.col("decided_at"))
    )
    fits = (
        (F.col("receipt_action") == "mutate") & (F.col("target") == F.col("p_target"))
        & (F.col("policy_effect") == F.col("p_effect")) & (F.size("network") == 0)
        & (F.size(F.array_except("p_files", "files")) == 0)
    )
    return j.select("proposal_id", F.coalesce(usable & fits, F.lit(False)).alias("allowed"))


def resolve_org_policy(repos: DataFrame, envelopes: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """``organization_id, repository_id, resolved, reason`` of cached organisation policies.

    ``envelopes``: ``organization_id, repository_id, policy, policy_digest, key_id,
    expires_at``.  Signature mathematics is not part of this; key state is.
    """
    e = envelopes.withColumn("_have", F.lit(True))
    j = repos.select("organization_id", "repository_id").join(e, ["organization_id", "repository_id"], "left").join(
        keys.select("key_id", F.col("status").alias("_key")), "key_id", "left"
    )
    reason = _first(
        (F.col("_have").isNull(), "offline-unavailable"),
        (F.col("policy_digest") != sha256_tag(F.col("policy")), "policy-digest-mismatch"),
        (F.col("_key").isNull(), "unknown-key"),
        (F.col("_key") != "active", "key-not-active"),
        (F.col("expires_at") <= now, "cache-expired"),
        default="resolved",
    )
    return j.select("organization_id", "repository_id", (reason == "resolved").alias("resolved"), reason.alias("reason"))


# --------------------------------------------------------------------------- ordered verdicts
def rollback_reason() -> Column:
    """Reason of a rollback request; ``allowed`` when nothing forbids it."""
    c = F.col
    identity = c("current_kind") == "signing-identity"
    return _first(
        (~F.coalesce(c("approved"), F.lit(False)), "approval-required"),
        (F.coalesce(F.length(c("current_ref")) == 0, F.lit(True)), "current-reference-invalid"),
        (F.coalesce(F.length(c("target_ref")) == 0, F.lit(True)), "target-reference-invalid"),
        (c("current_kind") != c("target_kind"), "kind-invalid"),
        ((c("current_identity") == c("target_identity")) & (c("current_ref") == c("target_ref")), "same-reference"),
        (~F.coalesce(c("preserve_history"), F.lit(False)), "history-invalidation-requested"),
        (F.coalesce(F.length(F.trim(c("reason"))) == 0, F.lit(True)), "target-reference-invalid"),
        (identity & F.coalesce(F.length(c("replacement_ref")) == 0, F.lit(True)), "revocation-requires-replacement"),
        (identity & (c("replacement_ref") == c("current_ref")), "same-reference"),
        (~identity & c("replacement_ref").isNotNull(), "revocation-not-applicable"),
        default="allowed",
    )


def attack_verdict(policy_allowed: Column, supported: Column, environment_error: Column, timed_out: Column, matched: Column) -> Column:
    return (
        F.when(~policy_allowed, "policy-denied").when(~supported, "not-supported").when(environment_error, "environment-error")
        .when(timed_out, "inconclusive").when(matched, "confirmed").when(~matched, "not-reproduced").otherwise("inconclusive")
    )


# --------------------------------------------------------------------------- constraints
_USAGE = [
    ("usage_duration_ms", "limit_timeout_ms"), ("usage_cpu_ms", "limit_cpu_ms"), ("usage_memory_bytes", "limit_memory_bytes"),
    ("usage_disk_bytes", "limit_disk_bytes"), ("usage_processes", "limit_processes"), ("usage_output_bytes", "limit_output_bytes"),
    ("usage_network_requests", "limit_network_requests"),
]


def attempt_issues() -> Column:
    """Cross-field rules of a verification attempt (25 of them)."""
    c = F.col
    ran, idle = c("executed"), ~c("executed")
    zero = reduce(lambda a, b: a & b, [c(u) == 0 for u, _ in _USAGE])
    conclusive = c("verdict").isin("confirmed", "not_reproduced")
    return labels(
        (ran & c("started_at").isNull(), "executed requires started_at"),
        (ran & ~c("approval_status").isin("approved", "not-required"), "executed requires approval"),
        (ran & (c("isolation") == "none"), "executed requires isolation"),
        (ran & ~c("non_root"), "executed requires a non-root identity"),
        (ran & (c("cleanup") == "not-started"), "executed requires a cleanup outcome"),
        (ran & c("isolation").isin("container", "gvisor", "microvm") & c("runtime_digest").isNull(), "isolation requires a runtime digest"),
        (idle & c("started_at").isNotNull(), "idle cannot have started_at"),
        (idle & ~zero, "idle requires zero usage"),
        (idle & c("has_output"), "idle cannot contain output"),
        (idle & (c("cleanup") != "not-started"), "idle requires not-started cleanup"),
        (idle & (c("secret_inputs") != "none"), "idle cannot receive secrets"),
        (conclusive & idle, "verdict requires execution"),
        (conclusive & c("evidence_digest").isNull(), "verdict requires an evidence digest"),
        (c("verdict").isin("not_supported", "policy_denied") & ran, "verdict must not execute"),
        ((c("verdict") == "policy_denied") & ~c("approval_status").isin("denied", "not-requested"), "policy_denied requires a denied approval"),
        ((c("signature_status") != "verified") & ran, "unverified recipes must not execute"),
        ((c("network_mode") == "denied") & (c("usage_network_requests") != 0), "denied network requires zero requests"),
        *[(c(u) > c(limit), f"{u} exceeds {limit}") for u, limit in _USAGE],
        (c("completed_at") < c("started_at"), "completed_at precedes started_at"),
    )


def release_decision_issues() -> Column:
    """Constraints of a decision row with ``subjects`` and ``approvals`` arrays.

    ``subjects``: array of ``(subject_id, role)``; ``approvals``: array of
    ``(approval_id, decided_at, valid_until)``.
    """
    c = F.col
    primary = F.filter("subjects", lambda s: s["role"] == "primary")
    ids = F.transform("subjects", lambda s: s["subject_id"])
    approval_ids = F.transform("approvals", lambda a: a["approval_id"])
    return labels(
        (F.size(primary) != 1, "exactly one primary subject required"),
        (
            (F.size(primary) == 1) & (F.get(primary, F.lit(0))["subject_id"] != c("evaluation_subject_id")),
            "evaluation subject must equal the primary subject",
        ),
        (F.size(F.array_distinct(ids)) != F.size(ids), "subject ids must be unique"),
        (F.size(F.array_distinct(approval_ids)) != F.size(approval_ids), "approval ids must be unique"),
        (c("decision") != c("evaluation_decision"), "decision must equal the evaluation"),
        (~c("policy_digest").eqNullSafe(c("evaluation_policy_digest")), "policy must equal the evaluation's policy"),
        (c("generated_at") < c("evaluated_at"), "decision precedes its evaluation"),
        (F.exists("approvals", lambda a: a["decided_at"] > c("generated_at")), "approval after decision"),
        (F.exists("approvals", lambda a: a["valid_until"] <= c("generated_at")), "approval expired before decision"),
    )


def ai_evidence_issues() -> Column:
    """Claim rules of heuristic, declared and cryptographic change evidence."""
    c = F.col
    basis = c("basis")
    crypto = basis == "cryptographic"
    verified = c("signature_status") == "verified"
    return labels(
        (~basis.isin("heuristic", "declared", "cryptographic"), "basis is not allowed"),
        ((basis == "heuristic") & (c("presentation") != "estimate"), "heuristic evidence is an estimate"),
        ((basis == "heuristic") & (c("classification") == "not-asserted"), "heuristic evidence must classify"),
        ((basis == "heuristic") & ~F.coalesce(c("likelihood").between(0.0, 1.0), F.lit(False)), "likelihood is out of range"),
        ((basis == "declared") & (c("presentation") != "declared-claim"), "declared evidence is a claim"),
        (crypto & (verified != (c("presentation") == "verified-declaration")), "presentation must match the signature status"),
        (crypto & verified & (c("verified_at").isNull() | c("bundle_digest").isNull()), "verified needs time and bundle"),
        (crypto & (c("claim_kind") != "ai-change") & (c("classification") != "not-asserted"), "non-AI claim cannot assert a class"),
        (F.coalesce(c("n_limitations") < 1, F.lit(True)), "limitations required"),
    )


# What may leave in a public projection.
PUBLIC_FIELDS = [
    "organization_id", "workspace_id", "record_digest", "decision", "subject_digest", "coverage_status", "signer_status",
    "limitations",
]
PRIVATE_FIELDS = [
    "source", "paths", "findings", "observations", "issued_by", "signer_identity", "signer_issuer", "signature", "private_key",
    "credentials", "secrets", "tenant_id", "client_id", "policy", "policy_id", "issuer",
]
WITHHELD = "Limitation details withheld from this public projection."
_ID = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$"
_DIGEST = r"^sha256:[a-f0-9]{64}$"


def public_projection(records: DataFrame, actor_organization: Column) -> DataFrame:
    """Allow-listed columns and the reason a record may not be shown.

    Private columns that are present and not NULL are an error of the row; other
    unknown columns are too.  Limitations are replaced by one fixed sentence.
    """
    extra = [c for c in records.columns if c not in PUBLIC_FIELDS and c != "record_id"]
    private = [F.col(c).isNotNull() for c in extra if c in PRIVATE_FIELDS]
    unknown = [F.col(c).isNotNull() for c in extra if c not in PRIVATE_FIELDS]

    def any_of(conds: list[Column]) -> Column:
        return reduce(lambda a, b: a | b, conds, F.lit(False))

    c = F.col
    reason = _first(
        (~_has(c("organization_id"), _ID) | ~_has(c("workspace_id"), _ID) | ~_has(c("record_digest"), _DIGEST), "invalid_projection"),
        (c("organization_id") != actor_organization, "cross_tenant"),
        (any_of(private), "private_field"),
        (any_of(unknown), "unsupported_field"),
        (
            ~c("decision").isin(list(EXIT_CODES)) | ~_has(c("subject_digest"), _DIGEST)
            | ~c("coverage_status").isin("incomplete", "not-established")
            | ~c("signer_status").isin("unsigned", "unknown", "unverified"),
            "invalid_projection",
        ),
        default="ok",
    )
    fixed = F.transform("limitations", lambda _: F.lit(WITHHELD))
    shown = [c(f) if f != "limitations" else fixed.alias("limitations") for f in PUBLIC_FIELDS]
    ok = reason == "ok"
    return records.select("record_id", *[F.when(ok, s).alias(f) for s, f in zip(shown, PUBLIC_FIELDS)], reason.alias("reason"))


def archive_issues(members: DataFrame, max_members: int = 100_000, max_bytes: int = 1_073_741_824) -> DataFrame:
    """``archive_id, code``: the first problem of an archive, NULL when it is safe to unpack.

    ``members``: ``archive_id, pos, path, kind, size, link_target``.  Every member gets
    a code; an archive's code is that of its earliest bad member.  An archive of more than
    ``max_members`` is over the limit whatever its members are: the largest are told by
    their counts and not looked into, so one exchange by archive serves the ordered pass,
    the repeats and the result, and no ordered archive is beyond a bounded number of rows.
    """
    c = F.col
    path = F.regexp_replace("path", r"\\", "/")
    target = F.regexp_replace("link_target", r"\\", "/")
    escape = (
        F.coalesce(F.length(path) == 0, F.lit(True)) | (path == ".") | path.startswith("/") | path.rlike("^[A-Za-z]:/")
        | F.contains(path, F.lit("\x00")) | F.exists(F.split(F.regexp_replace(path, "/$", ""), "/"), lambda s: s.isin("", ".", ".."))
    )
    link = c("kind").isin("symlink", "hardlink")
    # a target leaves the root when some prefix of it climbs above the archive's top folder
    depth = F.size(F.split(path, "/")) - 1

    def step(acc: Column, s: Column) -> Column:
        level = F.when(s == "..", acc["d"] - 1).when(s.isin("", "."), acc["d"]).otherwise(acc["d"] + 1)
        return F.struct(level.alias("d"), F.least(acc["low"], level).alias("low"))

    lowest = F.aggregate(F.split(target, "/"), F.struct(depth.alias("d"), depth.alias("low")), step)["low"]
    link_bad = link & (
        F.coalesce(F.length(target) == 0, F.lit(True)) | target.startswith("/") | target.rlike("^[A-Za-z]:/") | (lowest < 0)
    )
    most = max(max_members, ROWS_PER_RANGE)
    huge = members.groupBy("archive_id").agg(F.count(F.lit(1)).alias("_n")).where(c("_n") > most)
    same = c("archive_id").eqNullSafe(c("_huge"))
    whole = members.join(F.broadcast(huge.select(c("archive_id").alias("_huge"))), same, "left_anti")
    rows = whole.select(
        "archive_id", "pos", path.alias("_p"), "size", escape.alias("_esc"), link_bad.alias("_link"),
        F.sum("size").over(Window.partitionBy("archive_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)).alias("_run"),
    ).withColumn("_first", F.min("pos").over(Window.partitionBy("archive_id", "_p")))
    code = (
        F.when(c("_esc"), "TRAVERSAL").when(c("pos") > c("_first"), "DUPLICATE").when(c("size") < 0, "LIMIT")
        .when(c("_link"), "LINK_ESCAPE")
    )
    per = rows.withColumn("_code", code).groupBy("archive_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.when(c("_run") > max_bytes, c("pos"))).alias("_at"),
        F.min(F.when(c("_code").isNotNull(), F.struct("pos", c("_code").alias("code")))).alias("_bad"),
    )
    judged = per.select(
        "archive_id",
        F.when(c("_n") > max_members, "LIMIT")
        .when(
            c("_at").isNotNull() & (
                c("_bad").isNull() | (c("_at") < c("_bad.pos"))
                # at one member the size is checked before the link
                | ((c("_at") == c("_bad.pos")) & (c("_bad.code") == "LINK_ESCAPE"))
            ),
            "LIMIT",
        )
        .otherwise(c("_bad.code")).alias("code"),
    )
    return judged.unionByName(huge.select("archive_id", F.lit("LIMIT").alias("code")))


# --------------------------------------------------------------------------- hypotheses and proofs
# What a target must show for a rule to be worth a try.
RULE_SIGNALS = {
    "D1-001": ["route", "api", "sink:dynamic-code"],
    "D1-003": ["sink:command-execution", "route"],
    "D1-006": ["sink:file-boundary", "route"],
    "D9-002": ["sink:network-request", "route", "api"],
    "AGENT-001": ["agent-tool"],
    "D1-004": ["sink:xss", "route"],
    "D3-001": ["route", "api"],
    "D1-008": ["sink:dynamic-code", "dependency"],
    "D4-001": ["sink:network-request", "dependency"],
    "D6-001": ["dependency"],
}


def plan_hypotheses(findings: DataFrame, inventory: DataFrame, playbooks: DataFrame, coverage: DataFrame) -> DataFrame:
    """``finding_id, status, reason``: supported, not_attemptable or unsupported.

    The inventory is reduced to the set of signals per repository (a fixed domain of
    nine values) before it meets findings, so a repository with many findings and
    many routes yields one row per finding, never findings times routes.
    """
    kind = F.col("kind")
    signal = (
        F.when(kind == "sink", F.concat(F.lit("sink:"), "name"))
        .when(kind == "tool", "agent-tool").when(kind == "package", "dependency").otherwise(kind)
    )
    present = inventory.select("repo_id", signal.alias("s")).groupBy("repo_id").agg(F.collect_set("s").alias("_have"))
    needed = None
    for rule, signals in RULE_SIGNALS.items():
        value = F.array(*[F.lit(s) for s in signals])
        needed = F.when(F.col("rule") == rule, value) if needed is None else needed.when(F.col("rule") == rule, value)
    books = playbooks.select("rule", F.lit(True).alias("_book")).distinct()
    j = (
        findings.select("finding_id", "repo_id", "rule")
        .join(books, "rule", "left").join(present, "repo_id", "left").join(coverage.select("repo_id", "status"), "repo_id", "left")
        .withColumn("_need", needed)
    )
    status = (
        F.when(F.col("_book").isNull() | F.col("_need").isNull(), "unsupported")
        .when(~F.coalesce(F.col("status") == "complete", F.lit(False)), "not_attemptable")
        .when(~F.coalesce(F.arrays_overlap("_need", "_have"), F.lit(False)), "not_attemptable")
        .otherwise("supported")
    )
    reason = (
        F.when(F.col("_book").isNull() | F.col("_need").isNull(), "no playbook maps the rule")
        .when(~F.coalesce(F.col("status") == "complete", F.lit(False)), "coverage is incomplete")
        .when(~F.coalesce(F.arrays_overlap("_need", "_have"), F.lit(False)), "no matching capability")
        .otherwise("playbook and capability match")
    )
    return j.select("finding_id", "repo_id", "rule", status.alias("status"), reason.alias("reason"))


PROOF_KEYS = [
    "subject_id", "observation_id", "finding_id", "rule", "recipe_digest", "trust_policy_digest", "approval_digest",
    "verdict", "evidence_digest",
]


def audit_proof_binding(proofs: DataFrame, attempts: DataFrame, observations: DataFrame) -> DataFrame:
    """``proof_id, status, matches, reasons``: does exactly one attempt bind the proof?

    Attempts are counted per full key before the join, so a key shared by many
    attempts stays one row.
    """
    usable = attempts.where(
        F.col("executed") & (F.col("signature_status") == "verified") & (F.col("approval_status") == "approved")
    )
    counted = usable.groupBy(*PROOF_KEYS).agg(F.count(F.lit(1)).alias("_m"))
    seen = observations.select(
        "observation_id", F.col("subject_id").alias("_os"), F.col("rule").alias("_or")
    )
    j = proofs.join(counted, PROOF_KEYS, "left").join(seen, "observation_id", "left")
    m = F.coalesce("_m", F.lit(0))
    reasons = labels(
        (F.col("_os").isNull(), "observation is not included"),
        (F.col("_os") != F.col("subject_id"), "observation does not bind the subject"),
        (F.col("_or") != F.col("rule"), "rule does not match the observation"),
        (~F.col("completed"), "proof was not completed"),
        (F.col("negative_control") != "passed", "negative control did not pass"),
        (~F.col("verdict").isin("confirmed", "not_reproduced"), "verdict is not release-grade"),
        (m == 0, "no attempt with the exact binding"),
        (m > 1, "several attempts with the exact binding"),
    )
    return j.select(
        "proof_id", m.cast("bigint").alias("matches"), reasons.alias("reasons"),
        F.when(F.size(reasons) == 0, "auditable").otherwise("not-auditable").alias("status"),
    )


EXECUTION_KEYS = ["record_id", "subject_id", "observation_id", "finding_id", "rule", "recipe_digest", "trust_policy_digest", "approval_digest"]


def _binding(digest: Column) -> Column:
    """``_b``: the whole binding as 32 bytes, NULL if a part of it is, so that exchanges carry no wide keys."""
    parts = {k: F.col(k) for k in [*EXECUTION_KEYS, "verdict"]} | {"outcome_digest": digest}
    parts = {k: p.cast("string") for k, p in parts.items()}
    whole = reduce(lambda a, b: a & b, [p.isNotNull() for p in parts.values()])
    return F.when(whole, F.unhex(F.sha2(canonical_json(**parts), 256))).alias("_b")


def audit_release_evidence(evidence: DataFrame, subjects: DataFrame, observations: DataFrame, attempts: DataFrame) -> DataFrame:
    """``evidence_id, record_id, status, matches, reasons``: does the whole release record bind this proof or retest?

    ``evidence``: ``evidence_id, record_id, kind`` (proof or retest), ``subject_id`` (of a retest: the one after),
    ``before_subject_id, observation_id, finding_id, rule, recipe_digest, trust_policy_digest, approval_digest,
    executes, run_status, verdict, negative_control, outcome_finding_id, outcome_verdict, outcome_digest,
    counter_verdict, counter_digest, retest_status, emitted_attempt_id``.  The record's members:
    ``subjects`` (``record_id, subject_id``), ``observations`` (``record_id, observation_id, subject_id, rule``) and
    ``attempts`` (``record_id, attempt_id``, the binding, ``executed, signature_status, approval_status, verdict,
    evidence_digest``).  Members are joined on the record and their own id; attempts are
    counted per binding first, so neither a large record nor a binding shared by many
    attempts is one row's work.  What a row says by itself is decided before the joins, and a binding is its
    digest, so exchanges carry narrow rows.
    """
    c = F.col
    fits = attempts.where(
        c("executed") & (c("signature_status") == "verified") & (c("approval_status") == "approved")
        & c("trust_policy_digest").isNotNull() & c("approval_digest").isNotNull()
    ).withColumn("verdict", F.when(c("verdict") == "not_reproduced", "not-reproduced").otherwise(c("verdict"))).where(c("verdict").isin("confirmed", "not-reproduced"))
    fits = fits.select(_binding(c("evidence_digest")), c("attempt_id").alias("emitted_attempt_id")).where(c("_b").isNotNull())
    counted = fits.groupBy("_b").agg(F.count(F.lit(1)).alias("_m"))
    emitted = fits.where(c("emitted_attempt_id").isNotNull()).distinct().withColumn("_own", F.lit(True))
    held = attempts.select("record_id", c("attempt_id").alias("emitted_attempt_id")).distinct().withColumn("_held", F.lit(True))
    have = subjects.select("record_id", "subject_id").distinct()
    seen = observations.groupBy("record_id", "observation_id").agg(F.min(F.struct(c("subject_id").alias("_os"), c("rule").alias("_or"))).alias("_o"))
    no = lambda cond: ~F.coalesce(cond, F.lit(False))
    retest, emits = c("kind") == "retest", c("emitted_attempt_id").isNotNull()
    own = {
        "retest subjects are not distinct": retest & c("before_subject_id").eqNullSafe(c("subject_id")),
        "proof was not executed to completion": no(c("executes") & (c("run_status") == "completed")),
        "negative control did not pass": no(c("negative_control") == "passed"),
        "verdict is not release-grade": no(c("verdict").isin("confirmed", "not-reproduced")),
        "outcome does not bind the finding": no(c("outcome_finding_id") == c("finding_id")),
        "outcome does not match the verdict": no(c("outcome_verdict") == c("verdict")),
        "negative-control outcome is missing": no(c("counter_verdict") == "not-reproduced"),
        "evidence digests of both controls are missing": c("outcome_digest").isNull() | c("counter_digest").isNull(),
        "retest is not release-grade": retest & c("retest_status").isin("inconclusive", "not-attemptable"),
        "cleared retest binds another proof": retest & (c("retest_status") == "cleared") & no(c("verdict") == "not-reproduced"),
        "still-reproduced retest binds another proof": retest & (c("retest_status") == "still-reproduced") & no(c("verdict") == "confirmed"),
    }
    bit = {text: i for i, text in enumerate(own)}
    bits = reduce(lambda a, b: a + b, [F.when(cond, 1 << bit[text]).otherwise(0) for text, cond in own.items()])
    narrow = evidence.select(
        "evidence_id", "record_id", "subject_id", "before_subject_id", "observation_id", "rule", "emitted_attempt_id", retest.alias("_retest"), bits.alias("_bits"),
        _binding(c("outcome_digest")),
    )
    j = narrow.join(have.withColumn("_target", F.lit(True)), ["record_id", "subject_id"], "left")
    j = j.join(seen, ["record_id", "observation_id"], "left").select(
        "evidence_id", "record_id", "before_subject_id", "emitted_attempt_id", "_retest", "_bits", "_b", "_target",
        c("_o").isNull().alias("_unseen"), (c("_o._os") != c("subject_id")).alias("_other_subject"), (c("_o._or") != c("rule")).alias("_other_rule"),
    )
    j = j.join(have.select("record_id", c("subject_id").alias("before_subject_id"), F.lit(True).alias("_before")), ["record_id", "before_subject_id"], "left").drop("before_subject_id")
    j = j.join(held, ["record_id", "emitted_attempt_id"], "left").join(counted, "_b", "left").join(emitted, ["_b", "emitted_attempt_id"], "left")
    m = F.coalesce("_m", F.lit(0))
    order = [
        "retest subjects are not distinct",
        ("target subject is not in the record", c("_target").isNull()),
        ("subject before the retest is not in the record", c("_retest") & c("_before").isNull()),
        ("observation is not in the record", c("_unseen")),
        ("observation does not bind the subject", c("_other_subject")),
        ("rule does not match the observation", c("_other_rule")),
        *[text for text in own if text != "retest subjects are not distinct"],
        ("no attempt with the exact binding", m == 0),
        ("several attempts with the exact binding", m > 1),
        ("emitted attempt does not match the binding", emits & c("_own").isNull()),
        ("emitted attempt is not in the record", emits & c("_held").isNull()),
    ]
    reasons = labels(*[(c("_bits").bitwiseAND(F.lit(1 << bit[x])) != 0, x) if isinstance(x, str) else (x[1], x[0]) for x in order])
    return j.select(
        "evidence_id", "record_id", m.cast("bigint").alias("matches"), reasons.alias("reasons"),
        F.when(F.size(reasons) == 0, "auditable").otherwise("not-auditable").alias("status"),
    )


# --------------------------------------------------------------------------- projections
def check_payload(decisions: DataFrame) -> DataFrame:
    """CI check payload per decision: external key, summary and digest, or the reason there is none.

    ``decisions``: ``commit_sha, manifest_digest, record_url, subject_id,
    evaluation_subject_id, decision, policy_id, policy_version, policy_digest``.
    """
    c = F.col
    digest = F.regexp_extract("subject_id", r":(sha256:[a-f0-9]{64})$", 1)
    other = F.regexp_extract("evaluation_subject_id", r":(sha256:[a-f0-9]{64})$", 1)
    reason = _first(
        (~_has(c("commit_sha"), r"^(?:[a-f0-9]{40}|[a-f0-9]{64})$"), "commit_invalid"),
        (~_has(c("manifest_digest"), _DIGEST), "manifest_digest_invalid"),
        (~F.coalesce(safe_https_url(c("record_url")), F.lit(False)), "record_url_invalid"),
        (digest == "", "subject_invalid"),
        ((other == "") | (digest != other), "subject_digest_mismatch"),
        default="ok",
    )
    key = F.substring(
        F.sha2(canonical_json(commit=c("commit_sha"), subjectId=c("subject_id"), manifestDigest=c("manifest_digest")), 256), 1, 32
    )
    summary = F.concat(
        F.lit("Decision "), "decision", F.lit("; subject "), digest, F.lit("; policy "), "policy_id", F.lit("@"), "policy_version", F.lit(".")
    )
    payload = canonical_json(
        externalKey=key, commit=c("commit_sha"), subject=c("subject_id"), decision=c("decision"), policy=c("policy_digest"),
        record=c("record_url"), summary=summary,
    )
    ok = reason == "ok"
    return decisions.select(
        "commit_sha", reason.alias("reason"), F.when(ok, key).alias("external_key"), F.when(ok, summary).alias("summary"),
        F.when(ok, sha256_tag(payload)).alias("payload_digest"),
    )


def release_header(decisions: DataFrame) -> DataFrame:
    """Flat header of a decision row with a ``subjects`` array of ``(subject_id, role, member_digest)``."""
    primary = F.get(F.filter("subjects", lambda s: s["role"] == "primary"), F.lit(0))["subject_id"]
    missing = F.filter("subjects", lambda s: s["member_digest"].isNull())
    texts = F.transform(
        missing, lambda s: F.concat(F.lit("Verified subject payload is unavailable for "), s["subject_id"], F.lit("."))
    )
    incomplete = (F.col("decision") == "INCOMPLETE") | (F.size(missing) > 0)
    return decisions.select(
        "decision_id", "decision", primary.alias("subject_id"), F.size("subjects").alias("n_subjects"),
        F.when(incomplete, "incomplete").otherwise("not-established").alias("coverage_status"),
        F.array_distinct(F.concat(texts, "limitations")).alias("limitations"),
        F.when(F.col("decision") == "PASS", "preserve").otherwise("review").alias("next_action"),
    )


def evidence_projection(observations: DataFrame) -> DataFrame:
    """Columns of an observation that may be shown; excerpts stay behind."""
    return observations.select(
        "observation_id", "subject_id", "origin_kind", "producer_id", "run_id", "rule", "coverage_class", "confidence_level",
        "confidence_score",
    )
