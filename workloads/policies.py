"""Policy, exception, approval and constraint queries over ``orders`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.functions.digest import sha256_tag
from assayline.operators import inventory
from assayline.operators import policy as P
from workloads import query
from workloads.bindings import code_files, pick, quote, sql_list, sql_pick, table

_STATUS = ["satisfied", "failed", "missing", "stale", "unsupported", "error", "satisfied", "satisfied", "satisfied"]
_FRESH = ["current", "stale", "unknown"]
_CHECK = {
    "evaluation_id": "o_custkey", "check_id": "concat('k', o_orderkey)",
    "requirement": "CASE WHEN o_orderpriority < '3' THEN 'required' ELSE 'advisory' END",
    "on_failure": "CASE WHEN o_orderpriority < '2' THEN 'BLOCK' ELSE 'REVIEW' END",
}


def policy_checks(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        *[F.expr(e).alias(n) for n, e in _CHECK.items()],
        pick(_STATUS, F.pmod("o_orderkey", F.lit(len(_STATUS)))).alias("status"),
        "o_orderkey", "o_orderdate",
    )


_CHECKS_CTE = "checks AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _CHECK.items()) + f", {sql_pick(_STATUS, f'o_orderkey % {len(_STATUS)}')} AS status, o_orderkey, o_orderdate FROM orders)"
_CODE = (
    "CASE WHEN status = 'failed' AND on_failure = 'BLOCK' THEN 'check-failed-block' WHEN status = 'failed' THEN 'check-failed-review' WHEN status <> 'satisfied' AND "
    "requirement = 'required' THEN 'required-check-' || status WHEN status <> 'satisfied' THEN 'advisory-check-unavailable' END"
)
_MATCH = ["matched", "matched", "mismatched", "unresolved", "matched"]


def _evaluations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("evaluation_id"), pick(_MATCH, F.pmod("c_nationkey", F.lit(5))).alias("subject_match")
    )


_EVAL_CTE = f"evals AS (SELECT c_custkey AS evaluation_id, {sql_pick(_MATCH, 'c_nationkey % 5')} AS m FROM customer)"


@query(
    "policy_decision",
    f"""WITH {_CHECKS_CTE}, {_EVAL_CTE}, r AS (SELECT evaluation_id, {_CODE} AS code FROM checks UNION ALL SELECT evaluation_id, CASE m WHEN 'mismatched' THEN
'identity-mismatch' WHEN 'unresolved' THEN 'identity-unresolved' END FROM evals), a AS (SELECT evaluation_id, count(code) AS n, coalesce(bool_or(code LIKE 'required-check-%' OR code LIKE 'identity-%'), false) AS i,
coalesce(bool_or(code = 'check-failed-block'), false) AS b, coalesce(bool_or(code IN ('check-failed-review', 'advisory-check-unavailable')), false) AS v FROM r GROUP BY 1)
SELECT evaluation_id, CASE WHEN i THEN 'INCOMPLETE' WHEN b THEN 'BLOCK' WHEN v THEN 'REVIEW' ELSE 'PASS' END AS decision, CASE WHEN i THEN 3 WHEN b THEN 1 WHEN v THEN 2 ELSE 0 END::INT AS exit_code,
n::BIGINT AS n_reasons FROM a""",
)
def policy_decision(spark: SparkSession, sf: str) -> DataFrame:
    return P.policy_decision(policy_checks(spark, sf), _evaluations(spark, sf))


@query(
    "policy_reasons",
    f"WITH {_CHECKS_CTE}, {_EVAL_CTE} SELECT evaluation_id, check_id, code FROM (SELECT evaluation_id, check_id, {_CODE} AS code FROM checks UNION ALL SELECT evaluation_id, NULL, CASE m WHEN "
    "'mismatched' THEN 'identity-mismatch' WHEN 'unresolved' THEN 'identity-unresolved' END FROM evals UNION ALL SELECT evaluation_id, NULL, 'requirements-satisfied' FROM evals WHERE m = 'matched' AND "
    f"evaluation_id NOT IN (SELECT evaluation_id FROM checks WHERE {_CODE} IS NOT NULL)) WHERE code IS NOT NULL",
)
def policy_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return P.policy_reasons(policy_checks(spark, sf), _evaluations(spark, sf))


@query(
    "decision_reasons",
    f"""WITH {_CHECKS_CTE}, {_EVAL_CTE}, r AS (SELECT evaluation_id, 1 AS rank, {_CODE} AS code, check_id, 'why ' || o_orderkey AS detail, 'team ' || (o_orderkey % 5) AS owner, 'do ' || (o_orderkey % 3) AS next_action FROM checks
UNION ALL SELECT evaluation_id, 0, CASE m WHEN 'mismatched' THEN 'identity-mismatch' WHEN 'unresolved' THEN 'identity-unresolved' END, NULL, 'subject ' || evaluation_id, 'target-owner', {quote(P.IDENTITY_ACTION)} FROM evals),
g AS (SELECT * FROM r WHERE code IS NOT NULL), a AS (SELECT * FROM g UNION ALL SELECT evaluation_id, 2, 'requirements-satisfied', NULL, {quote(P.SATISFIED_DETAIL)}, 'policy-owner', {quote(P.SATISFIED_ACTION)} FROM evals
WHERE evaluation_id NOT IN (SELECT evaluation_id FROM g)) SELECT evaluation_id, (row_number() OVER (PARTITION BY evaluation_id ORDER BY rank, check_id) - 1)::BIGINT AS position, code, check_id, detail, owner, next_action FROM a""",
)
def decision_reasons(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    tag = lambda text, v: F.concat(F.lit(text), v.cast("string"))
    checks = policy_checks(spark, sf).withColumns({"reason": tag("why ", k), "owner": tag("team ", k % 5), "next_action": tag("do ", k % 3)})
    return P.decision_reasons(checks, _evaluations(spark, sf).withColumn("match_reason", tag("subject ", F.col("evaluation_id"))))


_PI_SQL = f"""WITH {_CHECKS_CTE}, t AS (SELECT evaluation_id, check_id, requirement, on_failure, status, {sql_pick(_FRESH, 'o_orderkey % 3')} AS fresh, o_orderkey % 2 AS ne, o_orderkey % 4 AS no,
 least(o_orderkey % 4, 2) AS nd, o_orderdate AS ev, CASE WHEN o_orderkey % 8 = 1 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS ca, CASE WHEN o_orderkey % 5 = 1 THEN o_orderdate + INTERVAL 2 DAY END AS su,
 CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN o_orderdate - INTERVAL 1 DAY ELSE o_orderdate + INTERVAL 1 DAY END AS vu FROM checks),
l AS (SELECT evaluation_id, check_id, list_filter([
 CASE WHEN requirement = 'advisory' AND on_failure <> 'REVIEW' THEN 'advisory checks cannot block' END,
 CASE WHEN no <> nd THEN 'check repeats observation ids' END,
 CASE WHEN status IN ('satisfied', 'failed', 'stale') AND ne = 0 THEN 'status requires evidence' END,
 CASE WHEN status IN ('missing', 'unsupported') AND ne > 0 THEN 'status cannot claim evidence' END,
 CASE WHEN status IN ('satisfied', 'failed') AND fresh <> 'current' THEN 'status requires current evidence' END,
 CASE WHEN status = 'stale' AND fresh <> 'stale' THEN 'stale checks require stale freshness' END,
 CASE WHEN status IN ('missing', 'unsupported', 'error') AND fresh <> 'unknown' THEN 'status requires unknown freshness' END,
 CASE WHEN ca > ev THEN 'freshness check occurs after evaluation' END,
 CASE WHEN su > ca THEN 'source update occurs after freshness check' END,
 CASE WHEN fresh = 'current' AND coalesce(vu <= ev, true) THEN 'current evidence requires a future boundary' END,
 CASE WHEN fresh = 'stale' AND coalesce(vu > ev, true) THEN 'stale evidence requires an elapsed boundary' END,
 CASE WHEN fresh = 'unknown' AND vu IS NOT NULL THEN 'unknown freshness cannot claim a boundary' END], lambda x: x IS NOT NULL) AS issues FROM t)
SELECT * FROM l WHERE len(issues) > 0"""


@query("policy_input_issues", _PI_SQL)
def policy_input_issues(spark: SparkSession, sf: str) -> DataFrame:
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    day = F.expr("INTERVAL 1 DAY")
    checks = policy_checks(spark, sf).select(
        "evaluation_id", "check_id", "requirement", "on_failure", "status", pick(_FRESH, k % 3).alias("freshness"),
        (k % 2).alias("n_evidence"), (k % 4).alias("n_observations"), F.least(k % 4, F.lit(2)).alias("n_distinct_observations"),
        d.alias("evaluated_at"), F.when(k % 8 == 1, d + day).otherwise(d).alias("checked_at"),
        F.when(k % 5 == 1, d + day + day).alias("source_updated_at"),
        F.when(k % 7 == 1, d - day).when(k % 7 > 1, d + day).alias("valid_until"),
    )
    return P.policy_input_issues(checks)


@query(
    "uncovered_policy_checks",
    "SELECT DISTINCT c_nationkey AS policy_id, 'k' || (c_custkey % 40) AS check_id FROM customer EXCEPT SELECT c_nationkey, CASE WHEN o_orderstatus = 'P' THEN 'k' ELSE 'other' END || (o_orderkey % 40) FROM orders JOIN customer ON "
    "o_custkey = c_custkey",
)
def uncovered_policy_checks(spark: SparkSession, sf: str) -> DataFrame:
    cust = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    policies = cust.select(
        F.col("c_nationkey").alias("policy_id"), F.concat(F.lit("k"), (F.col("c_custkey") % 40).cast("string")).alias("check_id")
    )
    got = table(spark, sf, "orders").join(cust, F.col("o_custkey") == F.col("c_custkey"))
    checks = got.select(
        F.col("c_nationkey").alias("policy_id"),
        F.concat(F.when(F.col("o_orderstatus") == "P", "k").otherwise("other"), (F.col("o_orderkey") % 40).cast("string")).alias("check_id"),
    )
    return P.uncovered_policy_checks(policies, checks)


@query(
    "dangling_references",
    "WITH r AS (SELECT l_suppkey AS evaluation_id, l_orderkey % 100 AS subject_id, l_linenumber AS check_id, CASE WHEN l_linestatus = 'O' THEN 'observation' ELSE 'digest' END AS kind, 'r' || "
    "l_partkey AS ref FROM lineitem), o AS (SELECT DISTINCT 'r' || p_partkey AS ref, s AS subject_id FROM part, (SELECT unnest(range(0, 100)) AS s) WHERE p_size % 4 = s % 4), m AS (SELECT DISTINCT "
    "l_suppkey AS e, 'r' || CASE WHEN l_orderkey % 3 = 0 THEN 'x' ELSE '' END || l_partkey AS ref FROM lineitem WHERE l_tax > 0.02) SELECT evaluation_id, check_id, kind, ref FROM r WHERE (kind = "
    "'observation' AND NOT EXISTS (SELECT 1 FROM o WHERE o.ref = r.ref AND o.subject_id = r.subject_id)) OR (kind = 'digest' AND NOT EXISTS (SELECT 1 FROM m WHERE m.ref = r.ref AND m.e = "
    "r.evaluation_id))",
)
def dangling_references(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    ref = F.concat(F.lit("r"), F.col("l_partkey").cast("string"))
    references = li.select(
        F.col("l_suppkey").alias("evaluation_id"), (F.col("l_orderkey") % 100).alias("subject_id"), F.col("l_linenumber").alias("check_id"),
        F.when(F.col("l_linestatus") == "O", "observation").otherwise("digest").alias("kind"), ref.alias("ref"),
    )
    part = table(spark, sf, "part")
    name = F.concat(F.lit("r"), F.col("p_partkey").cast("string"))
    observations = part.select(
        name.alias("observation_id"), F.explode(F.sequence(F.pmod("p_size", F.lit(4)).cast("bigint"), F.lit(99).cast("bigint"), F.lit(4).cast("bigint"))).alias("subject_id")
    )
    members = li.select(
        F.col("l_suppkey").alias("evaluation_id"),
        F.concat(F.lit("r"), F.when(F.col("l_orderkey") % 3 == 0, "x").otherwise(""), F.col("l_partkey").cast("string")).alias("digest"),
        F.when(F.col("l_tax") > 0.02, "none").otherwise("omitted").alias("redaction"),
    )
    return P.dangling_references(references, observations, members)


@query(
    "policy_profiles",
    "WITH p AS (SELECT 'policy-free' AS policy_id, 'critical-findings' AS check_id, ['critical'] AS severities, 0.0::DOUBLE AS minimum_confidence UNION ALL SELECT 'policy-pro', "
    "'high-confidence-findings', ['critical', 'high'], 0.8) SELECT policy_id, check_id, minimum_confidence, count(*)::BIGINT AS covered FROM p JOIN (SELECT CASE WHEN l_quantity > 47 THEN 'critical' "
    "WHEN l_quantity > 38 THEN 'high' ELSE 'low' END AS s, l_discount * 10 AS c FROM lineitem) ON list_contains(severities, s) AND c >= minimum_confidence GROUP BY ALL",
)
def policy_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Findings each built-in policy looks at (severity and confidence of its check)."""
    sev = F.when(F.col("l_quantity") > 47, "critical").when(F.col("l_quantity") > 38, "high").otherwise("low")
    li = table(spark, sf, "lineitem").select(sev.alias("s"), (F.col("l_discount") * 10).alias("c"))
    profiles = P.policy_profiles(li).select("policy_id", "check_id", "minimum_confidence", F.explode("severities").alias("s"))
    return (
        li.join(profiles, "s").where(F.col("c") >= F.col("minimum_confidence"))
        .groupBy("policy_id", "check_id", "minimum_confidence").agg(F.count(F.lit(1)).alias("covered"))
    )


@query(
    "policy_document_issues",
    "WITH p AS (SELECT c_custkey AS policy_id, 'k' || (o_orderkey % 6) AS check_id, CASE WHEN o_orderpriority < '3' THEN 'required' ELSE 'advisory' END AS r, CASE WHEN o_orderstatus = 'F' THEN 'BLOCK' "
    "ELSE 'REVIEW' END AS f, o_orderkey % 3 = 0 AS ap, o_orderkey % 2 AS na FROM orders JOIN customer ON o_custkey = c_custkey), c AS (SELECT *, count(*) OVER (PARTITION BY policy_id, check_id) AS n FROM p), "
    "l AS (SELECT policy_id, check_id, list_filter([CASE WHEN n > 1 THEN 'policy check ids must be unique' END, CASE WHEN r = 'advisory' AND f <> 'REVIEW' THEN 'advisory checks cannot block' END, CASE WHEN ap "
    "AND na = 0 THEN 'required approvals need named authorities' END], lambda x: x IS NOT NULL) AS issues FROM c) SELECT * FROM l WHERE len(issues) > 0",
)
def policy_document_issues(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("policy_id"), F.concat(F.lit("k"), (k % 6).cast("string")).alias("check_id"),
        F.when(F.col("o_orderpriority") < "3", "required").otherwise("advisory").alias("requirement"),
        F.when(F.col("o_orderstatus") == "F", "BLOCK").otherwise("REVIEW").alias("on_failure"),
        (k % 3 == 0).alias("approval_required"), F.when(k % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("owner"))).alias("authorities"),
        F.lit(0.5).alias("minimum_confidence"), F.array(F.lit("high")).alias("severities"),
    )
    return P.policy_document_issues(rows)


# --------------------------------------------------------------------------- exceptions
_EX = {
    "requested_at": "o_orderdate", "effective_from": "o_orderdate + INTERVAL 2 DAY", "expires_at": "o_orderdate + INTERVAL 30 DAY",
    "decided_at": "CASE o_orderkey % 11 WHEN 1 THEN o_orderdate - INTERVAL 1 DAY WHEN 2 THEN o_orderdate + INTERVAL 31 DAY ELSE o_orderdate + INTERVAL 1 DAY END",
    "valid_until": "CASE o_orderkey % 13 WHEN 1 THEN o_orderdate + INTERVAL 40 DAY ELSE o_orderdate + INTERVAL 20 DAY END",
    "decision": "CASE WHEN o_orderkey % 7 = 3 THEN 'denied' ELSE 'approved' END",
}


def _exceptions(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("exception_id"), F.col("o_custkey").alias("scope_subject_id"),
        F.array(*[F.concat(F.lit("ob"), ((F.col("o_orderkey") + i) % 9).cast("string")) for i in (2, 0, 1)]).alias("scope_observation_ids"),
        F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("request_digest"),
        *[F.expr(_EX[c]).alias(c) for c in ("requested_at", "effective_from", "expires_at")],
    )


def _approvals(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("exception_id"), F.concat(F.lit("a"), F.col("o_orderkey").cast("string")).alias("approval_id"),
        F.col("o_orderkey").alias("target_exception_id"),
        F.when(F.col("o_orderkey") % 17 == 4, "stale").otherwise(F.concat(F.lit("d"), F.col("o_orderkey").cast("string"))).alias("target_digest"),
        *[F.expr(_EX[c]).alias(c) for c in ("decided_at", "valid_until", "decision")],
    )


_EX_CTE = "ex AS (SELECT o_orderkey AS k, o_custkey AS c, " + ", ".join(f"{e} AS {n}" for n, e in _EX.items()) + ", o_orderkey % 17 = 4 AS stale FROM orders)"
_EX_ORDER = (
    "WHEN stale THEN 'target-mismatch' WHEN decided_at < requested_at THEN 'decision-before-request' WHEN decided_at >= expires_at THEN 'decision-after-exception-expiry' WHEN decision = 'denied' THEN "
    "'approval-denied' WHEN valid_until > expires_at THEN 'approval-outlives-exception' WHEN {at} < effective_from THEN 'not-yet-effective' WHEN {at} >= expires_at THEN 'expired' WHEN {at} >= valid_until "
    "THEN 'approval-expired'"
)


@query(
    "applicable_exceptions",
    f"WITH {_EX_CTE}, q AS (SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_quantity || ':' || l_suppkey || ':' || l_extendedprice AS request_id, l_orderkey AS k, l_shipdate AS at_t, l_partkey % 5 = 0 AS other, 'ob' || (l_partkey % 9) AS ob FROM lineitem), "
    f"r AS (SELECT request_id, ex.k AS exception_id, decided_at, requested_at, CASE {_EX_ORDER.format(at='at_t')} WHEN other THEN 'subject-mismatch' WHEN NOT list_contains(['ob' || ((ex.k + 2) % 9), 'ob' || (ex.k % 9), 'ob' || ((ex.k + 1) % 9)], ob) "
    "THEN 'observation-out-of-scope' ELSE 'applicable' END AS own FROM q JOIN ex USING (k)), f AS (SELECT request_id, exception_id, CASE WHEN exception_id % 19 = 0 THEN 'exception-missing' WHEN exception_id % 23 = 5 THEN CASE WHEN exception_id % 29 = 7 THEN 'approval-denied' ELSE "
    "'approval-missing' END WHEN own = 'applicable' OR exception_id % 29 <> 7 OR decided_at > requested_at + INTERVAL 3 DAY THEN own ELSE 'approval-denied' END AS reason FROM r) SELECT DISTINCT request_id, exception_id, reason = 'applicable' AS applicable, reason FROM f",
)
def applicable_exceptions(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    requests = table(spark, sf, "lineitem").join(o, "l_orderkey").select(
        F.concat_ws(":", *[F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_suppkey", "l_extendedprice")]).alias("request_id"),
        F.col("l_orderkey").alias("exception_id"),
        F.when(F.col("l_partkey") % 5 == 0, F.lit(-1).cast("bigint")).otherwise(F.col("o_custkey")).alias("subject_id"),
        F.concat(F.lit("ob"), (F.col("l_partkey") % 9).cast("string")).alias("observation_id"), F.col("l_shipdate").alias("at"),
    )
    # Some requests name no known exception, some exceptions have no approval, some two: keys without a partner, no row is left out.
    key = F.col("exception_id")
    off = lambda cond: F.when(cond, -key - 1).otherwise(key)
    first, o = _approvals(spark, sf), table(spark, sf, "orders")
    second = o.select(
        F.expr("CASE WHEN o_orderkey % 29 = 7 THEN o_orderkey ELSE -o_orderkey - 1 END").alias("exception_id"), F.concat(F.lit("b"), F.col("o_orderkey").cast("string")).alias("approval_id"),
        F.col("o_orderkey").alias("target_exception_id"), F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("target_digest"),
        F.expr("o_orderdate + INTERVAL 3 DAY").alias("decided_at"), F.expr("o_orderdate + INTERVAL 20 DAY").alias("valid_until"), F.lit("denied").alias("decision"),
    )
    approvals = first.withColumn("exception_id", off(key % 23 == 5)).unionByName(second)
    return P.applicable_exceptions(requests, _exceptions(spark, sf).withColumn("exception_id", off(key % 19 == 0)), approvals)


@query(
    "exception_audit",
    f"WITH {_EX_CTE}, s AS (SELECT *, list_sort(['ob' || ((k + 2) % 9), 'ob' || (k % 9), 'ob' || ((k + 1) % 9)]) AS obs FROM ex) SELECT k AS exception_id, 'a' || k AS approval_id, decision, obs AS observation_ids, "
    "'sha256:' || sha256(to_json({'approvalId': 'a' || k, 'decision': decision, 'exceptionId': k, 'observationIds': obs, 'requestDigest': 'd' || k, 'subjectId': c})) AS event_digest FROM s",
)
def exception_audit(spark: SparkSession, sf: str) -> DataFrame:
    return P.exception_audit(_exceptions(spark, sf), _approvals(spark, sf))


@query(
    "exception_time_state",
    f"WITH {_EX_CTE} SELECT k AS exception_id, CASE WHEN stale THEN 'target-mismatch' WHEN decision = 'denied' THEN 'denied' {_EX_ORDER.format(at=chr(39) + '1998-01-10' + chr(39) + '::TIMESTAMP')} ELSE 'within-time-window' END AS state FROM ex",
)
def exception_time_state(spark: SparkSession, sf: str) -> DataFrame:
    j = _exceptions(spark, sf).join(_approvals(spark, sf), "exception_id")
    return j.select("exception_id", P.exception_time_state(F.lit("1998-01-10").cast("timestamp_ntz")).alias("state"))


# --------------------------------------------------------------------------- approvals
_ACTIONS = [*P.ACTIONS, "dance"]
_RC = {
    "requested_at": "o_orderdate", "expires_at": "o_orderdate + INTERVAL 10 DAY",
    "decided_at": "CASE WHEN o_orderkey % 19 = 5 THEN o_orderdate + INTERVAL 11 DAY ELSE o_orderdate + INTERVAL 1 DAY END",
    "decision": "CASE WHEN o_orderkey % 6 = 1 THEN 'denied' ELSE 'approved' END",
}


def _receipts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    # A receipt of a pending order answers no request.
    base = table(spark, sf, "orders").select(
        F.expr("CASE WHEN o_orderstatus <> 'P' THEN o_orderkey ELSE -o_orderkey - 1 END").alias("request_id"), pick(_ACTIONS, F.pmod("o_orderkey", F.lit(len(_ACTIONS)))).alias("real"),
        F.lit("agent").alias("actor"), F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("target"),
        F.array(F.lit("src/a.ts"), F.concat(F.lit("src/f"), (k % 4).cast("string"))).alias("files"), F.lit("none").alias("policy_effect"),
        F.when(k % 9 == 2, F.array(F.lit("https://x"))).otherwise(F.array().cast("array<string>")).alias("network"),
        *[F.expr(e).alias(n) for n, e in _RC.items()],
    )
    base = base.withColumn("receipt_action", F.when(F.col("request_id") % 23 == 7, "sign").otherwise(F.col("real"))).drop("real")
    return base.withColumn(
        "request_digest", F.when(F.col("request_id") % 29 == 3, "sha256:forged").otherwise(P.request_digest())
    )


_RC_CTE = "rc AS (SELECT o_orderkey AS k, o_custkey AS c, " + ", ".join(f"{e} AS {n}" for n, e in _RC.items()) + f", o_orderstatus <> 'P' AS have, {sql_pick(_ACTIONS, f'o_orderkey % {len(_ACTIONS)}')} AS action, o_orderdate FROM orders)"


@query(
    "authorize_actions",
    f"""WITH {_RC_CTE}, q AS (SELECT *, o_orderdate + to_days((k % 12)::INT) AS at_t, CASE WHEN k % 23 = 7 THEN 'sign' ELSE action END AS ra FROM rc),
r AS (SELECT k AS request_id, CASE WHEN action = 'dance' THEN 'receipt-invalid' WHEN action IN ('inspect', 'propose') THEN 'approval-not-required' WHEN NOT have THEN 'approval-missing'
 WHEN NOT (decided_at >= requested_at AND decided_at < expires_at) THEN 'receipt-invalid' WHEN ra <> action THEN 'action-mismatch' WHEN k % 29 = 3 THEN 'receipt-invalid'
 WHEN at_t < requested_at OR at_t >= expires_at OR at_t < decided_at THEN 'expired' WHEN decision <> 'approved' THEN 'denied' ELSE 'usable' END AS reason FROM q)
SELECT request_id, reason IN ('usable', 'approval-not-required') AS allowed, reason FROM r""",
)
def authorize_actions(spark: SparkSession, sf: str) -> DataFrame:
    requests = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"), pick(_ACTIONS, F.pmod("o_orderkey", F.lit(len(_ACTIONS)))).alias("action"),
        F.expr("o_orderdate + make_interval(0, 0, 0, CAST(o_orderkey % 12 AS INT))").alias("at"),
    )
    return P.authorize_actions(requests, _receipts(spark, sf))


@query(
    "remediation_allowed",
    f"""WITH {_RC_CTE}, p AS (SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_quantity AS proposal_id, l_orderkey AS k, l_partkey % 4 AS f, l_linenumber = 7 AS othertarget FROM lineitem)
SELECT proposal_id, coalesce(have AND decision = 'approved' AND p.k % 29 <> 3 AND TIMESTAMP '1997-03-05' >= requested_at AND TIMESTAMP '1997-03-05' < expires_at AND TIMESTAMP '1997-03-05' >= decided_at
 AND CASE WHEN p.k % 23 = 7 THEN 'sign' ELSE action END = 'mutate' AND NOT othertarget AND p.k % 9 <> 2 AND f = p.k % 4, false) AS allowed FROM p LEFT JOIN rc USING (k)""",
)
def remediation_allowed(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    proposals = table(spark, sf, "lineitem").join(o, "l_orderkey").select(
        F.concat_ws(":", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_quantity")).alias("proposal_id"),
        F.col("l_orderkey").alias("request_id"),
        F.when(F.col("l_linenumber") == 7, "other").otherwise(F.concat(F.lit("t"), F.col("o_custkey").cast("string"))).alias("target"),
        F.array(F.concat(F.lit("src/f"), (F.col("l_partkey") % 4).cast("string"))).alias("files"), F.lit("none").alias("policy_effect"),
    )
    return P.remediation_allowed(proposals, _receipts(spark, sf), F.lit("1997-03-05").cast("timestamp_ntz"))


@query(
    "resolve_org_policy",
    "WITH e AS (SELECT c_nationkey AS o, c_custkey AS r, c_custkey % 6 <> 1 AS have, c_custkey % 11 = 2 AS forged, c_custkey % 7 AS kid, c_custkey % 5 = 4 AS old FROM customer) SELECT o AS organization_id, r AS "
    "repository_id, reason = 'resolved' AS resolved, reason FROM (SELECT *, CASE WHEN NOT have THEN 'offline-unavailable' WHEN forged THEN 'policy-digest-mismatch' WHEN kid = 6 THEN 'unknown-key' WHEN kid = 5 THEN "
    "'key-not-active' WHEN old THEN 'cache-expired' ELSE 'resolved' END AS reason FROM e)",
)
def resolve_org_policy(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    policy = F.concat(F.lit("policy of "), k.cast("string"))
    env = c.select(
        F.col("c_nationkey").alias("organization_id"), F.when(k % 6 == 1, -k - 1).otherwise(k).alias("repository_id"), policy.alias("policy"),
        F.when(k % 11 == 2, "sha256:forged").otherwise(sha256_tag(policy)).alias("policy_digest"), (k % 7).alias("key_id"),
        F.when(k % 5 == 4, F.lit("2020-01-01")).otherwise(F.lit("2030-01-01")).cast("timestamp").alias("expires_at"),
    )
    keys = c.select((k % 7).alias("key_id")).distinct().select(
        F.when(F.col("key_id") < 6, F.col("key_id")).otherwise(-1).alias("key_id"), F.when(F.col("key_id") == 5, "revoked").otherwise("active").alias("status")
    )
    repos = c.select(F.col("c_nationkey").alias("organization_id"), k.alias("repository_id"))
    return P.resolve_org_policy(repos, env, keys, F.lit("2024-01-01").cast("timestamp"))


# --------------------------------------------------------------------------- ordered verdicts
@query(
    "rollback_allowed",
    "WITH r AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 AS ap, CASE WHEN o_custkey % 4 = 0 THEN 'signing-identity' ELSE 'image' END AS ck, CASE WHEN o_orderkey % 7 = 0 THEN "
    "'package' WHEN o_custkey % 4 = 0 THEN 'signing-identity' ELSE 'image' END AS tk, 'v' || (o_orderkey % 5) AS cr, 'v' || (o_orderkey % 6) AS tr, o_orderkey % 10 <> 4 AS keep, CASE WHEN o_orderkey % 9 < 5 THEN 'v' || "
    "(o_custkey % 5) END AS rep FROM orders), x AS (SELECT k AS request_id, CASE WHEN NOT ap THEN 'approval-required' WHEN ck <> tk THEN 'kind-invalid' WHEN cr = tr THEN 'same-reference' WHEN NOT keep THEN "
    "'history-invalidation-requested' WHEN ck = 'signing-identity' AND rep IS NULL THEN 'revocation-requires-replacement' WHEN ck = 'signing-identity' AND rep = cr THEN 'same-reference' WHEN ck <> 'signing-identity' AND rep "
    "IS NOT NULL THEN 'revocation-not-applicable' ELSE 'allowed' END AS reason FROM r) SELECT request_id, reason = 'allowed' AS allowed, reason FROM x",
)
def rollback_allowed(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.when(c % 4 == 0, "signing-identity").otherwise("image")

    def v(x: F.Column) -> F.Column:
        return F.concat(F.lit("v"), x.cast("string"))

    rows = table(spark, sf, "orders").select(
        k.alias("request_id"), ((k % 2 == 0) | (k % 3 == 0)).alias("approved"), kind.alias("current_kind"),
        F.when(k % 7 == 0, "package").otherwise(kind).alias("target_kind"), F.lit("me").alias("current_identity"),
        F.lit("me").alias("target_identity"), v(k % 5).alias("current_ref"), v(k % 6).alias("target_ref"),
        (k % 10 != 4).alias("preserve_history"), F.lit("bad release").alias("reason"), F.when(k % 9 < 5, v(c % 5)).alias("replacement_ref"),
    )
    reason = P.rollback_reason()
    return rows.select("request_id", (reason == "allowed").alias("allowed"), reason.alias("reason"))


@query(
    "attack_verdict",
    "SELECT event_id, CASE WHEN event_type = 'error' THEN 'policy-denied' WHEN event_type = 'signup' THEN 'not-supported' WHEN event_id % 7 = 0 THEN 'environment-error' WHEN event_id % 5 = 0 THEN 'inconclusive' WHEN event_id "
    "% 3 = 0 THEN 'inconclusive' WHEN event_id % 2 = 0 THEN 'confirmed' ELSE 'not-reproduced' END AS verdict FROM events",
)
def attack_verdict(spark: SparkSession, sf: str) -> DataFrame:
    k, t = F.col("event_id"), F.col("event_type")
    verdict = P.attack_verdict(t != "error", t != "signup", k % 7 == 0, k % 5 == 0, F.when(k % 3 != 0, k % 2 == 0))
    return table(spark, sf, "events").select("event_id", verdict.alias("verdict"))


# --------------------------------------------------------------------------- constraints
_ATT = {
    "executed": "l_linenumber < 6", "started_at": "CASE WHEN l_linenumber < 5 OR l_linenumber = 7 THEN l_shipdate END",
    "completed_at": "CASE WHEN l_partkey % 9 = 0 THEN l_shipdate - INTERVAL 1 DAY ELSE l_shipdate END",
    "approval_status": "CASE l_partkey % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'not-required' WHEN 2 THEN 'denied' ELSE 'not-requested' END",
    "isolation": "CASE l_suppkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'container' ELSE 'process' END", "non_root": "l_suppkey % 5 > 0",
    "cleanup": "CASE WHEN l_suppkey % 4 = 0 THEN 'not-started' ELSE 'complete' END", "runtime_digest": "CASE WHEN l_suppkey % 2 = 0 THEN 'x' END",
    "has_output": "l_partkey % 2 = 0", "secret_inputs": "CASE WHEN l_partkey % 6 = 0 THEN 'some' ELSE 'none' END",
    "verdict": "CASE l_partkey % 5 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'not_reproduced' WHEN 2 THEN 'not_supported' WHEN 3 THEN 'policy_denied' ELSE 'inconclusive' END",
    "evidence_digest": "CASE WHEN l_partkey % 3 = 0 THEN 'e' END", "signature_status": "CASE WHEN l_suppkey % 7 = 0 THEN 'invalid' ELSE 'verified' END",
    "network_mode": "CASE WHEN l_partkey % 2 = 1 THEN 'denied' ELSE 'open' END",
    "usage_duration_ms": "l_quantity", "usage_cpu_ms": "l_partkey % 3", "usage_memory_bytes": "0", "usage_disk_bytes": "0", "usage_processes": "1",
    "usage_output_bytes": "0", "usage_network_requests": "l_orderkey % 2", "limit_timeout_ms": "40", "limit_cpu_ms": "1", "limit_memory_bytes": "1",
    "limit_disk_bytes": "1", "limit_processes": "1", "limit_output_bytes": "1", "limit_network_requests": "0",
}
_ATT_LABELS = [
    ("executed AND started_at IS NULL", "executed requires started_at"),
    ("executed AND approval_status NOT IN ('approved', 'not-required')", "executed requires approval"),
    ("executed AND isolation = 'none'", "executed requires isolation"),
    ("executed AND NOT non_root", "executed requires a non-root identity"),
    ("executed AND cleanup = 'not-started'", "executed requires a cleanup outcome"),
    ("executed AND isolation = 'container' AND runtime_digest IS NULL", "isolation requires a runtime digest"),
    ("NOT executed AND started_at IS NOT NULL", "idle cannot have started_at"),
    ("NOT executed", "idle requires zero usage"),
    ("NOT executed AND has_output", "idle cannot contain output"),
    ("NOT executed AND cleanup <> 'not-started'", "idle requires not-started cleanup"),
    ("NOT executed AND secret_inputs <> 'none'", "idle cannot receive secrets"),
    ("NOT executed AND verdict IN ('confirmed', 'not_reproduced')", "verdict requires execution"),
    ("verdict IN ('confirmed', 'not_reproduced') AND evidence_digest IS NULL", "verdict requires an evidence digest"),
    ("executed AND verdict IN ('not_supported', 'policy_denied')", "verdict must not execute"),
    ("verdict = 'policy_denied' AND approval_status NOT IN ('denied', 'not-requested')", "policy_denied requires a denied approval"),
    ("executed AND signature_status <> 'verified'", "unverified recipes must not execute"),
    ("network_mode = 'denied' AND usage_network_requests <> 0", "denied network requires zero requests"),
    ("usage_duration_ms > limit_timeout_ms", "usage_duration_ms exceeds limit_timeout_ms"),
    ("usage_cpu_ms > limit_cpu_ms", "usage_cpu_ms exceeds limit_cpu_ms"),
    ("usage_network_requests > limit_network_requests", "usage_network_requests exceeds limit_network_requests"),
    ("completed_at < started_at", "completed_at precedes started_at"),
]


def _list(labels: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {quote(t)} END" for c, t in labels) + "], lambda x: x IS NOT NULL)"


@query(
    "attempt_constraints",
    "WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(f"{e} AS {n}" for n, e in _ATT.items()) + f" FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, {_list(_ATT_LABELS)} AS issues FROM a",
)
def attempt_constraints(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[F.expr(e).alias(n) for n, e in _ATT.items()])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", P.attempt_issues().alias("issues"))


@query(
    "release_decision_constraints",
    """WITH s AS (SELECT l_orderkey AS k, count(*) FILTER (l_linenumber = 1) AS np, max(CASE WHEN l_linenumber = 1 THEN l_partkey END) AS p, count(DISTINCT l_partkey % 50) AS nd, count(*) AS n,
 count(DISTINCT l_suppkey % 20) AS ad, bool_or(l_shipdate > o_orderdate + INTERVAL 90 DAY) AS late, bool_or(l_shipdate + INTERVAL 40 DAY <= o_orderdate + INTERVAL 90 DAY) AS exp, max(o_orderstatus) AS st, max(o_orderpriority) AS pr, max(o_custkey) AS c
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT k AS decision_id, """ + _list([
        ("np <> 1", "exactly one primary subject required"),
        ("np = 1 AND c % 3 = 0", "evaluation subject must equal the primary subject"),
        ("nd <> n", "subject ids must be unique"), ("ad <> n", "approval ids must be unique"),
        ("st = 'P'", "decision must equal the evaluation"), ("pr = '1-URGENT'", "policy must equal the evaluation's policy"),
        ("k % 8 = 0", "decision precedes its evaluation"), ("late", "approval after decision"), ("exp", "approval expired before decision"),
    ]) + " AS issues FROM s",
)
def release_decision_constraints(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.collect_list(
            F.struct((F.col("l_partkey") % 50).alias("subject_id"), F.when(F.col("l_linenumber") == 1, "primary").otherwise("other").alias("role"))
        ).alias("subjects"),
        F.collect_list(
            F.struct(
                (F.col("l_suppkey") % 20).alias("approval_id"), F.col("l_shipdate").alias("decided_at"),
                (F.col("l_shipdate") + F.expr("INTERVAL 40 DAY")).alias("valid_until"),
            )
        ).alias("approvals"),
    )
    j = table(spark, sf, "orders").join(li, "o_orderkey")
    primary = F.get(F.filter("subjects", lambda s: s["role"] == "primary"), F.lit(0))["subject_id"]
    made = F.col("o_orderdate") + F.expr("INTERVAL 90 DAY")
    rows = j.select(
        F.col("o_orderkey").alias("decision_id"), "subjects", "approvals",
        F.when(F.col("o_custkey") % 3 == 0, F.lit(-1).cast("bigint")).otherwise(primary).alias("evaluation_subject_id"),
        F.lit("PASS").alias("decision"), F.when(F.col("o_orderstatus") == "P", "BLOCK").otherwise("PASS").alias("evaluation_decision"),
        F.lit("d").alias("policy_digest"), F.when(F.col("o_orderpriority") == "1-URGENT", "e").otherwise("d").alias("evaluation_policy_digest"),
        made.alias("generated_at"), F.when(F.col("o_orderkey") % 8 == 0, made + F.expr("INTERVAL 1 DAY")).otherwise(made).alias("evaluated_at"),
    )
    return rows.select("decision_id", P.release_decision_issues().alias("issues"))


_AI = {
    "basis": "CASE doc_id % 4 WHEN 0 THEN 'heuristic' WHEN 1 THEN 'declared' WHEN 2 THEN 'cryptographic' ELSE 'guess' END",
    "presentation": "CASE doc_id % 5 WHEN 0 THEN 'estimate' WHEN 1 THEN 'declared-claim' WHEN 2 THEN 'verified-declaration' ELSE 'unverified-declaration' END",
    "classification": "CASE WHEN doc_id % 3 = 0 THEN 'not-asserted' ELSE 'ai-likely' END", "likelihood": "CASE WHEN doc_id % 7 > 0 THEN doc_id % 7 / 5.0 END",
    "signature_status": "CASE WHEN doc_id % 2 = 0 AND doc_id % 3 > 0 THEN 'verified' ELSE 'invalid' END", "verified_at": "CASE WHEN doc_id % 11 > 4 THEN 1 END",
    "bundle_digest": "CASE WHEN doc_id % 13 > 4 THEN 'b' END", "claim_kind": "CASE WHEN doc_id % 8 < 5 THEN 'ai-change' ELSE 'build-provenance' END",
    "n_limitations": "doc_id % 6",
}


@query(
    "ai_evidence_constraints",
    "WITH a AS (SELECT doc_id, " + ", ".join(f"{e} AS {n}" for n, e in _AI.items()) + " FROM documents) SELECT doc_id, " + _list([
        ("basis = 'guess'", "basis is not allowed"),
        ("basis = 'heuristic' AND presentation <> 'estimate'", "heuristic evidence is an estimate"),
        ("basis = 'heuristic' AND classification = 'not-asserted'", "heuristic evidence must classify"),
        ("basis = 'heuristic' AND (likelihood IS NULL OR likelihood > 1)", "likelihood is out of range"),
        ("basis = 'declared' AND presentation <> 'declared-claim'", "declared evidence is a claim"),
        ("basis = 'cryptographic' AND (signature_status = 'verified') <> (presentation = 'verified-declaration')", "presentation must match the signature status"),
        ("basis = 'cryptographic' AND signature_status = 'verified' AND (verified_at IS NULL OR bundle_digest IS NULL)", "verified needs time and bundle"),
        ("basis = 'cryptographic' AND claim_kind <> 'ai-change' AND classification <> 'not-asserted'", "non-AI claim cannot assert a class"),
        ("n_limitations < 1", "limitations required"),
    ]) + " AS issues FROM a",
)
def ai_evidence_constraints(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", *[F.expr(e).alias(n) for n, e in _AI.items()])
    return rows.select("doc_id", P.ai_evidence_issues().alias("issues"))


@query(
    "public_projection",
    "WITH r AS (SELECT o_orderkey AS record_id, CASE WHEN o_custkey % 9 = 0 THEN 'bad id' ELSE 'org' || (o_custkey % 2) END AS o, 'sha256:' || sha256(o_orderkey::VARCHAR) AS d, (['PASS', 'BLOCK', 'REVIEW', 'MAYBE'])[(o_orderkey % 4)::INT + "
    "1] AS dec, o_orderpriority = '1-URGENT' AS priv, o_orderkey % 10 = 3 AS odd FROM orders), x AS (SELECT *, CASE WHEN o = 'bad id' THEN 'invalid_projection' WHEN o <> 'org1' THEN 'cross_tenant' WHEN priv THEN "
    "'private_field' WHEN odd THEN 'unsupported_field' WHEN dec = 'MAYBE' THEN 'invalid_projection' ELSE 'ok' END AS reason FROM r) SELECT record_id, CASE WHEN reason = 'ok' THEN o END AS organization_id, CASE WHEN reason "
    "= 'ok' THEN dec END AS decision, CASE WHEN reason = 'ok' THEN ['" + P.WITHHELD + "'] END AS limitations, reason FROM x",
)
def public_projection(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    digest = sha256_tag(k.cast("string"))
    rows = table(spark, sf, "orders").select(
        k.alias("record_id"), F.when(F.col("o_custkey") % 9 == 0, "bad id").otherwise(F.concat(F.lit("org"), (F.col("o_custkey") % 2).cast("string"))).alias("organization_id"),
        F.lit("w1").alias("workspace_id"), digest.alias("record_digest"), pick(["PASS", "BLOCK", "REVIEW", "MAYBE"], k % 4).alias("decision"),
        digest.alias("subject_digest"), F.lit("incomplete").alias("coverage_status"), F.lit("unknown").alias("signer_status"),
        F.array(F.lit("secret detail")).alias("limitations"), F.when(F.col("o_orderpriority") == "1-URGENT", "me").alias("signer_identity"),
        F.when(k % 10 == 3, "x").alias("color"),
    )
    return P.public_projection(rows, F.lit("org1")).select("record_id", "organization_id", "decision", "limitations", "reason")


_MEMBER_PATHS = ["a/b.ts", "c.txt", "dir/", "a\\d", "x/../y", "ok", "deep/er/z", "/abs", "ln", "ln2"]


@query(
    "archive_member_safety",
    f"""WITH m AS (SELECT l_orderkey AS a, l_linenumber AS pos, replace({sql_pick(_MEMBER_PATHS, f'l_partkey % {len(_MEMBER_PATHS)}')}, chr(92), '/') || CASE WHEN l_partkey % 10 IN (0, 1, 5, 6) THEN (l_suppkey % 3)::VARCHAR ELSE '' END AS p,
 l_quantity::BIGINT AS size, CASE WHEN l_partkey % 10 = 8 THEN (['t', '../t', 'x/../../t', '/t'])[(l_suppkey % 4)::INT + 1] END AS target, l_partkey % 10 = 9 AS nolink, l_partkey, l_quantity, l_extendedprice FROM lineitem),
u AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY pos, l_partkey, l_quantity, l_extendedprice) AS rn FROM m),
c AS (SELECT a, rn, size, CASE WHEN p IN ('x/../y', '/abs') THEN 'TRAVERSAL' WHEN min(rn) OVER (PARTITION BY a, p) < rn THEN 'DUPLICATE' WHEN nolink OR target IN ('../t', 'x/../../t', '/t') THEN 'LINK_ESCAPE' END AS code,
 sum(size) OVER (PARTITION BY a ORDER BY rn) AS run, count(*) OVER (PARTITION BY a) AS n FROM u),
b AS (SELECT a, rn, n, CASE WHEN code IN ('TRAVERSAL', 'DUPLICATE') THEN code WHEN run > 120 THEN 'LIMIT' ELSE code END AS code FROM c)
SELECT a AS archive_id, CASE WHEN max(n) > 6 THEN 'LIMIT' ELSE arg_min(code, rn) FILTER (code IS NOT NULL) END AS code FROM b GROUP BY 1""",
)
def archive_member_safety(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    li = table(spark, sf, "lineitem")
    # an order has at most a handful of lines; the position only makes repeated line numbers distinct
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    k = F.col("l_partkey") % 10
    path = F.concat(
        pick(_MEMBER_PATHS, F.pmod("l_partkey", F.lit(len(_MEMBER_PATHS)))), F.when(k.isin(0, 1, 5, 6), (F.col("l_suppkey") % 3).cast("string")).otherwise("")
    )
    members = li.select(
        F.col("l_orderkey").alias("archive_id"), F.row_number().over(w).cast("bigint").alias("pos"), path.alias("path"),
        F.when(k.isin(8, 9), "symlink").otherwise("file").alias("kind"), F.col("l_quantity").cast("bigint").alias("size"),
        F.when(k == 8, pick(["t", "../t", "x/../../t", "/t"], F.pmod("l_suppkey", F.lit(4)))).alias("link_target"),
    )
    return P.archive_issues(members, 6, 120)


# --------------------------------------------------------------------------- hypotheses and proofs
_HR = ["D1-001", "D1-003", "D6-001", "D4-001", "AUTH-001", "D1-008", "AGENT-001"]


@query(
    "plan_hypotheses",
    None,
)
def plan_hypotheses(spark: SparkSession, sf: str) -> DataFrame:
    """Findings from ``events`` against the inventory of the generated code."""
    inv = inventory.surface_inventory(code_files(spark, sf))
    findings = _hypothesis_findings(spark, sf)
    books = findings.select(F.when(F.col("rule") == "D1-008", "none").otherwise(F.col("rule")).alias("rule")).distinct()
    coverage = findings.select("repo_id").distinct().select(
        "repo_id", F.when(F.length("repo_id") == 2, "incomplete").otherwise("complete").alias("status")
    )
    return P.plan_hypotheses(findings, inv, books, coverage)


def _hypothesis_findings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("finding_id"), F.concat(F.lit("r"), F.expr("user_id div 4").cast("string")).alias("repo_id"),
        pick(_HR, F.pmod("event_id", F.lit(len(_HR)))).alias("rule"),
    )


def _register_hypotheses_oracle() -> None:
    from workloads import ORACLES
    from workloads.supply_chain import _INV_SQL

    need = "CASE rule " + " ".join(f"WHEN '{r}' THEN {sql_list(s)}" for r, s in P.RULE_SIGNALS.items()) + " END"
    ORACLES["plan_hypotheses"] = _INV_SQL + f""", sig AS (SELECT repo_id, list(DISTINCT CASE kind WHEN 'sink' THEN 'sink:' || name WHEN 'tool' THEN 'agent-tool' WHEN 'package' THEN 'dependency' ELSE kind END) AS have FROM inv GROUP BY 1),
f AS (SELECT event_id AS finding_id, 'r' || (user_id // 4) AS repo_id, {sql_pick(_HR, f'event_id % {len(_HR)}')} AS rule FROM events),
j AS (SELECT f.*, have, {need} AS need FROM f LEFT JOIN sig USING (repo_id)),
k AS (SELECT *, rule = 'D1-008' OR need IS NULL AS u, length(repo_id) = 2 AS inc, NOT coalesce(list_has_any(need, have), false) AS miss FROM j)
SELECT finding_id, repo_id, rule, CASE WHEN u THEN 'unsupported' WHEN inc OR miss THEN 'not_attemptable' ELSE 'supported' END AS status, CASE WHEN u THEN 'no playbook maps the rule' WHEN inc THEN 'coverage is incomplete' WHEN miss
THEN 'no matching capability' ELSE 'playbook and capability match' END AS reason FROM k"""


_register_hypotheses_oracle()


@query(
    "audit_proof_binding",
    """WITH p AS (SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderkey % 3 = 0 THEN 'confirmed' WHEN o_orderkey % 3 = 1 THEN 'not_reproduced' ELSE 'inconclusive' END AS v, o_orderstatus <> 'P' AS done,
 CASE WHEN o_orderpriority = '5-LOW' THEN 'failed' ELSE 'passed' END AS nc FROM orders),
a AS (SELECT l_orderkey AS k, count(*) AS m FROM lineitem JOIN p ON p.k = l_orderkey WHERE l_quantity > 15 AND l_discount > 0.02 AND v <> 'inconclusive' GROUP BY 1),
o AS (SELECT CASE WHEN c_nationkey = 9 THEN -c_custkey ELSE c_custkey END AS c, c_nationkey AS n FROM customer)
SELECT p.k AS proof_id, coalesce(m, 0)::BIGINT AS matches, l AS reasons, CASE WHEN len(l) = 0 THEN 'auditable' ELSE 'not-auditable' END AS status FROM (SELECT p.*, m, """ + _list([
        ("o.c IS NULL", "observation is not included"), ("n = 4", "observation does not bind the subject"), ("n = 5", "rule does not match the observation"),
        ("NOT done", "proof was not completed"), ("nc <> 'passed'", "negative control did not pass"), ("v = 'inconclusive'", "verdict is not release-grade"),
        ("coalesce(m, 0) = 0", "no attempt with the exact binding"), ("m > 1", "several attempts with the exact binding"),
    ]) + " AS l FROM p LEFT JOIN a ON a.k = p.k LEFT JOIN o ON o.c = p.c) p",
)
def audit_proof_binding(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    verdict = F.when(k % 3 == 0, "confirmed").when(k % 3 == 1, "not_reproduced").otherwise("inconclusive")

    def keys(obs: F.Column, v: F.Column) -> list[F.Column]:
        tag = k.cast("string")
        return [
            obs.alias("observation_id"), F.concat(F.lit("s"), obs.cast("string")).alias("subject_id"), F.concat(F.lit("f"), tag).alias("finding_id"),
            F.lit("D1-001").alias("rule"), F.lit("rd").alias("recipe_digest"), F.lit("td").alias("trust_policy_digest"),
            F.concat(F.lit("ad"), tag).alias("approval_digest"), v.alias("verdict"), F.concat(F.lit("ev"), tag).alias("evidence_digest"),
        ]

    o = table(spark, sf, "orders")
    proofs = o.select(
        k.alias("proof_id"), *keys(F.col("o_custkey"), verdict), (F.col("o_orderstatus") != "P").alias("completed"),
        F.when(F.col("o_orderpriority") == "5-LOW", "failed").otherwise("passed").alias("negative_control"),
    )
    attempts = (
        table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity", "l_discount")
        .join(o.select("o_orderkey", "o_custkey"), "o_orderkey")
        .select(
            *keys(F.col("o_custkey"), F.when(k % 3 == 2, "other").otherwise(verdict)), (F.col("l_quantity") > 15).alias("executed"),
            F.when(F.col("l_discount") > 0.02, "verified").otherwise("invalid").alias("signature_status"), F.lit("approved").alias("approval_status"),
        )
    )
    n = F.col("c_nationkey")
    observations = table(spark, sf, "customer").select(
        F.when(n == 9, -F.col("c_custkey")).otherwise(F.col("c_custkey")).alias("observation_id"),
        F.concat(F.when(n == 4, "x").otherwise("s"), F.col("c_custkey").cast("string")).alias("subject_id"),
        F.when(n == 5, "D9").otherwise("D1-001").alias("rule"),
    )
    return P.audit_proof_binding(proofs, attempts, observations)


# what a proof or retest says, by the order's key; the SQL of each column, which Spark reads too
_EVIDENCE = {
    "evidence_id": "o_orderkey", "record_id": "o_custkey", "kind": "CASE WHEN o_orderkey % 3 = 0 THEN 'retest' ELSE 'proof' END", "subject_id": "concat('s', o_orderkey)",
    "before_subject_id": "concat(CASE WHEN o_orderkey % 10 = 3 THEN 's' ELSE 'b' END, o_orderkey)", "observation_id": "concat('o', o_orderkey)", "finding_id": "concat('f', o_orderkey)",
    "rule": "'D1'", "recipe_digest": "'rd'", "trust_policy_digest": "'td'", "approval_digest": "concat('ad', o_orderkey)", "executes": "o_orderkey % 11 <> 0",
    "run_status": "CASE WHEN o_orderkey % 13 = 0 THEN 'failed' ELSE 'completed' END",
    "verdict": "CASE WHEN o_orderkey % 7 = 0 THEN 'inconclusive' WHEN o_orderkey % 2 = 1 THEN 'confirmed' ELSE 'not-reproduced' END",
    "negative_control": "CASE WHEN o_orderkey % 17 = 0 THEN 'failed' ELSE 'passed' END", "outcome_finding_id": "concat('f', CASE WHEN o_orderkey % 19 = 0 THEN -o_orderkey - 1 ELSE o_orderkey END)",
    "outcome_verdict": "CASE WHEN o_orderkey % 23 = 0 THEN 'other' WHEN o_orderkey % 7 = 0 THEN 'inconclusive' WHEN o_orderkey % 2 = 1 THEN 'confirmed' ELSE 'not-reproduced' END",
    "outcome_digest": "CASE WHEN o_orderkey % 29 <> 0 THEN concat('ev', o_orderkey) END", "counter_verdict": "CASE WHEN o_orderkey % 31 <> 0 THEN 'not-reproduced' END",
    "counter_digest": "'cd'", "retest_status": "CASE o_orderkey % 4 WHEN 0 THEN 'cleared' WHEN 1 THEN 'still-reproduced' WHEN 2 THEN 'inconclusive' ELSE 'not-attemptable' END",
    "emitted_attempt_id": "CASE o_orderkey % 5 WHEN 0 THEN concat(o_orderkey, '-1') WHEN 1 THEN 'none' END",
}


@query(
    "audit_release_evidence",
    "WITH e AS (SELECT o_orderkey AS k, " + ", ".join(f"{x} AS {n}" for n, x in _EVIDENCE.items()) + """ FROM orders),
a AS (SELECT l_orderkey AS k, count(*) FILTER (l_quantity > 15 AND l_discount > 0.02) AS n, bool_or(l_linenumber = 1) AS one, bool_or(l_linenumber = 1 AND l_quantity > 15 AND l_discount > 0.02) AS one_fits FROM lineitem GROUP BY 1),
j AS (SELECT e.*, CASE WHEN verdict <> 'inconclusive' AND outcome_digest IS NOT NULL THEN coalesce(n, 0) ELSE 0 END AS m, kind = 'retest' AS re, k % 5 = 0 AND coalesce(one, false) AS held,
 k % 5 = 0 AND coalesce(one_fits, false) AND verdict <> 'inconclusive' AND outcome_digest IS NOT NULL AS own FROM e LEFT JOIN a USING (k)), l AS (SELECT *, """ + _list([
        ("re AND k % 10 = 3", "retest subjects are not distinct"), ("k % 37 = 0", "target subject is not in the record"), ("re AND CASE WHEN k % 10 = 3 THEN k % 37 = 0 ELSE k % 41 = 0 END", "subject before the retest is not in the record"),
        ("k % 43 = 0", "observation is not in the record"), ("k % 43 <> 0 AND k % 47 = 0", "observation does not bind the subject"), ("k % 43 <> 0 AND k % 53 = 0", "rule does not match the observation"),
        ("NOT executes OR run_status <> 'completed'", "proof was not executed to completion"), ("negative_control <> 'passed'", "negative control did not pass"), ("verdict = 'inconclusive'", "verdict is not release-grade"),
        ("k % 19 = 0", "outcome does not bind the finding"), ("k % 23 = 0", "outcome does not match the verdict"), ("k % 31 = 0", "negative-control outcome is missing"), ("k % 29 = 0", "evidence digests of both controls are missing"),
        ("re AND k % 4 > 1", "retest is not release-grade"), ("re AND k % 4 = 0 AND verdict <> 'not-reproduced'", "cleared retest binds another proof"), ("re AND k % 4 = 1 AND verdict <> 'confirmed'", "still-reproduced retest binds another proof"),
        ("m = 0", "no attempt with the exact binding"), ("m > 1", "several attempts with the exact binding"), ("k % 5 < 2 AND NOT own", "emitted attempt does not match the binding"), ("k % 5 < 2 AND NOT held", "emitted attempt is not in the record"),
    ]) + " AS reasons FROM j) SELECT evidence_id, record_id, m::BIGINT AS matches, reasons, CASE WHEN len(reasons) = 0 THEN 'auditable' ELSE 'not-auditable' END AS status FROM l",
)
def audit_release_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """A record per customer: proofs and retests per order, attempts per line item; gaps by keys that differ."""
    o = table(spark, sf, "orders")
    evidence = o.select(*[F.expr(x).alias(n) for n, x in _EVIDENCE.items()])
    record, k = F.col("o_custkey").alias("record_id"), F.col("o_orderkey")
    named = lambda text, gap: F.concat(F.lit(text), F.when(k % gap == 0, -k - 1).otherwise(k).cast("string"))
    subjects = o.select(record, named("s", 37).alias("subject_id")).unionByName(o.select(record, named("b", 41).alias("subject_id")))
    observations = o.select(record, named("o", 43).alias("observation_id"), named("s", 47).alias("subject_id"), F.when(k % 53 == 0, "D9").otherwise("D1").alias("rule"))
    binding = [*P.EXECUTION_KEYS, "verdict"]
    attempts = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey").join(o.select("o_orderkey", "o_custkey"), "o_orderkey").select(
        *[F.expr(_EVIDENCE[n]).alias(n) for n in binding], F.concat("o_orderkey", F.lit("-"), "l_linenumber").alias("attempt_id"), (F.col("l_quantity") > 15).alias("executed"),
        F.when(F.col("l_discount") > 0.02, "verified").otherwise("invalid").alias("signature_status"), F.lit("approved").alias("approval_status"), F.concat(F.lit("ev"), "o_orderkey").alias("evidence_digest"),
    ).withColumn("verdict", F.when(F.col("verdict") == "not-reproduced", "not_reproduced").otherwise(F.col("verdict")))
    return P.audit_release_evidence(evidence, subjects, observations, attempts)


# --------------------------------------------------------------------------- projections
@query(
    "check_payload",
    """WITH d AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 8 = 1 THEN 'short' ELSE left(sha256(o_orderkey::VARCHAR), 40) END AS commit_sha, CASE WHEN o_orderkey % 8 = 2 THEN 'x' ELSE 'sha256:' || sha256('m' || o_orderkey) END AS md,
 CASE WHEN o_orderkey % 8 = 3 THEN 'https://u@h/x' ELSE 'https://rec.example/' || o_orderkey END AS url, CASE WHEN o_orderkey % 8 = 4 THEN 'none' ELSE 'urn:x:sha256:' || sha256('s' || o_custkey) END AS sid,
 'urn:x:sha256:' || sha256(CASE WHEN o_orderkey % 8 = 5 THEN 'other' ELSE 's' || o_custkey END) AS eid, CASE WHEN o_orderstatus = 'F' THEN 'BLOCK' ELSE 'PASS' END AS dec FROM orders),
r AS (SELECT *, CASE k % 8 WHEN 1 THEN 'commit_invalid' WHEN 2 THEN 'manifest_digest_invalid' WHEN 3 THEN 'record_url_invalid' WHEN 4 THEN 'subject_invalid' WHEN 5 THEN 'subject_digest_mismatch' ELSE 'ok' END AS reason FROM d),
x AS (SELECT *, left(sha256(to_json({'commit': commit_sha, 'manifestDigest': md, 'subjectId': sid})), 32) AS ek, 'Decision ' || dec || '; subject ' || right(sid, 71) || '; policy p@1.0.0.' AS s FROM r)
SELECT commit_sha, reason, CASE WHEN reason = 'ok' THEN ek END AS external_key, CASE WHEN reason = 'ok' THEN s END AS summary, CASE WHEN reason = 'ok' THEN 'sha256:' || sha256(to_json({'commit': commit_sha, 'decision': dec,
 'externalKey': ek, 'policy': 'pd', 'record': url, 'subject': sid, 'summary': s})) END AS payload_digest FROM x""",
)
def check_payload(spark: SparkSession, sf: str) -> DataFrame:
    return P.check_payload(release_decisions(spark, sf))


def release_decisions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    m = k % 8
    subject = F.concat(F.lit("s"), F.col("o_custkey").cast("string"))
    return table(spark, sf, "orders").select(
        F.when(m == 1, "short").otherwise(F.substring(F.sha2(k.cast("string"), 256), 1, 40)).alias("commit_sha"),
        F.when(m == 2, "x").otherwise(sha256_tag(F.concat(F.lit("m"), k.cast("string")))).alias("manifest_digest"),
        F.when(m == 3, "https://u@h/x").otherwise(F.concat(F.lit("https://rec.example/"), k.cast("string"))).alias("record_url"),
        F.when(m == 4, "none").otherwise(F.concat(F.lit("urn:x:"), sha256_tag(subject))).alias("subject_id"),
        F.concat(F.lit("urn:x:"), sha256_tag(F.when(m == 5, "other").otherwise(subject))).alias("evaluation_subject_id"),
        F.when(F.col("o_orderstatus") == "F", "BLOCK").otherwise("PASS").alias("decision"), F.lit("p").alias("policy_id"),
        F.lit("1.0.0").alias("policy_version"), F.lit("pd").alias("policy_digest"),
    )


@query(
    "release_header",
    """WITH s AS (SELECT l_orderkey AS k, max(CASE WHEN l_linenumber = 1 THEN 'u' || l_partkey END) AS p, count(*) AS n, list_sort(list('Verified subject payload is unavailable for u' || l_partkey || '.') FILTER (l_tax > 0.06)) AS miss
 FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_tax FROM lineitem) GROUP BY 1)
SELECT k AS decision_id, d AS decision, p AS subject_id, n::INT AS n_subjects, CASE WHEN d = 'INCOMPLETE' OR coalesce(len(miss), 0) > 0 THEN 'incomplete' ELSE 'not-established' END AS coverage_status,
 list_sort(list_distinct(coalesce(miss, []::VARCHAR[]) || ['known gap'])) AS limitations, CASE WHEN d = 'PASS' THEN 'preserve' ELSE 'review' END AS next_action FROM (SELECT s.*, CASE o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'O' THEN
 'INCOMPLETE' ELSE 'BLOCK' END AS d FROM s JOIN orders ON k = o_orderkey) s""",
)
def release_header(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_tax").distinct()
    subjects = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.concat(F.lit("u"), F.col("l_partkey").cast("string")).alias("subject_id"),
                    F.when(F.col("l_linenumber") == 1, "primary").otherwise("other").alias("role"),
                    F.when(F.col("l_tax") <= 0.06, "m").alias("member_digest"),
                )
            ),
            lambda a, b: F.when(a["subject_id"] < b["subject_id"], 1).when(a["subject_id"] > b["subject_id"], -1).otherwise(0),
        ).alias("subjects")
    )
    j = table(spark, sf, "orders").join(subjects, "o_orderkey")
    rows = j.select(
        F.col("o_orderkey").alias("decision_id"),
        F.when(F.col("o_orderstatus") == "F", "PASS").when(F.col("o_orderstatus") == "O", "INCOMPLETE").otherwise("BLOCK").alias("decision"),
        "subjects", F.array(F.lit("known gap")).alias("limitations"),
    )
    return P.release_header(rows).withColumn("limitations", F.array_sort("limitations"))


@query(
    "evidence_projection",
    "SELECT l_orderkey, l_linenumber, l_partkey, 'p' || (l_suppkey % 5) AS producer_id, l_returnflag AS rule, 'native' AS coverage_class FROM lineitem",
)
def evidence_projection(spark: SparkSession, sf: str) -> DataFrame:
    from assayline.sources.evidence import observation_rows

    li = table(spark, sf, "lineitem")
    obs = observation_rows(
        li, observation_id=F.concat_ws("/", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")), producer_id=F.concat(F.lit("p"), (F.col("l_suppkey") % 5).cast("string")),
        rule=F.col("l_returnflag"), coverage_class="native",
    )
    parts = F.split("observation_id", "/")
    return P.evidence_projection(obs).select(
        parts[0].cast("bigint").alias("l_orderkey"), parts[1].cast("int").alias("l_linenumber"), parts[2].cast("bigint").alias("l_partkey"), "producer_id", "rule",
        "coverage_class",
    )
