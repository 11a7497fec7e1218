"""Study and release-bookkeeping queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.operators import studies as T
from assayline.operators.rules import RULES
from workloads import query
from workloads.bindings import pick, quote, rx, sql_list, sql_pick, table
from workloads.findings_score import TABLE_FINDINGS_CTE, table_findings
from workloads.policies import _list


@query(
    "rule_triage",
    "WITH " + TABLE_FINDINGS_CTE + " SELECT rule, count(*)::BIGINT AS observed, list_sort(list(DISTINCT severity)) AS severities FROM findings GROUP BY 1",
)
def rule_triage(spark: SparkSession, sf: str) -> DataFrame:
    return T.rule_triage(table_findings(spark, sf))


@query(
    "coverage_triage",
    "SELECT c_custkey AS repo_id, CASE WHEN c_nationkey % 3 > 0 AND c_mktsegment <> 'BUILDING' THEN 'no-coverage-gap-observed' ELSE 'coverage-gap-requires-review' END AS triage FROM customer",
)
def coverage_triage(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("repo_id"), F.when(F.col("c_nationkey") % 3 > 0, "complete").otherwise("incomplete").alias("status"),
        F.when(F.col("c_mktsegment") == "BUILDING", 2).otherwise(0).alias("n_limitations"),
    )
    return T.coverage_triage(rows)


_META = ", ".join(
    f"({quote(r.rule)}, {quote(r.category)}, {quote(r.title)}, {'NULL' if callable(r.severity) else quote(r.severity)})" for r in RULES
)


@query(
    "explain_rules",
    "WITH " + TABLE_FINDINGS_CTE + f", m(rule, c, t, s) AS (VALUES {_META}) SELECT label, f.rule, c AS rule_category, t AS rule_title, s AS rule_severity FROM findings f LEFT JOIN m ON m.rule = f.rule",
)
def explain_rules(spark: SparkSession, sf: str) -> DataFrame:
    return T.explain_rules(table_findings(spark, sf)).select("label", "rule", "rule_category", "rule_title", "rule_severity")


# --------------------------------------------------------------------------- reviews: the two label columns are two reviewers
_L = ["confirmed", "not-reproduced", "environment-failure", "out-of-scope"]


def _reviews(spark: SparkSession, sf: str) -> DataFrame:
    lab = table(spark, sf, "labels")

    def one(col: str, hour: int) -> DataFrame:
        return lab.select(
            F.col("doc_id").alias("sample_id"), F.lit(col).alias("reviewer"), pick(_L, (F.col(col) + F.col("doc_id") % 3).cast("int")).alias("label"),
            (F.col("doc_id") * 10 + hour).alias("reviewed_at"),
        )

    return one("quality", 1).unionByName(one("toxic", 2))


def _resolutions(spark: SparkSession, sf: str) -> DataFrame:
    lab = table(spark, sf, "labels")
    split = F.col("quality") != F.col("toxic")
    return lab.where(split | (F.col("doc_id") % 11 == 1)).select(
        F.col("doc_id").alias("sample_id"), F.lit("confirmed").alias("resolved_label"),
        (F.col("doc_id") * 10 + F.when(F.col("doc_id") % 7 == 1, 2).otherwise(5)).alias("resolved_at"),
    )


_REV = f"""rev AS (SELECT doc_id, {sql_pick(_L, 'quality + doc_id % 3')} AS a, {sql_pick(_L, 'toxic + doc_id % 3')} AS b FROM labels),
res AS (SELECT doc_id, doc_id * 10 + CASE WHEN doc_id % 7 = 1 THEN 2 ELSE 5 END AS at_t FROM labels WHERE (quality <> toxic OR doc_id % 11 = 1)),
adj AS (SELECT r.doc_id AS sample_id, CASE WHEN a <> b THEN CASE WHEN s.doc_id IS NOT NULL THEN 'confirmed' END ELSE a END AS final_label, a <> b AS disagreement, CASE WHEN a <> b AND s.doc_id IS NULL THEN 'unresolved disagreement'
 WHEN a <> b AND at_t <= r.doc_id * 10 + 2 THEN 'resolution before labels were frozen' WHEN a = b AND s.doc_id IS NOT NULL THEN 'resolution without disagreement' END AS issue FROM rev r LEFT JOIN res s USING (doc_id))"""


@query("adjudicate_reviews", f"WITH {_REV} SELECT * FROM adj")
def adjudicate_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return T.adjudicate_reviews(_reviews(spark, sf), _resolutions(spark, sf))


@query(
    "adjudication_summary",
    f"WITH {_REV} SELECT count(*)::BIGINT AS samples, count(*) FILTER (final_label <> 'out-of-scope')::BIGINT AS valid_samples, count(*) FILTER (disagreement)::BIGINT AS disagreements, count(issue)::BIGINT AS issues, "
    + ", ".join(f"count(*) FILTER (final_label = '{n}')::BIGINT AS {n.replace('-', '_')}" for n in _L)
    + ", count(*) FILTER (final_label <> 'out-of-scope') >= 100 AS enough FROM adj",
)
def adjudication_summary(spark: SparkSession, sf: str) -> DataFrame:
    return T.adjudication_summary(T.adjudicate_reviews(_reviews(spark, sf), _resolutions(spark, sf)))


# the same reviews with what a study records of them
_DET = ["injection", "secrets", "deep-auth"]
_REV2 = f"""w AS (SELECT doc_id, {sql_pick(_DET, 'doc_id % 3')} AS detector, a, b, a <> b AS split FROM (SELECT doc_id, {sql_pick(_L, 'quality + doc_id % 3')} AS a, {sql_pick(_L, 'toxic + doc_id % 3')} AS b FROM labels)),
r AS (SELECT doc_id, 'quality' AS reviewer, doc_id * 10 + 1 AS t, 1 AS h FROM labels UNION ALL SELECT doc_id, 'toxic', doc_id * 10 + 2, 2 FROM labels),
per AS (SELECT doc_id, count(*) AS reviews, {', '.join(f"count(*) FILTER ((doc_id + h) % 3 = {i})::BIGINT AS {c}" for i, c in enumerate(T.CONFIDENCES))}, count(*) FILTER (doc_id % 5 = h)::BIGINT AS changed,
 count(*) FILTER (doc_id % 6 = h)::BIGINT AS limited, count(*) FILTER (doc_id % 8 = h) AS unexplained FROM r WHERE NOT (h = 2 AND doc_id % 97 = 5) GROUP BY 1),
res AS (SELECT doc_id, doc_id * 10 + CASE WHEN doc_id % 7 = 1 THEN 2 ELSE 5 END AS t, CASE WHEN doc_id % 9 = 0 THEN 'out-of-scope' ELSE 'confirmed' END AS lab, doc_id % 2 = 0 AS third, doc_id % 3 > 0 AND NOT (doc_id % 3 = 2 AND doc_id % 97 = 5) AS own, doc_id % 4 = 0 AS bare FROM labels WHERE quality <> toxic OR doc_id % 11 = 1),
adj AS (SELECT w.doc_id AS sample_id, detector, CASE WHEN sp THEN lab ELSE a END AS final_label, sp AS disagreement, reviews::BIGINT AS reviews, low, medium, high, changed, limited, {_list([
    ("reviews <> 2", "wrong number of reviews"), ("sp AND t IS NULL", "unresolved disagreement"), ("sp AND t <= w.doc_id * 10 + 2", "resolution before labels were frozen"), ("sp AND third AND own", "third reviewer is not independent"),
    ("NOT sp AND t IS NOT NULL", "resolution without disagreement"), ("CASE WHEN sp THEN lab ELSE a END = 'out-of-scope' AND CASE WHEN sp THEN bare ELSE unexplained > 0 END", "exclusion without a reason"),
])} AS issues FROM (SELECT *, split AND doc_id % 97 <> 5 AS sp FROM w) w JOIN per USING (doc_id) LEFT JOIN res USING (doc_id))"""


def _adjudicated(spark: SparkSession, sf: str) -> DataFrame:
    d, lab = F.col("sample_id"), table(spark, sf, "labels")
    hour = F.when(F.col("reviewer") == "quality", 1).otherwise(2)
    reviews = _reviews(spark, sf).where(~((F.col("reviewer") == "toxic") & (d % 97 == 5))).select(
        "*", pick(T.CONFIDENCES, F.pmod(d + hour, F.lit(3)).cast("int")).alias("confidence"), (d % 5 == hour).alias("changed_finding"),
        F.when(d % 6 == hour, "cut off").alias("limitation"), F.when(d % 8 != hour, "why").alias("exclusion_reason"),
    )
    resolutions = _resolutions(spark, sf).select(
        "sample_id", F.when(d % 9 == 0, "out-of-scope").otherwise("confirmed").alias("resolved_label"), "resolved_at",
        F.when(d % 2 == 0, "third-reviewer").otherwise("documented-consensus").alias("method"), pick(["r3", "author", "toxic"], (d % 3).cast("int")).alias("reviewer"),
        F.when(d % 4 != 0, "w").alias("exclusion_reason"),
    )
    samples = lab.select(F.col("doc_id").alias("sample_id"), pick(_DET, (F.col("doc_id") % 3).cast("int")).alias("detector"))
    return T.adjudicated_samples(samples, reviews, resolutions, author="author")


@query("adjudicated_samples", f"WITH {_REV2} SELECT * FROM adj")
def adjudicated_samples(spark: SparkSession, sf: str) -> DataFrame:
    return _adjudicated(spark, sf)


@query(
    "adjudication_report",
    f"WITH {_REV2} SELECT detector, count(*)::BIGINT AS samples, count(*) FILTER (final_label IS DISTINCT FROM 'out-of-scope')::BIGINT AS denominator, "
    + ", ".join(f"count(*) FILTER (final_label = '{n}')::BIGINT AS {n.replace('-', '_')}" for n in _L) + ", count(*) FILTER (disagreement)::BIGINT AS disagreements, "
    + ", ".join(f"sum({c})::BIGINT AS {c}" for c in (*T.CONFIDENCES, "changed", "limited"))
    + ", count(*) FILTER (len(issues) > 0)::BIGINT AS issues, denominator >= 100 AND count(*) FILTER (len(issues) > 0) = 0 AS valid, CASE WHEN grouping(detector) = 1 THEN 'study' ELSE 'detector' END AS scope FROM adj GROUP BY ROLLUP (detector)",
)
def adjudication_report(spark: SparkSession, sf: str) -> DataFrame:
    return T.adjudication_report(_adjudicated(spark, sf))


@query("resolution_after_reviews", f"WITH {_REV} SELECT doc_id AS sample_id, at_t > doc_id * 10 + 2 AS ok FROM res")
def resolution_after_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return T.resolution_after_reviews(_reviews(spark, sf), _resolutions(spark, sf))


# --------------------------------------------------------------------------- answers: conversations are participants
_RUBRIC = {
    "0": [["the", "der", "que"], ["and", "und"]], "1": [["is", "ist", "est"]], "2": [["of", "von"], ["on", "un"]], "3": [["in"], ["an"]],
    "4": [["re"], ["to", "zu"]], "5": [["er"]],
}
_FORBIDDEN = ["token", "http"]


def _norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"


def _group_sql(parts: list[list[str]]) -> str:
    return " + ".join("(" + " OR ".join(f"contains(t, '{w}')" for w in p) + ")::INT" for p in parts)


_ANS = (
    f"a AS (SELECT conv_id AS participant_id, (turn % 6)::VARCHAR AS question_id, {_norm('text')} AS t FROM conversations), s AS (SELECT participant_id, question_id, (CASE question_id "
    + " ".join(f"WHEN '{q}' THEN {_group_sql(p)}" for q, p in _RUBRIC.items()) + " END)::INT AS groups_hit, ("
    + " + ".join(f"contains(t, '{w}')::INT" for w in _FORBIDDEN) + ")::INT AS forbidden_hits, CASE question_id " + " ".join(f"WHEN '{q}' THEN {len(p)}" for q, p in _RUBRIC.items())
    + " END AS need FROM a), sc AS (SELECT participant_id, question_id, groups_hit, forbidden_hits, groups_hit = need AND forbidden_hits = 0 AS correct FROM s)"
)


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("participant_id"), (F.col("turn") % 6).cast("string").alias("question_id"), F.col("text").alias("answer")
    )


@query("score_answers", f"WITH {_ANS} SELECT * FROM sc")
def score_answers(spark: SparkSession, sf: str) -> DataFrame:
    return T.score_answers(_answers(spark, sf), _RUBRIC, _FORBIDDEN)


@query(
    "score_participants",
    f"WITH {_ANS} SELECT participant_id, count(*) FILTER (correct)::BIGINT AS correct_answers, count(*)::BIGINT AS answers, sum(forbidden_hits)::BIGINT AS forbidden_hits, count(*) FILTER (correct) >= 2 AND "
    "sum(forbidden_hits) = 0 AS passed FROM sc GROUP BY 1",
)
def score_participants(spark: SparkSession, sf: str) -> DataFrame:
    return T.score_participants(T.score_answers(_answers(spark, sf), _RUBRIC, _FORBIDDEN), 2)


# --------------------------------------------------------------------------- gates and regressions
@query(
    "gate_reconcile",
    "WITH r AS (SELECT o_custkey AS k, count(*) FILTER (o_orderstatus = 'F' OR o_custkey % 2 = 0) AS a, count(*) FILTER (o_orderstatus = 'O' AND o_custkey % 2 = 1) AS b, count(*) FILTER (o_orderstatus = 'P' AND o_custkey % 2 = 1) AS c "
    "FROM orders GROUP BY 1), g AS (SELECT c_custkey AS k, count(*) FILTER (c_mktsegment = 'BUILDING') AS n FROM customer GROUP BY 1), w AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' "
    "GROUP BY 1) SELECT r.k AS candidate, a::BIGINT AS shipped, b::BIGINT AS partial, c::BIGINT AS planned, coalesce(g.n, 0)::BIGINT AS open_gates, coalesce(w.n, 0)::BIGINT AS open_work, b = 0 AND c = 0 AND coalesce(g.n, "
    "0) = 0 AND coalesce(w.n, 0) = 0 AS go_eligible FROM r LEFT JOIN g USING (k) LEFT JOIN w USING (k)",
)
def gate_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    even = F.col("o_custkey") % 2 == 0
    rows = o.select(
        F.col("o_custkey").alias("candidate"),
        F.when((F.col("o_orderstatus") == "F") | even, "shipped").when(F.col("o_orderstatus") == "O", "partial").otherwise("planned").alias("state"),
    )
    gates = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("candidate"), F.when(F.col("c_mktsegment") == "BUILDING", "open").otherwise("closed").alias("state")
    )
    work = o.select(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey")).otherwise(-F.col("o_custkey") - 1).alias("candidate"))
    return T.gate_reconcile(rows, gates, work, ["candidate"])


_RUNS = {
    "scenario": "l_orderkey * 10 + l_linenumber", "baseline_findings": "l_partkey % 20", "candidate_findings": "l_suppkey % 20", "baseline_files": "l_partkey % 50",
    "candidate_files": "l_partkey % 50 + l_linenumber % 3", "baseline_ms": "CASE WHEN l_linenumber = 7 THEN 0 ELSE l_partkey % 700 + 10 END", "candidate_ms": "l_quantity * 15",
    "candidate_status": "CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'failed' ELSE 'passed' END", "candidate_coverage": "CASE WHEN l_tax > 0.07 THEN 'limited' ELSE 'complete' END",
}
_RUN_CTE = "runs AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _RUNS.items()) + """ FROM lineitem), d AS (SELECT scenario, candidate_findings - baseline_findings AS finding_delta, candidate_files - baseline_files AS files_delta,
 (candidate_ms - baseline_ms)::DOUBLE AS duration_delta_ms, CASE WHEN baseline_ms = 0 THEN CASE WHEN candidate_ms > 0 THEN NULL ELSE 0 END ELSE round((candidate_ms - baseline_ms) / baseline_ms * 100, 3) END::DOUBLE AS duration_delta_percent,
 CASE WHEN baseline_ms = 0 THEN candidate_ms > 0 ELSE round((candidate_ms - baseline_ms) / baseline_ms * 100, 3) > 20 END AS performance_regression, candidate_findings > baseline_findings AS finding_regression,
 candidate_status <> 'passed' OR candidate_coverage <> 'complete' AS failed FROM runs)"""


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(*[F.expr(e).alias(n) for n, e in _RUNS.items()])


@query("regression_compare", f"WITH {_RUN_CTE} SELECT * FROM d")
def regression_compare(spark: SparkSession, sf: str) -> DataFrame:
    return T.regression_compare(_runs(spark, sf), 20)


@query(
    "regression_summary",
    f"WITH {_RUN_CTE} SELECT count(*)::BIGINT AS runs, count(*) FILTER (failed)::BIGINT AS n_failed, count(*) FILTER (performance_regression)::BIGINT AS n_performance_regression, count(*) FILTER "
    "(finding_regression)::BIGINT AS n_finding_regression, sum(finding_delta)::BIGINT AS total_finding_delta, sum(duration_delta_ms)::DOUBLE AS total_duration_delta_ms, false AS go_eligible FROM d",
)
def regression_summary(spark: SparkSession, sf: str) -> DataFrame:
    return T.regression_summary(T.regression_compare(_runs(spark, sf), 20))


_PLANS, _ROLES, _TENANTS = ["free", "pro", "team"], ["owner", "member"], ["single", "multi"]


@query(
    "scenario_matrix_gaps",
    f"WITH f AS (SELECT DISTINCT p_brand AS fixture FROM part), e AS (SELECT fixture, plan, role, tenant FROM f, (SELECT unnest({sql_list(_PLANS)}) AS plan), (SELECT unnest({sql_list(_ROLES)}) AS role), (SELECT "
    f"unnest({sql_list(_TENANTS)}) AS tenant)) SELECT * FROM e EXCEPT SELECT p_brand, CASE WHEN p_type = 'SMALL' THEN {sql_pick(_PLANS, 'p_partkey % 3')} ELSE 'trial' END, {sql_pick(_ROLES, 'p_size % 2')}, {sql_pick(_TENANTS, '(p_partkey // 7) % 2')} FROM part",
)
def scenario_matrix_gaps(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    plan = F.when(F.col("p_type") == "SMALL", pick(_PLANS, F.col("p_partkey") % 3)).otherwise("trial")
    runs = p.select(
        F.col("p_brand").alias("fixture"), plan.alias("plan"), pick(_ROLES, F.col("p_size") % 2).alias("role"),
        pick(_TENANTS, F.expr("p_partkey div 7") % 2).alias("tenant"),
    )
    return T.scenario_matrix_gaps(p.select(F.col("p_brand").alias("fixture")), _PLANS, _ROLES, _TENANTS, runs)


@query(
    "holdout_leakage",
    """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority < '3' AS high, CASE WHEN c_nationkey % 4 = 0 THEN 'holdout' ELSE 'train' END AS side, o_orderdate AS d FROM orders JOIN customer ON o_custkey = c_custkey),
r AS (SELECT o_orderkey AS k, o_orderdate AS at_t FROM orders WHERE o_orderstatus <> 'P'),
a AS (SELECT o.k, side, at_t FROM o LEFT JOIN r USING (k) WHERE high),
cx AS (SELECT l_partkey AS c, l_orderkey AS k, l_shipdate AS at_t FROM lineitem),
u AS (SELECT cx.c, o.k IS NULL AS unknown, side, at_t FROM (SELECT c, CASE WHEN c % 97 = 0 THEN -1 ELSE k END AS k, at_t FROM cx) cx LEFT JOIN o USING (k))
SELECT k::VARCHAR AS id, 'high-impact observation without review' AS issue FROM a WHERE at_t IS NULL UNION SELECT k::VARCHAR, 'training review after freeze' FROM a WHERE side = 'train' AND at_t > TIMESTAMP '1997-01-01' UNION
SELECT k::VARCHAR, 'holdout review before freeze' FROM a WHERE side = 'holdout' AND at_t < TIMESTAMP '1997-01-01' UNION SELECT 'x' || c, 'correction references an unknown observation' FROM u WHERE unknown UNION
SELECT 'x' || c, 'correction references a holdout observation' FROM u WHERE side = 'holdout' UNION SELECT 'x' || c, 'correction after freeze' FROM u WHERE at_t > TIMESTAMP '1997-01-01'""",
)
def holdout_leakage(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    observations = o.select(
        F.col("o_orderkey").alias("observation_id"), F.col("o_custkey").alias("fixture"), F.when(F.col("o_orderpriority") < "3", "high").otherwise("low").alias("impact")
    )
    split = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("fixture"), F.when(F.col("c_nationkey") % 4 == 0, "holdout").otherwise("train").alias("side")
    )
    reviews = o.select(F.expr("CASE WHEN o_orderstatus <> 'P' THEN o_orderkey ELSE -o_orderkey - 2 END").alias("observation_id"), F.col("o_orderdate").alias("reviewed_at"))
    corrections = table(spark, sf, "lineitem").select(
        F.concat(F.lit("x"), F.col("l_partkey").cast("string")).alias("correction_id"),
        F.when(F.col("l_partkey") % 97 == 0, F.lit(-1).cast("bigint")).otherwise(F.col("l_orderkey")).alias("observation_id"),
        F.col("l_shipdate").alias("created_at"),
    )
    return T.holdout_leakage(observations, split, reviews, corrections, F.lit("1997-01-01").cast("timestamp_ntz"))


@query(
    "missing_surfaces",
    "WITH s AS (SELECT DISTINCT p_partkey AS story_id, unnest(['L' || p_size, 'L' || (p_size + p_partkey % 9), 'M' || (p_partkey % 3)]) AS label FROM part), e AS (SELECT DISTINCT 'L' || (l_quantity::INT) AS label FROM lineitem WHERE l_discount > 0.09 AND l_tax "
    "> 0.07 AND l_returnflag = 'A' AND l_quantity < 30 UNION SELECT 'M1') SELECT story_id, label FROM s WHERE label NOT IN (SELECT label FROM e)",
)
def missing_surfaces(spark: SparkSession, sf: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")

    def tag(letter: str, x: F.Column) -> F.Column:
        return F.concat(F.lit(letter), x.cast("string"))

    part = table(spark, sf, "part")
    stories = part.select(key.alias("story_id"), F.array(tag("L", size), tag("L", size + key % 9), tag("M", key % 3)).alias("required"))
    # What was not executed has a label that no story asks for.
    ran = F.expr("l_discount > 0.09 AND l_tax > 0.07 AND l_returnflag = 'A' AND l_quantity < 30")
    executed = table(spark, sf, "lineitem").select(F.when(ran, tag("L", F.col("l_quantity").cast("int"))).otherwise("idle").alias("label")).union(
        part.select(F.when(key % 3 == 1, tag("M", key % 3)).otherwise("idle").alias("label"))
    )
    return T.missing_surfaces(stories, executed)


_MAN = (
    "concat('{\"main\":\"./dist/', p_size % 5, '.js\",\"bin\":{\"x\":\"', CASE WHEN p_partkey % 4 = 0 THEN 'dist/x.js' ELSE './../x.js' END, '\"},\"exports\":{\".\":{\"import\":\"./esm/', p_size % 3, '.mjs\",\"require\":[\"./cjs/a.js\",\"./dist/0.js\"]},"
    "\"./deep\":{\"node\":{\"default\":\"./deep/', p_partkey % 3, '.js\"}}}}')"
)


@query(
    "missing_entrypoints",
    """WITH m AS (SELECT p_partkey AS package, p_size % 5 AS a, p_size % 3 AS b, p_partkey % 3 AS c, p_partkey % 4 AS d, p_partkey % 2 = 0 AS even FROM part),
t AS (SELECT package, even, 'main' AS field, 'dist/' || a || '.js' AS path FROM m UNION ALL SELECT package, even, 'exports...import', 'esm/' || b || '.mjs' FROM m UNION ALL SELECT package, even, 'exports...require[0]', 'cjs/a.js' FROM m UNION ALL
SELECT package, even, 'exports...require[1]', 'dist/0.js' FROM m UNION ALL SELECT package, even, 'exports../deep.node.default', 'deep/' || c || '.js' FROM m)
SELECT package, field, 'missing file ' || path AS issue FROM t WHERE NOT (path IN ('dist/0.js', 'dist/1.js') OR (even AND path IN ('cjs/a.js', 'esm/1.mjs', 'deep/1.js')))
UNION ALL SELECT package, 'bin.x', CASE WHEN d = 0 THEN 'must be a package-relative path' ELSE 'escapes the package root' END FROM m""",
)
def missing_entrypoints(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    manifests = part.select(F.col("p_partkey").alias("package"), F.expr(_MAN).alias("content"))
    some = F.array(*[F.lit(p) for p in ("dist/0.js", "dist/1.js")])
    more = F.array(*[F.lit(p) for p in ("dist/0.js", "dist/1.js", "cjs/a.js", "esm/1.mjs", "deep/1.js")])
    files = part.select(F.col("p_partkey").alias("package"), F.explode(F.when(F.col("p_partkey") % 2 == 0, more).otherwise(some)).alias("path"))
    return T.missing_entrypoints(manifests, files)


_CHECK_DOC = (
    "concat('# list\\n- [x] **AREA-', event_id % 7, '** done. Evidence: x\\n- [ ] plain item ', event_id % 3, '. Evidence: none\\n* [x] other\\n', CASE WHEN event_type = 'error' THEN '- [X] **GATE** ok\\r\\n' ELSE '- [ ] **GATE** no\\n' END)"
)


@query(
    "checklist_rows",
    "SELECT event_id AS doc_id, 2::INT AS line_no, true AS checked, 'AREA-' || (event_id % 7) AS key FROM events UNION ALL SELECT event_id, 3, false, 'plain item ' || (event_id % 3) || '' FROM events UNION ALL SELECT event_id, 5, event_type = 'error', 'GATE' FROM events",
)
def checklist_rows(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.expr(_CHECK_DOC).alias("text"))
    return T.checklist_rows(docs)


@query(
    "checklist_audit",
    "SELECT event_id AS doc_id, (1 + (event_type = 'error')::INT)::BIGINT AS checked, (2 - (event_type = 'error')::INT)::BIGINT AS open, CASE WHEN event_type = 'error' THEN 66.7 ELSE 33.3 END::DOUBLE AS percent, 1::BIGINT AS unmapped_open FROM events",
)
def checklist_audit(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.expr(_CHECK_DOC).alias("text"))
    return T.checklist_audit(T.checklist_rows(docs), {"AREA-": "area", "GATE": "gate"})


_KINDS = ["signup", "purchase", "click", "refund"]


@query(
    "evidence_kind_rollup",
    "WITH e AS (SELECT user_id % 40 AS k, event_type AS kind, event_id // (1 + (user_id % 40) % 2) AS digest FROM events), a AS (SELECT k, count(*) AS n, count(DISTINCT digest) AS d, "
    + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _KINDS)
    + " FROM e GROUP BY 1) SELECT k AS study, n::BIGINT AS events, d::BIGINT AS distinct_digests, " + ", ".join(f"n_{k}::BIGINT AS n_{k}" for k in _KINDS) + ", "
    + _list([*[(f"n_{k} = 0", f"missing {k}") for k in _KINDS], ("n_purchase < 40", "too few repeat-use records"), ("d <> n", "digests are not distinct")]) + " AS issues FROM a",
)
def evidence_kind_rollup(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("user_id") % 40
    events = table(spark, sf, "events").select(
        k.alias("study"), F.col("event_type").alias("kind"), F.expr("event_id div (1 + (user_id % 40) % 2)").alias("digest")
    )
    return T.evidence_kind_rollup(events, ["study"], _KINDS, "purchase", 40)


_DENY = [r"^docs/shipping(?:/|$)", r"\.env$", r"(?:^|/)secrets?/"]
_DP = ["docs/shipping/a.md", "src/a.ts", "docs/shipping", "x/.env", "lib/secrets/k", "docs/shippingx", "secret/z"]


@query(
    "forbidden_paths",
    f"WITH p AS (SELECT {sql_pick(_DP, f'doc_id % {len(_DP)}')} || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '/' || (doc_id % 100) END AS path FROM documents UNION SELECT source || '/.env' FROM documents) SELECT path FROM p WHERE regexp_matches(path, "
    f"{rx('|'.join(f'(?:{d})' for d in _DENY))})",
)
def forbidden_paths(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    tail = F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.concat(F.lit("/"), (F.col("doc_id") % 100).cast("string")))
    current = docs.select(F.concat(pick(_DP, F.pmod("doc_id", F.lit(len(_DP)))), tail).alias("path"))
    return T.forbidden_paths(current, docs.select(F.concat("source", F.lit("/.env")).alias("path")), _DENY)


_WF = {
    "outcome": "CASE WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'passed' END", "exit_code": "o_orderkey % 5", "coverage": "CASE WHEN o_orderstatus = 'P' THEN 'limited' ELSE 'complete' END",
    "n_limitations": "o_custkey % 2", "preflight_ok": "o_orderpriority <> '5-LOW'", "summary_delivered": "o_custkey % 3 > 0", "disposition": "CASE o_custkey % 4 WHEN 0 THEN 'kept' WHEN 1 THEN 'expired' ELSE 'deleted' END",
    "deletion_status": "CASE WHEN o_orderkey % 3 = 0 THEN 'pending' ELSE 'confirmed' END", "may_store": "o_orderkey % 2 = 0",
    "retention": "CASE o_orderkey % 7 WHEN 0 THEN 'raw' WHEN 1 THEN 'redacted' ELSE 'digest-only' END",
}


@query(
    "workflow_acceptance",
    "WITH w AS (SELECT o_orderkey, " + ", ".join(f"{e} AS {n}" for n, e in _WF.items()) + " FROM orders), l AS (SELECT o_orderkey AS workflow_id, " + _list([
        ("outcome <> 'passed'", "workflow-outcome-failed"), ("exit_code <> 0", "command-exit-nonzero"), ("coverage <> 'complete' OR n_limitations > 0", "coverage-incomplete-or-limited"),
        ("NOT preflight_ok", "preflight-not-passed"), ("NOT summary_delivered", "owner-summary-not-delivered"), ("disposition NOT IN ('deleted', 'expired')", "deletion-or-expiry-not-recorded"),
        ("deletion_status <> 'confirmed'", "deletion-or-expiry-not-confirmed"), ("NOT may_store AND retention <> 'digest-only'", "retention-exceeds-consent"), ("retention = 'raw'", "raw-artifact-retention-forbidden"),
    ]) + " AS reasons FROM w) SELECT workflow_id, len(reasons) = 0 AS accepted, reasons FROM l",
)
def workflow_acceptance(spark: SparkSession, sf: str) -> DataFrame:
    return T.workflow_acceptance(table(spark, sf, "orders").select(F.col("o_orderkey").alias("workflow_id"), *[F.expr(e).alias(n) for n, e in _WF.items()]))
