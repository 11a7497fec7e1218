"""Context, score, ordering and verdict queries.

Small end-to-end queries scan the generated code; table-sized ones read findings
derived from ``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.functions import text as T
from assayline.operators import context, project, score
from assayline.operators import rules as R
from assayline.operators.scan import finding_rows
from assayline.operators.spread import stride_sample
from workloads import query
from workloads.bindings import (
    CODE_LINES_CTE, PATH_SHAPES, REPO_DEPS_CTE, SHAPED_PATHS_CTE, code_files, pick, quote, repo_dependencies, rx,
    shaped_paths, sql_list, sql_pick, table,
)
from workloads.rule_pack import ALL_RULES, rules_sql, scanned

TEST_RX = rx("|".join(context.TEST_PATHS))
TAG_SQL = "(CASE " + " ".join(
    f"WHEN regexp_matches(file, {rx('|'.join([f'(?i:{p})' for p in ci] + [f'(?:{p})' for p in cs]))}) THEN '{t}'"
    for t, (ci, cs) in context.CONTEXT_TAGS.items()
) + " END)"

# --------------------------------------------------------------------------- findings from lineitem
F_RULES = ["D1-001", "AI-002", "D6-002", "AUTH-003", "D8-001", "D5-003", "API-001", "D4-001"]
F_DOMAINS = ["D1", "D2", "D3", "D4", "D5", "D6", "D7", "D8"]
F_LEVELS = ["certain", "high", "medium", "low"]
F_CONTEXTS = ["production", "placeholder", "enum", "production", "production"]


def _severity(q: str) -> str:
    return (
        f"CASE WHEN {q} > 47 THEN 'critical' WHEN {q} > 38 THEN 'high' WHEN {q} > 20 THEN 'medium' "
        f"WHEN {q} > 8 THEN 'low' ELSE 'info' END"
    )


def table_findings(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag"
    )
    ctx = F.when(
        F.col("l_returnflag") == "A", pick(F_CONTEXTS, F.pmod(F.col("l_partkey"), F.lit(len(F_CONTEXTS))))
    )
    return finding_rows(
        li,
        repo_id=F.concat(F.lit("s"), F.col("l_suppkey").cast("string")),
        detector="injection",
        rule=pick(F_RULES, F.pmod(F.col("l_partkey") + F.col("l_linenumber"), F.lit(len(F_RULES)))),
        domain=F.when(
            F.pmod(F.col("l_orderkey"), F.lit(11)) < 8,
            pick(F_DOMAINS, F.pmod(F.col("l_orderkey"), F.lit(11)) % len(F_DOMAINS)),
        ),
        severity=F.expr(_severity("l_quantity")),
        context=ctx,
        title=F.concat(F.lit("t"), F.col("l_linenumber").cast("string")),
        file=pick(PATH_SHAPES, F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(len(PATH_SHAPES)))),
        line=F.pmod(F.col("l_orderkey"), F.lit(400)) + 1,
        confidence_level=F.when(
            F.pmod(F.col("l_orderkey"), F.lit(3)) > 0,
            pick(F_LEVELS, F.pmod(F.col("l_partkey"), F.lit(len(F_LEVELS)))),
        ),
        confidence_score=F.when(F.pmod(F.col("l_orderkey"), F.lit(3)) == 0, F.round(F.col("l_discount") * 10, 2)),
        category=F.concat(F.lit("c"), F.pmod(F.col("l_partkey"), F.lit(6)).cast("string")),
        label=F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                          F.col("l_partkey").cast("string"), F.col("l_quantity").cast("string")),
    )


TABLE_FINDINGS_CTE = f"""
findings AS (
  SELECT 's' || l_suppkey AS repo_id, 'injection' AS detector,
    {sql_pick(F_RULES, f"(l_partkey + l_linenumber) % {len(F_RULES)}")} AS rule,
    CASE WHEN l_orderkey % 11 < 8 THEN {sql_pick(F_DOMAINS, f"(l_orderkey % 11) % {len(F_DOMAINS)}")} END AS domain,
    {_severity("l_quantity")} AS severity,
    CASE WHEN l_returnflag = 'A' THEN {sql_pick(F_CONTEXTS, f"l_partkey % {len(F_CONTEXTS)}")} END AS context,
    't' || l_linenumber AS title,
    {sql_pick(PATH_SHAPES, f"(l_orderkey + l_linenumber) % {len(PATH_SHAPES)}")} AS file,
    (l_orderkey % 400 + 1)::INT AS line,
    CASE WHEN l_orderkey % 3 > 0 THEN {sql_pick(F_LEVELS, f"l_partkey % {len(F_LEVELS)}")} END AS confidence_level,
    CASE WHEN l_orderkey % 3 = 0 THEN round(l_discount * 10, 2) END AS confidence_score,
    'c' || (l_partkey % 6) AS category,
    l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_quantity AS label,
    NULL::VARCHAR AS snippet
  FROM lineitem)"""


def gathered(cte: str, strict: bool = False) -> str:
    """filter -> classify -> tag, as CTEs ending in ``T``."""
    info = "CASE WHEN is_test THEN 'info' ELSE severity END" if not strict else "severity"
    tagged = "CASE WHEN tag IS NOT NULL THEN 'info' ELSE severity END" if not strict else "severity"
    return f"""{cte},
N AS (SELECT *, coalesce(confidence_score, CASE confidence_level WHEN 'certain' THEN .95 WHEN 'high' THEN .8
        WHEN 'medium' THEN .6 WHEN 'low' THEN .3 END) AS conf FROM findings),
K AS (SELECT *, regexp_matches(file, {TEST_RX}) AS is_test FROM N WHERE conf >= 0.7),
C AS (SELECT * REPLACE ({info} AS severity, CASE WHEN is_test THEN 'test' ELSE coalesce(context, 'production') END
        AS context) FROM K),
G AS (SELECT *, CASE WHEN rule = 'D6-002' THEN NULL ELSE {TAG_SQL} END AS tag FROM C),
T AS (SELECT * EXCLUDE (tag) REPLACE ({tagged} AS severity), tag AS context_tag,
        CASE WHEN tag IS NOT NULL THEN severity END AS original_severity FROM G)"""


def classified(findings: DataFrame, strict: bool = False) -> DataFrame:
    kept = context.min_confidence(findings)
    return context.apply_context_tags(context.classify_test_context(kept, strict), strict)


def score_sql(source: str, repos: str, strict: bool = False) -> str:
    ok = "NOT coalesce(context IN ('placeholder', 'enum'), false)"
    if not strict:
        ok += " AND coalesce(context, '') <> 'test' AND context_tag IS NULL"
    return f"""
S AS (SELECT *, ({ok}) AS ok, CASE WHEN confidence_score IS NOT NULL THEN
        CASE WHEN confidence_score >= .9 THEN 'certain' WHEN confidence_score >= .7 THEN 'high'
             WHEN confidence_score >= .5 THEN 'medium' ELSE 'low' END ELSE confidence_level END AS lvl FROM {source}),
P AS (SELECT repo_id, coalesce(domain, '__unknown__') AS d, severity, count(*) AS n FROM S
      WHERE ok AND lvl IN ('certain', 'high') AND severity <> 'info' GROUP BY ALL),
Q AS (SELECT repo_id, sum(least(n * CASE severity WHEN 'critical' THEN 15 WHEN 'high' THEN 6 WHEN 'medium' THEN 2
        ELSE .5 END, CASE severity WHEN 'critical' THEN 40 WHEN 'high' THEN 25 WHEN 'medium' THEN 15 ELSE 5 END)) AS p
      FROM P GROUP BY 1),
K2 AS (SELECT repo_id, count(*) FILTER (ok AND severity = 'critical') AS critical,
        count(*) FILTER (ok AND severity = 'high') AS high, count(*) FILTER (ok AND severity = 'medium') AS medium,
        count(*) FILTER (ok AND severity = 'low') AS low, count(*) FILTER (severity = 'info') AS info,
        count(*) AS n_findings FROM S GROUP BY 1),
R AS ({repos}),
V AS (SELECT repo_id, greatest(0, least(100, floor(100 - CASE WHEN coalesce(critical, 0) = 0 THEN
        least(coalesce(p, 0), 90) ELSE coalesce(p, 0) END + 0.5)))::INT AS score, coalesce(critical, 0)::BIGINT AS critical,
        coalesce(high, 0)::BIGINT AS high, coalesce(medium, 0)::BIGINT AS medium, coalesce(low, 0)::BIGINT AS low,
        coalesce(info, 0)::BIGINT AS info, coalesce(n_findings, 0)::BIGINT AS n_findings
      FROM R LEFT JOIN Q USING (repo_id) LEFT JOIN K2 USING (repo_id)),
scores AS (SELECT repo_id, score, CASE WHEN score < 50 THEN 'critical' WHEN score < 70 THEN 'high' WHEN score < 90
        THEN 'medium' ELSE 'low' END AS band, critical, high, medium, low, info, n_findings FROM V)"""


_SCAN_FINDINGS = (
    rules_sql(ALL_RULES)
    + ", findings AS (SELECT *, NULL::DOUBLE AS confidence_score, NULL::VARCHAR AS context, '' AS title FROM F)"
)


@query(
    "security_score",
    gathered(_SCAN_FINDINGS) + "," + score_sql("T", "SELECT DISTINCT repo_id FROM code_files") + " SELECT * FROM scores",
)
def security_score(spark: SparkSession, sf: str) -> DataFrame:
    """Scan, filter, classify, tag, score: the whole path from files to repositories."""
    repos = code_files(spark, sf).select("repo_id").distinct()
    return score.security_score(classified(scanned(spark, sf)), repos)


_TABLE = "WITH " + TABLE_FINDINGS_CTE
_ALL_REPOS = "SELECT DISTINCT repo_id FROM findings"


@query("security_score_table", gathered(_TABLE) + "," + score_sql("T", "SELECT DISTINCT repo_id FROM T")
       + " SELECT * FROM scores")
def security_score_table(spark: SparkSession, sf: str) -> DataFrame:
    return score.security_score(classified(table_findings(spark, sf)))


@query("security_score_strict", gathered(_TABLE, True) + "," + score_sql("T", "SELECT DISTINCT repo_id FROM T", True)
       + " SELECT * FROM scores")
def security_score_strict(spark: SparkSession, sf: str) -> DataFrame:
    return score.security_score(classified(table_findings(spark, sf), True), strict=True)


@query(
    "min_confidence",
    _TABLE + " SELECT repo_id, label, confidence_level, confidence_score FROM findings WHERE coalesce(confidence_score,"
    " CASE confidence_level WHEN 'certain' THEN .95 WHEN 'high' THEN .8 WHEN 'medium' THEN .6 ELSE .3 END) >= 0.7",
)
def min_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return context.min_confidence(table_findings(spark, sf)).select(
        "repo_id", "label", "confidence_level", "confidence_score"
    )


@query(
    "confidence_scale",
    "SELECT l_discount * 10 AS score, CASE WHEN l_discount * 10 >= .9 THEN 'certain' WHEN l_discount * 10 >= .7 THEN "
    "'high' WHEN l_discount * 10 >= .5 THEN 'medium' ELSE 'low' END AS level, CASE WHEN l_discount * 10 >= .9 THEN .95 "
    "WHEN l_discount * 10 >= .7 THEN .8 WHEN l_discount * 10 >= .5 THEN .6 ELSE .3 END::DOUBLE AS number, "
    "count(*)::BIGINT AS n FROM lineitem GROUP BY ALL",
)
def confidence_scale(spark: SparkSession, sf: str) -> DataFrame:
    from assayline.functions.severity import confidence_level, confidence_number

    s = F.col("l_discount") * 10
    return (
        table(spark, sf, "lineitem")
        .select(s.alias("score"), confidence_level(s).alias("level"))
        .withColumn("number", confidence_number(F.col("level")))
        .groupBy("score", "level", "number")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "classify_test_context",
    _TABLE + f" SELECT label, repo_id, CASE WHEN regexp_matches(file, {TEST_RX}) THEN 'test' ELSE coalesce(context, "
    f"'production') END AS context, CASE WHEN regexp_matches(file, {TEST_RX}) THEN 'info' ELSE severity END AS severity,"
    f" CASE WHEN regexp_matches(file, {TEST_RX}) THEN {quote(context.TEST_NOTE)} END AS note FROM findings",
)
def classify_test_context(spark: SparkSession, sf: str) -> DataFrame:
    return context.classify_test_context(table_findings(spark, sf)).select(
        "label", "repo_id", "context", "severity", "note"
    )


@query(
    "apply_context_tags",
    _TABLE + f", G AS (SELECT *, CASE WHEN rule = 'D6-002' THEN NULL ELSE {TAG_SQL} END AS context_tag FROM findings) "
    "SELECT label, repo_id, context_tag, CASE WHEN context_tag IS NOT NULL THEN severity END AS original_severity, "
    "CASE WHEN context_tag IS NOT NULL THEN 'info' ELSE severity END AS severity FROM G",
)
def apply_context_tags(spark: SparkSession, sf: str) -> DataFrame:
    return context.apply_context_tags(table_findings(spark, sf)).select(
        "label", "repo_id", "context_tag", "original_severity", "severity"
    )


_GLOBS = ["docs/**", "**/*.min.js", "examples/*.js", "**/test?utils.tsx"]


@query(
    "ignore_paths",
    f"WITH {SHAPED_PATHS_CTE} SELECT repo_id, doc_id, path FROM shaped_paths WHERE path IN "
    f"({', '.join(quote(p) for p in context.ALWAYS_READ)}) OR NOT regexp_matches(path, "
    f"{rx(T.globs_to_regex([*_GLOBS, *context.ALWAYS_IGNORED]))})",
)
def ignore_paths(spark: SparkSession, sf: str) -> DataFrame:
    return context.ignore_paths(shaped_paths(spark, sf), _GLOBS)


@query(
    "safe_relative_path",
    f"WITH {SHAPED_PATHS_CTE} SELECT doc_id, path, NOT (path = '' OR starts_with(path, '/') OR contains(path, '\\') "
    "OR regexp_matches(path, '^[A-Za-z]:') OR list_has_any(string_split(path, '/'), ['', '.', '..'])) AS safe "
    "FROM shaped_paths",
)
def safe_relative_path(spark: SparkSession, sf: str) -> DataFrame:
    return shaped_paths(spark, sf).select("doc_id", "path", T.safe_relative_path(F.col("path")).alias("safe"))


@query(
    "count_by_severity",
    gathered(_TABLE) + "," + score_sql("T", "SELECT DISTINCT repo_id FROM T")
    + " SELECT repo_id, critical, high, medium, low, info FROM scores",
)
def count_by_severity(spark: SparkSession, sf: str) -> DataFrame:
    return score.count_by_severity(classified(table_findings(spark, sf)))


@query(
    "findings_by_domain",
    _TABLE + " SELECT coalesce(domain, '__unknown__') AS domain, "
    + ", ".join(f"count(*) FILTER (severity = '{s}')::BIGINT AS {s}" for s in ("critical", "high", "medium", "low", "info"))
    + " FROM findings GROUP BY 1",
)
def findings_by_domain(spark: SparkSession, sf: str) -> DataFrame:
    return score.findings_by_domain(table_findings(spark, sf))


_SCORES = gathered(_TABLE) + "," + score_sql("T", "SELECT DISTINCT repo_id FROM T")


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return score.security_score(classified(table_findings(spark, sf)))


@query(
    "campaign_summary",
    _SCORES + " SELECT count(*)::BIGINT AS repos, round(avg(score), 6) AS mean_score, quantile_cont(score, 0.5)::DOUBLE "
    "AS median_score, "
    + ", ".join(f"count(*) FILTER (band = '{b}')::BIGINT AS band_{b}" for b in ("low", "medium", "high", "critical"))
    + ", round(100.0 * count(*) FILTER (critical > 0) / count(*), 1)::DOUBLE AS pct_with_critical"
    ", round(100.0 * count(*) FILTER (critical > 0 OR high > 0) / count(*), 1)::DOUBLE AS pct_with_critical_or_high, "
    + ", ".join(f"sum({s})::BIGINT AS total_{s}" for s in ("critical", "high", "medium", "low", "info"))
    + " FROM scores",
)
def campaign_summary(spark: SparkSession, sf: str) -> DataFrame:
    return score.campaign_summary(_scores(spark, sf))


@query(
    "rule_leaderboard",
    _TABLE + " SELECT severity, rule, count(*)::BIGINT AS hits, count(DISTINCT repo_id)::BIGINT AS repos FROM findings "
    "GROUP BY ALL",
)
def rule_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    return score.rule_leaderboard(table_findings(spark, sf))


@query(
    "category_leaderboard",
    _TABLE + " SELECT category, count(*)::BIGINT AS findings, count(DISTINCT repo_id)::BIGINT AS repos FROM findings "
    "GROUP BY ALL",
)
def category_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    return score.category_leaderboard(table_findings(spark, sf))


_RANK = "CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END"
_REPORT_ORDER = (
    f"CASE WHEN context = 'test' THEN 2 WHEN severity = 'info' THEN 1 ELSE 0 END, {_RANK} DESC, "
    "coalesce(file, '') || ':' || coalesce(line, 0) || ':' || title"
)
_ID = (
    "sha256(repo_id || '|' || rule || '|' || coalesce(file, '') || '|' || coalesce(line::VARCHAR, '') || '|||' || label)"
)


@query(
    "sort_findings",
    gathered(_TABLE) + f" SELECT label, rule, CASE WHEN context = 'test' THEN 2 WHEN severity = 'info' THEN 1 ELSE 0 END::INT AS context_rank, {_RANK}::INT AS "
    "severity_rank, coalesce(file, '') || ':' || coalesce(line, 0) || ':' || title AS report_key FROM T",
)
def sort_findings(spark: SparkSession, sf: str) -> DataFrame:
    """The whole table in report order, with the three sort keys shown (range-partitioned sort)."""
    from assayline.functions.severity import severity_rank

    ordered = score.sort_findings(classified(table_findings(spark, sf)))
    return ordered.select(
        "label", "rule", score.context_rank().alias("context_rank"), severity_rank(F.col("severity")).alias("severity_rank"),
        score.report_key().alias("report_key"),
    )


@query(
    "agent_findings",
    _TABLE + f", O AS (SELECT *, {_ID} AS fid FROM findings) SELECT label, severity, rule, file, line FROM O "
    f"ORDER BY {_RANK} DESC, rule, file, line, fid LIMIT 100",
)
def agent_findings(spark: SparkSession, sf: str) -> DataFrame:
    return score.agent_findings(table_findings(spark, sf), 100).select("label", "severity", "rule", "file", "line")


@query(
    "agent_summary",
    _TABLE + " SELECT repo_id, count(*)::BIGINT AS findings, least(count(*), 20)::BIGINT AS shown, count(*) > 20 AS "
    "truncated, count(*) || ' findings: ' || count(*) FILTER (severity = 'critical') || ' critical, ' || "
    "count(*) FILTER (severity = 'high') || ' high' AS headline FROM findings GROUP BY 1",
)
def agent_summary(spark: SparkSession, sf: str) -> DataFrame:
    return score.agent_summary(table_findings(spark, sf))


@query(
    "top_findings",
    gathered(_TABLE) + f", O AS (SELECT *, {_ID} AS fid FROM T WHERE context_tag IS NULL AND context NOT IN ('test', "
    "'placeholder', 'enum')), B AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY "
    f"{_REPORT_ORDER}, fid) AS rn FROM O) SELECT repo_id, label, severity, file, line FROM B WHERE rn <= 3",
)
def top_findings(spark: SparkSession, sf: str) -> DataFrame:
    return score.top_findings(classified(table_findings(spark, sf))).select(
        "repo_id", "label", "severity", "file", "line"
    )


@query("worst_repos", _SCORES + " SELECT * FROM scores ORDER BY score, repo_id LIMIT 10")
def worst_repos(spark: SparkSession, sf: str) -> DataFrame:
    return score.worst_repos(_scores(spark, sf), 10)


@query("worst_repos_by_critical", _SCORES + " SELECT * FROM scores ORDER BY critical DESC, repo_id LIMIT 10")
def worst_repos_by_critical(spark: SparkSession, sf: str) -> DataFrame:
    return score.worst_repos(_scores(spark, sf), 10, "critical")


@query("ci_gate", _SCORES + " SELECT repo_id, score, critical, CASE WHEN critical > 0 OR score < 80 THEN 1 ELSE 0 END "
       "AS exit_code FROM scores")
def ci_gate(spark: SparkSession, sf: str) -> DataFrame:
    return score.ci_gate(_scores(spark, sf), 80)


_LVL = (
    "CASE WHEN confidence_score IS NOT NULL THEN CASE WHEN confidence_score >= .9 THEN 'certain' WHEN confidence_score "
    ">= .7 THEN 'high' WHEN confidence_score >= .5 THEN 'medium' ELSE 'low' END ELSE confidence_level END"
)


@query(
    "should_block",
    gathered(_TABLE) + f" SELECT repo_id, label, severity FROM T WHERE severity IN ('critical', 'high') AND {_LVL} IN "
    "('certain', 'high') AND context NOT IN ('test', 'placeholder', 'enum')",
)
def should_block(spark: SparkSession, sf: str) -> DataFrame:
    return score.should_block(classified(table_findings(spark, sf))).select("repo_id", "label", "severity")


@query(
    "snippet_verdict",
    rules_sql([r for r in ALL_RULES if R.BY_ID[r].detector in ("secrets", "injection", "ai-patterns")])
    + " SELECT repo_id, file, CASE WHEN bool_or(severity = 'critical' AND confidence_level IN ('certain', 'high')) THEN "
    "'block' WHEN bool_or(severity = 'high' AND confidence_level IN ('certain', 'high')) THEN 'warn' ELSE 'allow' END "
    "AS verdict FROM F GROUP BY ALL",
)
def snippet_verdict(spark: SparkSession, sf: str) -> DataFrame:
    from assayline.operators import scan

    facts = project.auth_facts(repo_dependencies(spark, sf))
    found = scan.scan_files(
        code_files(spark, sf), detectors=["secrets", "injection", "ai-patterns"], repo_facts=facts
    )
    return score.snippet_verdict(found, ["repo_id", "file"])


@query(
    "project_type",
    f"WITH {REPO_DEPS_CTE} SELECT repo_id, CASE WHEN bool_or(name = 'next') THEN 'nextjs' WHEN bool_or(name = 'express')"
    " THEN 'express' WHEN bool_or(name = 'fastify') THEN 'fastify' WHEN bool_or(name = 'react') THEN 'react' ELSE 'node'"
    " END AS project_type FROM repo_deps GROUP BY 1",
)
def project_type(spark: SparkSession, sf: str) -> DataFrame:
    return project.project_type(repo_dependencies(spark, sf))


_AUTH_SQL = "(CASE " + " ".join(
    f"WHEN starts_with(name, {quote(p)}) THEN {quote(label)}" for p, label in project.AUTH_PACKAGES
) + " END)"


@query(
    "has_auth",
    f"WITH {REPO_DEPS_CTE} SELECT repo_id, count({_AUTH_SQL}) > 0 AS has_auth, coalesce(list_sort(list(DISTINCT "
    f"{_AUTH_SQL}) FILTER ({_AUTH_SQL} IS NOT NULL)), []::VARCHAR[]) AS auth_sources FROM repo_deps GROUP BY 1",
)
def has_auth(spark: SparkSession, sf: str) -> DataFrame:
    return project.auth_facts(repo_dependencies(spark, sf))


@query(
    "unsupported_language",
    gathered(_SCAN_FINDINGS) + "," + score_sql("T", "SELECT DISTINCT repo_id FROM T") + r""",
N2 AS (SELECT repo_id, count(*) FILTER (regexp_matches(path, '\.(m?[jt]sx?|mts|cts)$'))::BIGINT AS n_code_files
       FROM code_files GROUP BY 1)
SELECT repo_id, n_code_files, coalesce(score, 100)::INT AS score, n_code_files < 5 AND coalesce(n_findings, 0) = 0 AND
  coalesce(score, 100) = 100 AS unsupported FROM N2 LEFT JOIN scores USING (repo_id)""",
)
def unsupported_language(spark: SparkSession, sf: str) -> DataFrame:
    return project.unsupported_language(
        code_files(spark, sf), score.security_score(classified(scanned(spark, sf)))
    )


@query(
    "select_detectors",
    rules_sql([r for r in ALL_RULES if R.BY_ID[r].detector in ("misconfig", "deep-auth")])
    + " SELECT rule, count(*)::BIGINT AS hits FROM F GROUP BY 1",
)
def select_detectors(spark: SparkSession, sf: str) -> DataFrame:
    from assayline.operators import scan

    facts = project.auth_facts(repo_dependencies(spark, sf))
    found = scan.scan_files(code_files(spark, sf), detectors=["misconfig", "deep-auth"], repo_facts=facts)
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("hits"))


@query(
    "first_match_per_line",
    f"WITH {CODE_LINES_CTE} SELECT repo_id, path, line_no, CASE "
    + " ".join(f"WHEN regexp_matches(line, {rx(p, i)}) THEN {quote(label)}" for p, i, label in R.PERMISSIVE_FLAGS)
    + " END AS label FROM code_lines",
)
def first_match_per_line(spark: SparkSession, sf: str) -> DataFrame:
    from assayline.functions.regex import matches
    from assayline.operators import scan

    label = score.first_match([(matches(F.col("line"), p, i), name) for p, i, name in R.PERMISSIVE_FLAGS])
    return scan.explode_lines(code_files(spark, sf)).select("repo_id", "path", "line_no", label.alias("label"))


@query(
    "union_findings",
    "WITH " + TABLE_FINDINGS_CTE + ", "
    + "u AS (SELECT rule, label FROM findings UNION ALL SELECT 'D6-003' AS rule, label FROM findings) "
    "SELECT rule, count(*)::BIGINT AS n FROM u GROUP BY 1",
)
def union_findings(spark: SparkSession, sf: str) -> DataFrame:
    from assayline.operators.scan import union_findings as union

    base = table_findings(spark, sf)
    return union([base, base.withColumn("rule", F.lit("D6-003"))]).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stride_sample",
    "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, "
    "o_orderkey) - 1 AS p, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_custkey, o_orderkey FROM r "
    "WHERE n <= 6 OR list_contains([(i * n) // 6 for i in range(0, 6)], p)",
)
def stride_sample_(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return stride_sample(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], 6).select(
        "o_custkey", "o_orderkey"
    )


_ = sql_list
