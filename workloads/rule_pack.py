"""Rule packs over generated code files (line, window, file and repository rules)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.operators import rules as R
from assayline.operators import scan
from assayline.operators.project import auth_facts
from workloads import query
from workloads.bindings import (
    CODE_LINES_CTE, REPO_DEPS_CTE, code_files, quote, repo_dependencies, rx, sql_list, table,
)

# --------------------------------------------------------------------------- oracle text
_WINDOWS = {
    "w3p": "3 PRECEDING AND CURRENT ROW",
    "w100": "100 PRECEDING AND 1 PRECEDING",
    "w40": "CURRENT ROW AND 39 FOLLOWING",
    "w1529": "15 PRECEDING AND 29 FOLLOWING",
    "w5": "5 PRECEDING AND 5 FOLLOWING",
    "w20": "CURRENT ROW AND 19 FOLLOWING",
    "w3": "3 PRECEDING AND 3 FOLLOWING",
}


def lines_cte(windows: list[str]) -> str:
    """``L``: lines with the wanted windows, file facts and the repository's auth fact."""
    over = "".join(
        f", string_agg(line, chr(10)) OVER (PARTITION BY l.repo_id, l.path ORDER BY line_no "
        f"ROWS BETWEEN {_WINDOWS[w]}) AS {w}"
        for w in windows
    )
    auth = "^(?:@clerk/|next-auth|@auth/|express-session|passport|@auth0/|iron-session|lucia|@supabase/auth"
    auth += "|firebase/auth|@workos-inc|@descope|next-firebase-auth|jose|jsonwebtoken)"
    return f"""WITH {CODE_LINES_CTE}, {REPO_DEPS_CTE},
auth AS (SELECT repo_id, bool_or(regexp_matches(name, {quote(auth)})) AS has_auth FROM repo_deps GROUP BY 1),
facts AS (SELECT repo_id, path, regexp_matches(content, {rx(R.RATE_LIMIT)}) AS rate_limited,
                 regexp_matches(content, {rx(R.TIMING_SAFE)}) AS timing_safe FROM code_files),
wide AS (SELECT l.repo_id, l.path, line_no, line, a.has_auth, f.rate_limited, f.timing_safe{over}
         FROM code_lines l JOIN auth a USING (repo_id) JOIN facts f ON f.repo_id = l.repo_id AND f.path = l.path),
L AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS trimmed FROM wide
      WHERE NOT regexp_matches(line, {rx(R.METADATA_LINE)}))"""


def m(pattern: str, ci: bool = False, col: str = "line") -> str:
    return f"regexp_matches({col}, {rx(pattern, ci)})"


def ext(pattern: str, ci: bool = False, group: int = 1) -> str:
    return f"regexp_extract(line, {rx(pattern, ci)}, {group})"


SQL_SKIP = (
    f"({m(R.NON_SQL_TAGS, True)} OR upper({ext(R.FIRST_SQL_WORD, True)}) IN "
    f"({', '.join(quote(v) for v in R.IDENTIFIER_ONLY_VERBS)}) OR NOT {m(R.MEMBER_SQL_CALL, True)} "
    f"OR {m(R.SHELL_RECEIVER, True)} OR {m(R.ESCAPED_VALUE, True)} OR {m(R.BOUND_PLACEHOLDER, True)})"
)
RANDOM_CLASS = (
    f"(CASE WHEN {m(R.RANDOM_SINK_ELSEWHERE, True)} THEN NULL "
    f"WHEN NOT regexp_matches(regexp_replace(line, {rx(R.RANDOM_CALLS)}, '', 'g'), {rx(R.CODE_SHAPE)}) THEN NULL "
    f"WHEN {m(R.RANDOM_HIGH, True)} THEN 'high' "
    f"WHEN {m(R.RANDOM_MEDIUM, True)} AND {m(R.RANDOM_MEDIUM_NEAR, True, 'w5')} THEN 'medium' "
    f"WHEN {m(R.RANDOM_LOW, True)} OR {m(R.RANDOM_LOW_NEAR, True, 'w5')} THEN 'low' END)"
)
_VAR = f"regexp_extract(line, {rx(R.INNER_HTML_VARIABLE)}, 1)"
HTML_CLASS = (
    f"(CASE WHEN {m(R.USER_HTML, True, 'w3p')} THEN 'high' "
    f"WHEN {m(R.TEMPLATE_VALUE)} AND NOT {m(R.USER_HTML, True)} THEN 'low' "
    f"WHEN {_VAR} <> '' AND regexp_matches({_VAR}, '(?i)icon') AND regexp_matches(coalesce(w100, ''), "
    f"{quote(R.ICON_TEMPLATE[0])} || {_VAR} || {quote(R.ICON_TEMPLATE[1])}) THEN 'low' ELSE 'medium' END)"
)
_TIME = (
    f"(({m(R.TIME_PARAMETER, True)} AND {m(R.TIME_NOW)}) OR {m(R.TIME_ASSIGNED, True)} OR {m(R.TIME_COMPARED)})"
)
_SINK = f"lower({ext(R.SECRET_SINK, True)})"
PERMISSIVE = "(CASE " + " ".join(
    f"WHEN {m(p, ci)} THEN {quote(label)}" for p, ci, label in R.PERMISSIVE_FLAGS
) + " END)"
_SCOPE = "regexp_extract(w20, '^([^{]*\\{[^}]*\\})', 1)"
_MISSING = "list_filter([" + ", ".join(
    f"CASE WHEN NOT regexp_matches({_SCOPE}, '{f}\\s*:') THEN '{f}' END" for f in R.COOKIE_FLAGS
) + "], lambda x: x IS NOT NULL)"
CRED = "(CASE " + " ".join(
    f"WHEN {m(p, ci)} THEN {quote(label)}" for label, p, ci in R.CREDENTIAL_SHAPES
) + f" WHEN {m(R.ASSIGNED_SECRET, True)} THEN 'assignment' END)"
_WORDS = (
    f"list_filter(regexp_extract_all(line, {rx(R.ENTROPY_WORD)}), lambda w: regexp_matches(w, '[A-Za-z]') AND "
    "regexp_matches(w, '[0-9]'))"
)
ENTROPY = (
    f"(len(list_filter({_WORDS}, lambda w: list_sum(list_transform(list_distinct(string_split(w, '')), lambda c: "
    "- (len(list_filter(string_split(w, ''), lambda d: d = c)) / length(w)) * "
    f"log2(len(list_filter(string_split(w, ''), lambda d: d = c)) / length(w)))) >= {R.ENTROPY_MIN})) > 0)"
)
_JS = m(r"\.(js|jsx|ts|tsx|mjs|cjs)$", False, "path")
_MJS = m(r"\.(?:m?[jt]sx?|mts|cts)$", False, "path")
_MJSI = m(r"\.(m?[jt]sx?|mts|cts)$", True, "path")
_MIS = "NOT " + m(
    r"\.(?:md|mdx|markdown|txt|rst|json|jsonl|ndjson|xml|svg|html?|csv|tsv|har|ipynb)$", True, "path"
)
_GATE = {"injection": _JS, "ai-patterns": _MJS, "misconfig": _MIS, "api-hardening": _MJSI, "deep-auth": _MJSI,
         "secrets": "TRUE"}

#: rule -> (predicate, severity, confidence, label, windows)
SQL_RULES: dict[str, tuple[str, str, str, str, list[str]]] = {
    "D1-001": (f"{m(R.SQL_INTERPOLATION, True)} AND NOT {SQL_SKIP}", "", "", "NULL", []),
    "D1-002": (f"{m(R.SQL_CONCATENATION, True)} AND NOT {SQL_SKIP}", "", "", "NULL", []),
    "D1-003": (
        f"{m(R.COMMAND_CALL, True)} AND NOT ({m(R.REGEX_LITERAL_EXEC)} OR {m(R.CAPS_CONST_EXEC)} OR "
        f"{m(R.REGEX_NAMED_EXEC)})", "", "", "NULL", []),
    "D1-004": (m(R.INNER_HTML_PROP, True), "", "", "NULL", []),
    "D1-005": (m(R.NOSQL_EMPTY_GT, True), "", "", "NULL", []),
    "D1-006": (m(R.FILE_READ, True), "", "", "NULL", []),
    "D1-007": (m(R.INNER_HTML_ASSIGN), HTML_CLASS,
               f"CASE WHEN {HTML_CLASS} = 'medium' THEN 'medium' ELSE 'high' END", "NULL", ["w3p", "w100"]),
    "D1-008": (m(R.OBJECT_MERGE, True), "", "", "NULL", []),
    "D3-001": (m(R.BODY_TO_MODEL, True), "", "", "NULL", []),
    "D9-002": (m(R.USER_FETCH, True), "", "", "NULL", []),
    "AI-001": (f"has_auth AND {m(R.AUTH_APP_CORS, True)}", "", "", "NULL", []),
    "AI-002": (
        f"{m(R.WEAK_RANDOM_SOURCE)} AND {m(R.SECRET_SINK, True)} AND NOT {_TIME} AND NOT ({_SINK} = 'nonce' AND "
        f"{m(R.UI_NONCE, True)})", "", "", _SINK, []),
    "AI-003": (
        f"{m(R.REQUEST_ID)} AND {m(R.QUERY_BY_ID, False, 'w40')} AND NOT {m(R.OWNERSHIP, False, 'w40')}",
        "", "", "NULL", ["w40"]),
    "AI-004": (m(R.BODY_SPREAD), "", "", "NULL", []),
    "AI-007": (f"{m(R.TEST_KEY)} AND NOT {m(R.EXAMPLE_HINT, True)}", "", "", "NULL", []),
    "AI-008": (m(R.STACK_LEAK), "", "", "NULL", []),
    "AI-009": (f"{PERMISSIVE} IS NOT NULL", "", "", PERMISSIVE, []),
    "AI-010": (
        f"{m(R.MUTATION)} AND {m(R.AUTH_USED, False, 'w1529')} AND NOT {m(R.AUTHZ_CHECK, True, 'w1529')}",
        "", "", "NULL", ["w1529"]),
    "D5-002": (f"NOT has_auth AND {m(R.OPEN_CORS, True)}", "", "", "NULL", []),
    "D5-003": (m(R.EVAL_CALL, True), "", "", "NULL", []),
    "D4-003": (f"{m(R.MATH_RANDOM)} AND {RANDOM_CLASS} IS NOT NULL", RANDOM_CLASS, "", "NULL", ["w5"]),
    "D8-001": (
        f"{m(R.CONSOLE_LOG, True)} AND NOT ({m(R.STATIC_LOG)} AND NOT contains(line, '${{')) AND "
        f"{m(R.SENSITIVE_LOG, True)} AND NOT ({m(R.MATH_RANDOM)} AND {RANDOM_CLASS} IS NULL)",
        "", "", "NULL", ["w5"]),
    "API-001": (
        f"NOT rate_limited AND {m(R.AUTH_ROUTE, True)} AND len(list_filter({sql_list(R.AUTH_ROUTE_PATHS)}, "
        f"lambda p: contains(lower({ext(R.AUTH_ROUTE, True)}), p))) > 0", "", "", ext(R.AUTH_ROUTE, True), []),
    "API-002": (
        f"({m(R.BODY_LIMIT)} OR {m(R.FASTIFY_BODY_LIMIT)} OR {m(R.ROUTE_BODY_LIMIT, True)})", "", "", "NULL", []),
    "API-004": (f"({m(R.CORS_CREDENTIALS[0])} OR {m(R.CORS_CREDENTIALS[1])})", "", "", "NULL", []),
    "AUTH-001": (m(R.JWT_NONE, True), "", "", "NULL", []),
    "AUTH-002": (m(R.JWT_DECODE, True), "", "", "NULL", []),
    "AUTH-003": (
        f"NOT timing_safe AND {m(R.PASSWORD_EQUALS, True)} AND NOT {m(R.URL_EMPTY_CHECK, True)}",
        "", "", "NULL", []),
    "AUTH-004": (
        f"{m(R.COOKIE_BLOCK)} AND {_SCOPE} <> '' AND len({_MISSING}) > 0",
        f"CASE WHEN len({_MISSING}) = 3 THEN 'high' ELSE 'medium' END", "",
        f"array_to_string({_MISSING}, ', ')", ["w20"]),
    "AUTH-005": (
        f"{m(R.WEAK_HASH, True)} AND {m(R.PASSWORD_NEAR, True, 'w3')}", "", "", f"upper({ext(R.WEAK_HASH, True)})",
        ["w3"]),
    "AUTH-006": (
        m(R.SESSION_SECRET, True),
        f"CASE WHEN lower({ext(R.SESSION_SECRET, True)}) IN ({', '.join(quote(s) for s in R.TUTORIAL_SECRETS)}) "
        "THEN 'critical' ELSE 'high' END", "", "NULL", []),
    "D4-001": (f"{CRED} IS NOT NULL", "", "", CRED, []),
    "D4-002": (f"{CRED} IS NULL AND {ENTROPY}", "", "", "NULL", []),
}


def rule_select(rule: str) -> str:
    spec = R.BY_ID[rule]
    pred, severity, confidence, label, _ = SQL_RULES[rule]
    sev = severity or quote(str(spec.severity))
    conf = confidence or quote(str(spec.confidence))
    snippet = "trimmed"
    if rule == "AI-007":
        snippet = (
            f"regexp_replace({snippet}, '\\b((?:sk|pk|rk)_test_)[A-Za-z0-9]{{16,}}([A-Za-z0-9]{{4}})', "
            "'\\1****\\2')"
        )
    return (
        f"SELECT repo_id, path AS file, line_no AS line, '{rule}' AS rule, {quote(spec.domain)} AS domain, "
        f"{sev} AS severity, {conf} AS confidence_level, {snippet} AS snippet, {label} AS label FROM L "
        f"WHERE {_GATE[spec.detector]} AND {pred}"
    )


def rules_sql(rules: list[str]) -> str:
    windows = sorted({w for r in rules for w in SQL_RULES[r][4]})
    return lines_cte(windows) + ",\nF AS (" + "\nUNION ALL\n".join(rule_select(r) for r in rules) + ")"


_COLS = ["repo_id", "file", "line", "rule", "domain", "severity", "confidence_level", "snippet", "label"]


def scanned(spark: SparkSession, sf: str, rules: list[str] | None = None) -> DataFrame:
    facts = auth_facts(repo_dependencies(spark, sf))
    return scan.scan_files(code_files(spark, sf), rules=rules, repo_facts=facts)


def _register(rule: str) -> None:
    sql = rules_sql([rule]) + "\nSELECT * FROM F"
    if SQL_RULES[rule][3] == "NULL":
        sql = sql.replace("SELECT * FROM F", "SELECT * EXCLUDE (label), NULL::VARCHAR AS label FROM F")

    @query("rule_" + rule.lower().replace("-", "_"), sql)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return scanned(spark, sf, [rule]).select(*_COLS)


for _rule in SQL_RULES:
    _register(_rule)

ALL_RULES = list(SQL_RULES)


@query(
    "scan_all_rules",
    rules_sql(ALL_RULES)
    + "\nSELECT rule, severity, confidence_level, count(*)::BIGINT AS hits, count(DISTINCT file)::BIGINT AS files "
    "FROM F GROUP BY ALL",
)
def scan_all_rules(spark: SparkSession, sf: str) -> DataFrame:
    """All line rules in one pass over the files."""
    return (
        scanned(spark, sf)
        .groupBy("rule", "severity", "confidence_level")
        .agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("file").alias("files"))
    )


@query(
    "document_secrets",
    f"""WITH docs AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
L AS (SELECT * FROM docs WHERE NOT {m(R.METADATA_LINE)})
SELECT source AS repo_id, 'text/' || doc_id || '.txt' AS file, {CRED} AS label, count(*)::BIGINT AS hits
FROM L WHERE {CRED} IS NOT NULL GROUP BY ALL""",
)
def document_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """Committed-secret rule over whole documents."""
    from workloads.bindings import document_files

    return (
        scan.scan_files(document_files(spark, sf), rules=["D4-001"])
        .groupBy("repo_id", "file", "label")
        .agg(F.count(F.lit(1)).alias("hits"))
    )


@query(
    "explode_lines",
    "WITH p AS (SELECT source, doc_id, string_split(text, chr(10)) AS ls FROM documents), "
    "n AS (SELECT source AS repo_id, doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM p) "
    "SELECT repo_id, 'text/' || doc_id || '.txt' AS path, k::INT AS line_no, ls[k] AS line FROM n",
)
def explode_lines(spark: SparkSession, sf: str) -> DataFrame:
    from workloads.bindings import document_files

    return scan.explode_lines(document_files(spark, sf))


@query(
    "skip_metadata_lines",
    f"WITH {CODE_LINES_CTE} SELECT repo_id, path, line_no, line FROM code_lines WHERE NOT {m(R.METADATA_LINE)}",
)
def skip_metadata_lines(spark: SparkSession, sf: str) -> DataFrame:
    return scan.skip_metadata_lines(scan.explode_lines(code_files(spark, sf)))


@query(
    "line_context",
    f"WITH {CODE_LINES_CTE} SELECT repo_id, path, line_no, line, string_agg(line, chr(10)) OVER (PARTITION BY "
    "repo_id, path ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS ctx FROM code_lines",
)
def line_context(spark: SparkSession, sf: str) -> DataFrame:
    return scan.line_context(code_files(spark, sf), -3, 3)


@query(
    "file_gates",
    f"WITH {CODE_LINES_CTE} SELECT detector, count(*)::BIGINT AS files FROM ("
    + " UNION ALL ".join(
        f"SELECT '{d}' AS detector, path FROM code_files WHERE {g}" for d, g in _GATE.items()
    )
    + ") GROUP BY 1",
)
def file_gates(spark: SparkSession, sf: str) -> DataFrame:
    files = code_files(spark, sf).select("path")
    gates = [F.when(g(F.col("path")), F.lit(d)) for d, g in R.GATES.items()]
    return (
        files.select(F.explode(F.array(*gates)).alias("detector"))
        .where("detector is not null")
        .groupBy("detector")
        .agg(F.count(F.lit(1)).alias("files"))
    )


@query(
    "rule_api_005",
    f"WITH {CODE_LINES_CTE} SELECT repo_id, path AS file, 'API-005' AS rule, 'medium' AS severity FROM code_files "
    f"WHERE {_MJSI} AND regexp_matches(content, {rx(R.EXPRESS_IMPORT)}) AND regexp_matches(content, "
    f"{rx(R.EXPRESS_APP)}) AND NOT regexp_matches(content, {rx(R.HELMET)})",
)
def rule_api_005(spark: SparkSession, sf: str) -> DataFrame:
    return scan.express_without_helmet(code_files(spark, sf)).select("repo_id", "file", "rule", "severity")


_CONFIG_TEXT = (
    "concat('X-Frame-Options: ', o_orderstatus, CASE WHEN o_orderpriority < '3' THEN ' Content-Security-Policy' ELSE '' "
    "END, CASE WHEN o_orderstatus = 'F' THEN ' Referrer-Policy X-Content-Type-Options Strict-Transport-Security' "
    "ELSE '' END)"
)


@query(
    "rule_d5_004",
    f"WITH c AS (SELECT 'c' || o_custkey AS repo_id, 'apps/' || o_orderkey || '/next.config.js' AS file, "
    f"{_CONFIG_TEXT} AS content FROM orders), g AS (SELECT repo_id, file, array_to_string(list_filter("
    f"{sql_list(R.SECURITY_HEADERS)}, lambda h: NOT contains(content, h)), ', ') AS label FROM c) "
    "SELECT * FROM g WHERE label <> ''",
)
def rule_d5_004(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("repo_id"),
        F.concat(F.lit("apps/"), F.col("o_orderkey").cast("string"), F.lit("/next.config.js")).alias("path"),
        F.expr(_CONFIG_TEXT).alias("content"),
    )
    return scan.missing_headers(files).select("repo_id", "file", "label")


_ENV_PATH = (
    "CASE o_orderpriority WHEN '1-URGENT' THEN '.env' WHEN '2-HIGH' THEN '.gitignore' "
    "WHEN '5-LOW' THEN '.env.local' ELSE 'src/a.ts' END"
)
_ENV_TEXT = "CASE WHEN o_orderstatus = 'F' THEN 'dist .env' ELSE 'dist' END"


@query(
    "rule_d5_001",
    f"WITH f AS (SELECT 'c' || o_custkey AS repo_id, {_ENV_PATH} AS path, {_ENV_TEXT} AS content FROM orders), "
    "i AS (SELECT repo_id FROM f WHERE path = '.gitignore' AND contains(content, '.env')) "
    "SELECT DISTINCT repo_id, path AS file FROM f WHERE path IN ('.env', '.env.local', '.env.production') "
    "AND repo_id NOT IN (SELECT repo_id FROM i)",
)
def rule_d5_001(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("repo_id"),
        F.expr(_ENV_PATH).alias("path"),
        F.expr(_ENV_TEXT).alias("content"),
    )
    return scan.env_file_exposed(files).select("repo_id", "file")


# --------------------------------------------------------------------------- history diffs
DIFF_SQL = (
    "CASE line_no % 5 WHEN 0 THEN '+++ b/src/f' || line_no || '.ts' WHEN 1 THEN '+' || line "
    "WHEN 2 THEN '-' || line WHEN 3 THEN '+' || line ELSE ' ' || line END"
)


def code_diffs(spark: SparkSession, sf: str) -> DataFrame:
    """The code files read as diffs: every fifth line is a file header."""
    lines = F.split("content", "\n", -1)

    def mark(x: F.Column, i: F.Column) -> F.Column:
        k = (i + 1) % 5
        return (
            F.when(k == 0, F.concat(F.lit("+++ b/src/f"), (i + 1).cast("string"), F.lit(".ts")))
            .when(k.isin(1, 3), F.concat(F.lit("+"), x))
            .when(k == 2, F.concat(F.lit("-"), x))
            .otherwise(F.concat(F.lit(" "), x))
        )

    return code_files(spark, sf).select(
        F.concat_ws(":", "repo_id", "path").alias("repo_id"), F.array_join(F.transform(lines, mark), "\n").alias("diff")
    )


_DIFF_CTE = f"""WITH {CODE_LINES_CTE},
d AS (SELECT repo_id || ':' || path AS repo_id, line_no, {DIFF_SQL} AS raw FROM code_lines),
c AS (SELECT *, last_value(CASE WHEN starts_with(raw, '+++ b/') THEN substr(raw, 7) END IGNORE NULLS) OVER
      (PARTITION BY repo_id ORDER BY line_no) AS cur FROM d),
a AS (SELECT repo_id, coalesce(cur, '') AS file, line_no, raw FROM c
      WHERE starts_with(raw, '+') AND NOT starts_with(raw, '+++'))"""


@query(
    "diff_added_lines",
    _DIFF_CTE + " SELECT repo_id, file, line_no, substr(raw, 2) AS line FROM a",
)
def diff_added_lines(spark: SparkSession, sf: str) -> DataFrame:
    return scan.diff_added_lines(code_diffs(spark, sf))


@query(
    "rule_d8_002",
    _DIFF_CTE
    + " "
    + " UNION ALL ".join(
        f"SELECT repo_id, CASE WHEN file = '' THEN 'git-history' ELSE file END AS file, line_no AS line, "
        f"{quote(name)} AS label, regexp_replace(raw, '[A-Za-z0-9+/=_\\-]{{8,}}', '****', 'g') AS snippet "
        f"FROM a WHERE {m(p, False, 'raw')}"
        for name, p in R.HISTORY_SECRETS
    ),
)
def rule_d8_002(spark: SparkSession, sf: str) -> DataFrame:
    return scan.history_secrets(code_diffs(spark, sf)).select("repo_id", "file", "line", "label", "snippet")
