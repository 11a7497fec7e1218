"""Evidence documents read and written: one generated document per order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.operators.spread import dealt
from assayline.plans import normalizers
from assayline.sources import evidence as S
from assayline.sources import sinks
from workloads import query
from workloads.bindings import pick, quote, sql_list, sql_pick, table
from workloads.findings_score import TABLE_FINDINGS_CTE, table_findings


def documents_of(spark: SparkSession, sf: str, raw: F.Column) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("subject:"), F.col("o_custkey").cast("string")).alias("subject_id"),
        raw.alias("raw"),
    )


def _sql_expr(text: str) -> F.Column:
    return F.expr(text)


# --------------------------------------------------------------------------- SARIF
#: results (JSON, kept path or None, line, rule, level): what the importer should make of each
_R = [
    ('{"ruleId":"r/1","level":"error","locations":[{"physicalLocation":{"artifactLocation":{"uri":"src/a%20b.ts"},"region":{"startLine":7}}}]}',
     "src/a b.ts", 7, "sarif.r/1", "error"),
    ('{"ruleId":"bad rule!","level":"High","locations":[{"physicalLocation":{"artifactLocation":{"uri":"https://h/x"}}},'
     '{"physicalLocation":{"artifactLocation":{"uri":"lib/c+d.js"}}}]}', "lib/c+d.js", None, "sarif.bad_rule_", "High"),
    ('{"level":"note","locations":[]}', None, None, None, None),
    ('{"ruleId":"r2","locations":[{"physicalLocation":{"artifactLocation":{"uri":"a.ts"},"region":{"startLine":0}}}]}',
     "a.ts", None, "sarif.r2", "unknown"),
    ('{"ruleId":"r3"}', None, None, None, None),
    ('{"ruleId":"r4","level":"medium","locations":[{"physicalLocation":{"artifactLocation":{"uri":"x%2"}}},{}]}', None, None, None, None),
]
_SARIF_SEVERITY = {"error": "unknown", "High": "high", "unknown": "unknown", "medium": "medium"}
_SARIF_RAW = (
    "CASE o_orderkey % 10 WHEN 7 THEN '{\"version\":\"2.0.0\",\"runs\":[]}' WHEN 8 THEN '{\"version\":\"2.1.0\",\"runs\":[{\"results\":[{\"ruleId\":\"z\","
    "\"locations\":[{\"physicalLocation\":{\"artifactLocation\":{\"uri\":\"../up.ts\"}}}]}]}]}' WHEN 9 THEN 'not json' ELSE "
    "concat('{\"version\":\"2.1.0\",\"runs\":[{\"results\":[', {a}, ',', {b}, ']},{},{\"results\":[', {c}, ']}]}') END"
)


def _sarif_docs(spark: SparkSession, sf: str) -> DataFrame:
    items = [r[0] for r in _R]
    n = len(items)

    def one(key: str) -> F.Column:
        return pick(items, F.pmod(F.expr(key), F.lit(n)))

    k = F.col("o_orderkey") % 10
    raw = (
        F.when(k == 7, '{"version":"2.0.0","runs":[]}')
        .when(
            k == 8,
            '{"version":"2.1.0","runs":[{"results":[{"ruleId":"z","locations":[{"physicalLocation":{"artifactLocation":'
            '{"uri":"../up.ts"}}}]}]}]}',
        )
        .when(k == 9, "not json")
        .otherwise(
            F.concat(
                F.lit('{"version":"2.1.0","runs":[{"results":['), one("o_orderkey"), F.lit(","), one("o_custkey"),
                F.lit(']},{},{"results":['), one("o_orderkey + o_custkey"), F.lit("]}]}"),
            )
        )
    )
    return documents_of(spark, sf, raw)


_KEYS = ["o_orderkey", "o_custkey", "o_orderkey + o_custkey"]


def _opt(v: object) -> str:
    return "NULL" if v is None else quote(str(v)) if isinstance(v, str) else str(v)


_SARIF_ROWS = "res AS (" + " UNION ALL ".join(
    f"SELECT o_orderkey, o_custkey, {i + 1} AS examined, (({k}) % {len(_R)})::INT + 1 AS k FROM orders WHERE o_orderkey % 10 < 7" for i, k in enumerate(_KEYS)
) + ")"


def _col(i: int) -> str:
    return "([" + ", ".join(_opt(r[i]) for r in _R) + "])[k]"


@query(
    "import_sarif",
    f"WITH {_SARIF_ROWS} SELECT o_orderkey AS doc_id, 'subject:' || o_custkey AS subject_id, {_col(3)} AS rule, {_col(1)} AS path, "
    f"{_col(2)}::BIGINT AS start_line, CASE WHEN {_col(2)} IS NULL THEN 'artifact' ELSE 'source' END AS location_kind, {_col(4)} AS severity_original, "
    + "CASE " + " ".join(f"WHEN {_col(4)} = '{a}' THEN '{b}'" for a, b in _SARIF_SEVERITY.items())
    + f" END AS severity, count(*)::BIGINT AS n FROM res WHERE {_col(1)} IS NOT NULL GROUP BY ALL",
)
def import_sarif(spark: SparkSession, sf: str) -> DataFrame:
    docs = _sarif_docs(spark, sf)
    found = S.import_sarif(docs.withColumn("subject_id", F.concat_ws("#", "doc_id", "subject_id")))
    return (
        found.select(
            F.substring_index("subject_id", "#", 1).cast("bigint").alias("doc_id"), F.substring_index("subject_id", "#", -1).alias("subject_id"),
            "rule", "path", "start_line", "location_kind", "severity_original", "severity",
        )
        .groupBy("doc_id", "subject_id", "rule", "path", "start_line", "location_kind", "severity_original", "severity")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "sarif_limitations",
    f"WITH {_SARIF_ROWS} SELECT o_orderkey AS doc_id, count(*)::BIGINT AS examined, count(*) FILTER ({_col(1)} IS NULL)::BIGINT AS omitted FROM res GROUP BY 1",
)
def sarif_limitations(spark: SparkSession, sf: str) -> DataFrame:
    return S.sarif_limitations(_sarif_docs(spark, sf))


@query(
    "sarif_issues",
    "SELECT o_orderkey AS doc_id, CASE o_orderkey % 10 WHEN 7 THEN 'UNSUPPORTED_VERSION' WHEN 8 THEN 'MALFORMED_URI' ELSE 'MALFORMED_RUN' END AS issue FROM "
    "orders WHERE o_orderkey % 10 > 6",
)
def sarif_issues(spark: SparkSession, sf: str) -> DataFrame:
    return S.sarif_issues(_sarif_docs(spark, sf))


# --------------------------------------------------------------------------- CycloneDX, VEX, SPDX
_BOM = (
    "CASE o_orderkey % 8 WHEN 6 THEN concat('{\"bomFormat\":\"CycloneDX\",\"specVersion\":\"1.5\",\"components\":[{\"name\":\"x', o_custkey, '\"}]}') "
    "WHEN 7 THEN '{\"bomFormat\":\"Other\"}' ELSE concat('{\"specVersion\":\"1.5\",\"bomFormat\":\"CycloneDX\",\"components\":[{\"type\":\"library\",\"name\":\"a', "
    "o_custkey, '\",\"version\":\"', o_orderkey % 5, '\",\"bom-ref\":\"ref', o_orderkey, '\",\"hashes\":[{\"alg\":\"SHA-256\",\"content\":\"ff\"}]},{\"type\":"
    "\"file\",\"bom-ref\":\"f\"}],\"dependencies\":[{\"ref\":\"ref', o_orderkey, '\",\"dependsOn\":[\"f\",\"g', o_custkey % 3, '\"]},{\"ref\":\"f\"}],"
    "\"vulnerabilities\":[{\"id\":\"V', o_custkey % 9, '\",\"analysis\":{\"state\":\"not_affected\"},\"affects\":[{\"ref\":\"f\"}]}]}') END"
)


def _boms(spark: SparkSession, sf: str) -> DataFrame:
    return documents_of(spark, sf, _sql_expr(_BOM))


_OK = "FROM orders WHERE o_orderkey % 8 < 6"


@query(
    "cyclonedx_components",
    f"SELECT o_orderkey AS doc_id, 'library' AS type, 'a' || o_custkey AS name, (o_orderkey % 5)::VARCHAR AS version, 'ref' || o_orderkey AS bom_ref, 1::INT AS "
    f"n_hashes {_OK} UNION ALL SELECT o_orderkey, 'file', NULL, NULL, 'f', 0 {_OK}",
)
def cyclonedx_components(spark: SparkSession, sf: str) -> DataFrame:
    return S.cyclonedx_components(_boms(spark, sf)).withColumn(
        "n_hashes", F.when(F.col("hashes").isNull(), 0).otherwise(F.size("hashes"))
    ).drop("hashes")


@query(
    "normalize_cyclonedx",
    f"SELECT o_orderkey AS doc_id, 'library' AS type, 'a' || o_custkey AS name, (o_orderkey % 5)::VARCHAR AS version, 'ref' || o_orderkey AS bom_ref, 1::INT AS "
    f"n_hashes {_OK} UNION ALL SELECT o_orderkey, 'file', NULL, NULL, 'f', 0 {_OK}",
)
def normalize_cyclonedx(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of ``cyclonedx_components`` through the pluggable table function."""
    found = normalizers.normalized(_boms(spark, sf), normalizers.CYCLONEDX_COMPONENTS)
    return found.withColumn("n_hashes", F.when(F.col("hashes").isNull(), 0).otherwise(F.size("hashes"))).drop("hashes")


_BASELINE = (
    "CASE o_orderkey % 8 WHEN 6 THEN '{\"version\":\"1\",\"results\":{\"a\":[{}]},\"plugins_used\":[]}' WHEN 7 THEN 'x' ELSE concat('{\"version\":\"1.4\",\"plugins_used\":[],\"results\":{\"src/a', "
    "o_custkey, '.ts\":[{\"type\":\"AWS Access Key\",\"line_number\":', o_orderkey % 90, ',\"hashed_secret\":\"h', o_orderkey, '\"},{\"type\":\"JWT\",\"is_verified\":true}],\"b.env\":[]}}') END"
)


@query(
    "normalize_detect_secrets",
    f"SELECT o_orderkey AS doc_id, 'src/a' || o_custkey || '.ts' AS path, 'AWS Access Key' AS type, o_orderkey % 90 AS line, 'h' || o_orderkey AS hashed_secret, false AS verified {_OK} "
    f"UNION ALL SELECT o_orderkey, 'src/a' || o_custkey || '.ts', 'JWT', NULL, NULL, true {_OK}",
)
def normalize_detect_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """A map of lists as rows, through SQL."""
    normalizers.register_normalizers(spark)
    dealt(documents_of(spark, sf, _sql_expr(_BASELINE)), "doc_id").createOrReplaceTempView("secret_baselines")
    return spark.sql("SELECT d.doc_id, n.* FROM secret_baselines d, LATERAL normalize(d.raw, 'detect-secrets') n")


@query(
    "cyclonedx_dependencies",
    f"SELECT o_orderkey AS doc_id, 'ref' || o_orderkey AS ref, 'f' AS depends_on {_OK} UNION ALL SELECT o_orderkey, 'ref' || o_orderkey, 'g' || (o_custkey % 3) {_OK}",
)
def cyclonedx_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    return S.cyclonedx_dependencies(_boms(spark, sf))


@query(
    "cyclonedx_issues",
    "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 8 = 6 THEN 'MALFORMED_COMPONENT' ELSE 'NOT_CYCLONEDX' END AS issue FROM orders WHERE o_orderkey % 8 > 5",
)
def cyclonedx_issues(spark: SparkSession, sf: str) -> DataFrame:
    return S.cyclonedx_issues(_boms(spark, sf))


@query(
    "vex_assertions",
    f"SELECT o_orderkey AS doc_id, 'V' || (o_custkey % 9) AS vuln_id, 'not_affected' AS state, 1::INT AS n_affects {_OK}",
)
def vex_assertions(spark: SparkSession, sf: str) -> DataFrame:
    return S.vex_assertions(_boms(spark, sf))


_SPDX = (
    "CASE o_orderkey % 8 WHEN 6 THEN '{\"spdxVersion\":\"SPDX-2.3\",\"files\":[{\"SPDXID\":\"f\"}]}' WHEN 7 THEN '[]' ELSE concat('{\"spdxVersion\":\"SPDX-2.3\","
    "\"packages\":[{\"SPDXID\":\"p', o_orderkey, '\",\"name\":\"n', o_custkey, '\",\"versionInfo\":\"1\"}],\"relationships\":[{\"spdxElementId\":\"d\","
    "\"relationshipType\":\"DESCRIBES\",\"relatedSpdxElement\":\"p', o_orderkey, '\"}]', CASE WHEN o_orderstatus = 'F' THEN ',\"files\":[{\"SPDXID\":\"f1\","
    "\"fileName\":\"./a\"}]' ELSE '' END, '}') END"
)


@query(
    "spdx_items",
    f"SELECT o_orderkey AS doc_id, 'package' AS kind, 'p' || o_orderkey AS id, 'n' || o_custkey AS name, '1' AS related {_OK} UNION ALL SELECT o_orderkey, "
    f"'relationship', 'd', 'DESCRIBES', 'p' || o_orderkey {_OK} UNION ALL SELECT o_orderkey, 'file', 'f1', './a', NULL {_OK} AND o_orderstatus = 'F'",
)
def spdx_items(spark: SparkSession, sf: str) -> DataFrame:
    return S.spdx_items(documents_of(spark, sf, _sql_expr(_SPDX)))


@query(
    "spdx_issues",
    "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 8 = 6 THEN 'MALFORMED_COLLECTION' ELSE 'NOT_SPDX' END AS issue FROM orders WHERE o_orderkey % 8 > 5",
)
def spdx_issues(spark: SparkSession, sf: str) -> DataFrame:
    return S.spdx_issues(documents_of(spark, sf, _sql_expr(_SPDX)))


# --------------------------------------------------------------------------- in-toto
_STATEMENT = (
    "concat('{\"_type\":\"https://in-toto.io/Statement/v1\",\"subject\":[{\"name\":\"app', o_custkey, '\",\"digest\":{\"sha256\":\"', sha2(string(o_orderkey), 256), "
    "'\",\"gitCommit\":\"c', o_custkey % 7, '\"}}],\"predicate\":', CASE WHEN o_orderstatus = 'F' THEN '{\"builder\":{\"id\":\"b1\"},\"invocation\":{\"configSource\":"
    "{\"uri\":\"git+x\"}}}' ELSE '{\"runDetails\":{\"builder\":{\"id\":\"b2\"},\"metadata\":{\"invocationId\":\"i9\"}}}' END, '}')"
)
# digest algorithm names are lower-case tokens, so gitCommit makes a statement invalid; it is renamed below
_STATEMENT = _STATEMENT.replace("gitCommit", "sha1")


def _attestations(spark: SparkSession, sf: str) -> DataFrame:
    st = F.expr(_STATEMENT)
    b64 = F.base64(F.encode(st, "UTF-8"))
    b64 = F.regexp_replace(b64, r"\s", "")
    k = F.col("o_orderkey") % 7
    head = F.lit('{"payloadType":"application/vnd.in-toto+json","payload":"')
    sig = F.lit('","signatures":[{"keyid":"k","sig":"s"}]}')
    raw = (
        F.when(k == 0, F.concat(head, b64, sig))
        .when(k == 1, F.concat(F.lit('{"payload":'), st, F.lit("}")))
        .when(k == 2, F.concat(head, b64, F.lit('","signatures":[]}')))
        .when(k == 3, '{"_type":"x","subject":[]}')
        .when(k == 4, F.concat(head, F.lit("%%%"), sig))
        .otherwise(st)
    )
    return documents_of(spark, sf, raw)


_ATT_OK = "FROM orders WHERE o_orderkey % 7 IN (0, 1, 5, 6)"
_ATT_COMMON = (
    "o_orderkey AS doc_id, CASE o_orderkey % 7 WHEN 0 THEN 'dsse' WHEN 1 THEN 'legacy-wrapper' ELSE 'statement' END AS envelope_type, (o_orderkey % 7 = 0)::INT "
    "AS signatures, CASE WHEN o_orderstatus = 'F' THEN 'b1' ELSE 'b2' END AS builder, CASE WHEN o_orderstatus = 'F' THEN 'git+x' ELSE 'i9' END AS invocation, "
    "'app' || o_custkey AS name"
)


@query(
    "provenance_subjects",
    f"SELECT {_ATT_COMMON}, 'sha256' AS algorithm, sha256(o_orderkey::VARCHAR) AS value {_ATT_OK} UNION ALL SELECT {_ATT_COMMON}, 'sha1', 'c' || (o_custkey % 7) {_ATT_OK}",
)
def provenance_subjects(spark: SparkSession, sf: str) -> DataFrame:
    return S.provenance_subjects(_attestations(spark, sf))


@query(
    "in_toto_issues",
    "SELECT o_orderkey AS doc_id, CASE o_orderkey % 7 WHEN 3 THEN 'MISSING_SUBJECT' ELSE 'INVALID_ENVELOPE' END AS issue FROM orders WHERE o_orderkey % 7 IN (2, 3, 4)",
)
def in_toto_issues(spark: SparkSession, sf: str) -> DataFrame:
    return S.in_toto_issues(_attestations(spark, sf))


# --------------------------------------------------------------------------- Trivy
_TRIVY = (
    "concat('{\"Results\":[{\"Target\":\"app', o_custkey % 4, '/package.json\",\"Vulnerabilities\":[{\"VulnerabilityID\":\"CVE-', o_orderkey % 99, '\",\"Severity\":\"HIGH\","
    "\"PkgName\":\"p', o_custkey % 30, '\",\"InstalledVersion\":\"1.0\",\"FixedVersion\":\"1.1\"},{\"VulnerabilityID\":\"CVE-0\",\"PkgName\":\"q\"}]},{\"Target\":\"', "
    "CASE WHEN o_orderstatus = 'F' THEN 'Dockerfile' ELSE '/abs' END, '\",\"Misconfigurations\":[{\"ID\":\"DS001\",\"Title\":\"root user\",\"Severity\":\"odd\",\"CauseMetadata\":"
    "{\"StartLine\":3}}],\"Secrets\":[{\"RuleID\":\"aws\",\"Severity\":\"CRITICAL\",\"StartLine\":', o_custkey % 3, '}]}]}')"
)


@query(
    "import_trivy",
    "SELECT 'subject:' || o_custkey AS subject_id, 'trivy.vulnerability.CVE-' || (o_orderkey % 99) AS rule, 'CVE-' || (o_orderkey % 99) AS title, 'high' AS severity, "
    "'unknown:p' || (o_custkey % 30) || '@1.0' AS package, NULL AS path, NULL::BIGINT AS start_line, 'security.vulnerability' AS category FROM orders UNION ALL SELECT "
    "'subject:' || o_custkey, 'trivy.misconfiguration.DS001', 'root user', 'unknown', NULL, 'Dockerfile', 3, 'configuration.misconfiguration' FROM orders WHERE "
    "o_orderstatus = 'F' UNION ALL SELECT 'subject:' || o_custkey, 'trivy.secret.aws', 'aws', 'critical', NULL, 'Dockerfile', o_custkey % 3, 'security.secret' FROM orders "
    "WHERE o_orderstatus = 'F' AND o_custkey % 3 > 0",
)
def import_trivy(spark: SparkSession, sf: str) -> DataFrame:
    return S.import_trivy(documents_of(spark, sf, _sql_expr(_TRIVY))).select(
        "subject_id", "rule", "title", "severity", "package", "path", "start_line", "category"
    )


@query(
    "trivy_omitted",
    "SELECT o_orderkey AS doc_id, (1 + CASE WHEN o_orderstatus <> 'F' THEN 2 WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS omitted FROM orders",
)
def trivy_omitted(spark: SparkSession, sf: str) -> DataFrame:
    return S.trivy_omitted(documents_of(spark, sf, _sql_expr(_TRIVY)))


_FAIL = ["", "missing-engine", "stale-database", "incompatible-output", "database-error", "execution-error"]


@query(
    "run_failure_label",
    "WITH f AS (SELECT s_suppkey, nullif(" + sql_pick(_FAIL, f"s_suppkey % {len(_FAIL)}") + ", '') AS k FROM supplier) SELECT s_suppkey, CASE WHEN k IS NULL THEN "
    "'complete' ELSE 'incomplete' END AS coverage, k AS reason FROM f",
)
def run_failure_label(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.nullif(pick(_FAIL, F.pmod("s_suppkey", F.lit(len(_FAIL)))), F.lit(""))
    return table(spark, sf, "supplier").select("s_suppkey", S.run_failure_label(kind).alias("x")).select("s_suppkey", "x.*")


# --------------------------------------------------------------------------- classification and bounds
_DOCS = [
    ('{"version":"2.1.0","runs":[]}', "sarif", "2.1.0"),
    ('{"bomFormat":"CycloneDX","specVersion":"1.5"}', "cyclonedx", "1.5"),
    ('{"spdxVersion":"SPDX-2.3"}', "spdx", "SPDX-2.3"),
    ('{"subject":[{}],"predicateType":"x"}', "in-toto", "statement"),
    ('{"payloadType":"t","payload":"p","signatures":[]}', "in-toto", "dsse"),
    ('{"version":"1.4","results":{},"plugins_used":[]}', "detect-secrets", "1.4"),
    ('{"version":"1","runs":[],"spdxVersion":"2"}', "AMBIGUOUS_FORMAT", None),
    ('{"version":"1","runs":{}}', "UNKNOWN_FORMAT", None),
    ("{oops", "INVALID_JSON", None),
    ("[1,2]", "UNKNOWN_FORMAT", None),
]


@query(
    "classify_evidence_format",
    "SELECT l_orderkey, l_linenumber, l_partkey, " + sql_pick([d[1] for d in _DOCS], f"l_partkey % {len(_DOCS)}") + " AS format, (["
    + ", ".join(_opt(d[2]) for d in _DOCS) + f"])[(l_partkey % {len(_DOCS)})::INT + 1] AS version FROM lineitem",
)
def classify_evidence_format(spark: SparkSession, sf: str) -> DataFrame:
    raw = pick([d[0] for d in _DOCS], F.pmod("l_partkey", F.lit(len(_DOCS))))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", raw.alias("raw"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", S.classify_format(F.col("raw")).alias("f")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "f.format", "f.version"
    )


@query(
    "json_bounds",
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'OK' WHEN 1 THEN 'TOO_DEEP' WHEN 2 THEN 'TOO_MANY_ITEMS' WHEN 3 THEN 'INVALID_JSON' ELSE 'TOO_LARGE' END AS "
    "bounds_code FROM events",
)
def json_bounds(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 5
    raw = (
        F.when(k == 0, F.col("props"))
        .when(k == 1, F.concat(F.lit('{"a":{"b":{"c":'), "props", F.lit("}}}")))
        .when(k == 2, F.concat(F.lit('{"l":['), F.array_join(F.sequence(F.lit(1), F.lit(9)), ","), F.lit("]}")))
        .when(k == 3, F.concat("props", F.lit("}")))
        .otherwise(F.concat(F.lit('{"p":"'), F.repeat(F.lit("x"), 300), F.lit('"}')))
    )
    docs = table(spark, sf, "events").select("event_id", raw.alias("raw"))
    # the root has depth 0, so the nested text is one level too deep
    return S.json_bounds(docs, max_bytes=256, max_depth=3, max_items=8).select("event_id", "bounds_code")


# --------------------------------------------------------------------------- sinks
@query(
    "json_report",
    "WITH " + TABLE_FINDINGS_CTE + " SELECT repo_id, to_json({'file': file, 'line': line, 'report_version': '2.0.0', 'rule': rule, 'severity': severity, 'snippet': "
    "snippet, 'verified': NULL::BOOLEAN})::VARCHAR AS value FROM findings",
)
def json_report(spark: SparkSession, sf: str) -> DataFrame:
    f = table_findings(spark, sf).select("repo_id", "rule", "severity", "file", "line", "snippet")
    report = sinks.json_report(f.select("repo_id", "rule", "severity", "file", "line", "snippet"))
    # the repository is the partition column of the written report
    return report.select("repo_id", F.regexp_replace("value", r'"repo_id":"[^"]*",', "").alias("value"))


_BUCKET = "(('0x' || left(sha256({x}), 8))::BIGINT % n)"
_SARIF_HEAD = '{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"results":['
_SARIF_TAIL = '],"tool":{"driver":{"name":"assayline","version":"1.0.0"}}}],"version":"2.1.0"}'


@query(
    "export_sarif",
    f"""WITH f AS (SELECT 's' || l_suppkey AS subject_id, '{{"level":"' || CASE WHEN l_tax > 0.05 THEN 'error' ELSE 'warning' END || '","locations":[{{"physicalLocation":{{"artifactLocation":
{{"uri":"src/f' || (l_partkey % 90) || '.ts"}},"region":{{"startLine":' || l_linenumber || '}}}}}}],"message":{{"text":"m' || l_orderkey || '"}},"properties":{{"assayline.subjectId":"s' || l_suppkey ||
'"}},"ruleId":"' || l_returnflag || '"}}' AS r FROM lineitem), n AS (SELECT subject_id, ceil(count(*) / 100)::BIGINT AS n FROM f GROUP BY 1), c AS (SELECT f.subject_id,
{_BUCKET.format(x='r')} AS chunk, r FROM f JOIN n USING (subject_id)) SELECT subject_id, chunk, sha256({quote(_SARIF_HEAD)} || string_agg(r, ',' ORDER BY r) || {quote(_SARIF_TAIL)}) AS document
FROM c GROUP BY ALL""".replace('"artifactLocation":\n', '"artifactLocation":').replace("l_suppkey ||\n'\"}", "l_suppkey || '\"}"),
)
def export_sarif(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("subject_id"), F.col("l_returnflag").alias("rule"),
        F.when(F.col("l_tax") > 0.05, "error").alias("level"), F.concat(F.lit("m"), F.col("l_orderkey").cast("string")).alias("message"),
        F.concat(F.lit("src/f"), (F.col("l_partkey") % 90).cast("string"), F.lit(".ts")).alias("uri"), F.col("l_linenumber").alias("line"),
    )
    return sinks.export_sarif(f, 100).select("subject_id", "chunk", F.sha2("document", 256).alias("document"))


@query(
    "export_bom",
    "SELECT o_orderkey AS doc_id, 'cyclonedx' AS format, '{\"bomFormat\":\"CycloneDX\",\"components\":[{\"bom-ref\":\"ref' || o_orderkey || '\",\"hashes\":[{\"alg\":\"SHA-256\",\"content\":\"ff\"}],\"name\":\"a' "
    "|| o_custkey || '\",\"type\":\"library\",\"version\":\"' || (o_orderkey % 5) || '\"},{\"bom-ref\":\"f\",\"type\":\"file\"}],\"dependencies\":[{\"dependsOn\":[\"f\",\"g' || (o_custkey % 3) || '\"],\"ref\":\"ref' || "
    "o_orderkey || '\"},{\"ref\":\"f\"}],\"specVersion\":\"1.5\",\"vulnerabilities\":[{\"affects\":[{\"ref\":\"f\"}],\"analysis\":{\"state\":\"not_affected\"},\"id\":\"V' || (o_custkey % 9) || '\"}]}' AS document "
    f"{_OK} UNION ALL SELECT -o_orderkey - 1, 'spdx', '{{' || CASE WHEN o_orderstatus = 'F' THEN '\"files\":[{{\"SPDXID\":\"f1\",\"fileName\":\"./a\"}}],' ELSE '' END || '\"packages\":[{{\"SPDXID\":\"p' || o_orderkey || "
    "'\",\"name\":\"n' || o_custkey || '\",\"versionInfo\":\"1\"}],\"relationships\":[{\"relatedSpdxElement\":\"p' || o_orderkey || '\",\"relationshipType\":\"DESCRIBES\",\"spdxElementId\":\"d\"}],\"spdxVersion\":"
    f"\"SPDX-2.3\"}}' {_OK}",
)
def export_bom(spark: SparkSession, sf: str) -> DataFrame:
    spdx = documents_of(spark, sf, _sql_expr(_SPDX)).withColumn("doc_id", -F.col("doc_id") - 1)
    return sinks.export_bom(_boms(spark, sf).unionByName(spdx))


@query(
    "release_statement",
    f"""WITH s AS (SELECT DISTINCT 'sha256:m' || (l_suppkey % 30) AS manifest_digest, 'urn:x:subject:artifact:sha256:' || sha256(l_partkey::VARCHAR) AS subject_id FROM lineitem),
n AS (SELECT manifest_digest, ceil(count(*) / 200)::BIGINT AS n FROM s GROUP BY 1), c AS (SELECT s.*, {_BUCKET.format(x='subject_id')} AS chunk FROM s JOIN n USING (manifest_digest))
SELECT manifest_digest, chunk, sha256('{{"_type":"https://in-toto.io/Statement/v1","predicate":{{"manifestDigest":"' || manifest_digest || '","subjectIds":[' || string_agg('"' || subject_id || '"', ','
ORDER BY subject_id) || ']}},"predicateType":"https://assayline.example/release/v1","subject":[' || string_agg('{{"digest":{{"sha256":"' || right(subject_id, 64) || '"}},"name":"' || subject_id || '"}}', ','
ORDER BY subject_id) || ']}}') AS statement FROM c GROUP BY manifest_digest, chunk""",
)
def release_statement(spark: SparkSession, sf: str) -> DataFrame:
    subjects = table(spark, sf, "lineitem").select(
        F.concat(F.lit("sha256:m"), (F.col("l_suppkey") % 30).cast("string")).alias("manifest_digest"),
        F.concat(F.lit("urn:x:subject:artifact:sha256:"), F.sha2(F.col("l_partkey").cast("string"), 256)).alias("subject_id"),
    )
    return sinks.release_statement(subjects.select("manifest_digest"), subjects, 200).select(
        "manifest_digest", "chunk", F.sha2("statement", 256).alias("statement")
    )


_ = sql_list
