"""Scalar functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.functions import digest as D
from assayline.functions import severity as S
from assayline.functions import text as T
from workloads import query
from workloads.bindings import PATH_SHAPES, SHAPED_PATHS_CTE, pick, quote, rx, shaped_paths, sql_pick, table

_REDACT = "text"
for _p, _ci in T.SECRET_SHAPES:
    _REDACT = f"regexp_replace({_REDACT}, {rx(_p, _ci)}, '[REDACTED]', 'g')"
_SYNTH = f"regexp_replace(text, {rx(T.ASSIGNMENT, True)}, '\\1=[synthetic-secret]', 'g')"
for _i in T.SYNTHETIC_SHAPES:
    _SYNTH = f"regexp_replace({_SYNTH}, {rx(*T.SECRET_SHAPES[_i])}, '[synthetic-secret]', 'g')"


@query("redact_text", f"SELECT doc_id, sha256({_REDACT}) AS redacted FROM documents")
def redact_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.redact_text(F.col("text")), 256).alias("redacted"))


@query(
    "redact_paths",
    f"SELECT page_id, replace(replace({_REDACT.replace('text', 'url', 1)}, 'example.com', '[REDACTED_PATH]'), "
    "'/en', '[REDACTED_PATH]') AS redacted FROM pages",
)
def redact_paths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        "page_id", T.redact_text(F.col("url"), ["/en", "example.com"]).alias("redacted")
    )


@query("synthesize_text", f"SELECT doc_id, sha256({_SYNTH}) AS synthetic FROM documents")
def synthesize_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", F.sha2(T.synthesize_text(F.col("text")), 256).alias("synthetic")
    )


@query(
    "mask_snippet",
    "SELECT doc_id, regexp_replace(text, '[A-Za-z0-9+/=_\\-]{8,}', '****', 'g') AS masked FROM documents",
)
def mask_snippet(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.mask_history_snippet(F.col("text")).alias("masked"))


@query(
    "truncate_utf8",
    "WITH c AS (SELECT doc_id, text, unnest(range(0, 121)) AS k FROM documents) SELECT doc_id, left(text, "
    "max(k) FILTER (strlen(left(text, k)) <= 120)::BIGINT) AS value, any_value(strlen(text)) > 120 AS truncated "
    "FROM c GROUP BY doc_id, text",
)
def truncate_utf8(spark: SparkSession, sf: str) -> DataFrame:
    t = T.truncate_utf8(F.col("text"), 120)
    return table(spark, sf, "documents").select("doc_id", t.alias("t")).select("doc_id", "t.value", "t.truncated")


# Fixed values (ours): words compared with part names.
_WORDS = ["red bolt", "small wing", "blue widgit", "large gear", "tiny rin"]


@query(
    "levenshtein",
    "WITH w AS (SELECT p_partkey, p_name, " + sql_pick(_WORDS, f"p_partkey % {len(_WORDS)}")
    + " AS word FROM part) SELECT p_partkey, CASE WHEN levenshtein(p_name, word) <= 4 THEN levenshtein(p_name, word) "
    "ELSE -1 END::INT AS distance FROM w",
)
def levenshtein(spark: SparkSession, sf: str) -> DataFrame:
    word = pick(_WORDS, F.pmod(F.col("p_partkey"), F.lit(len(_WORDS))))
    return table(spark, sf, "part").select(
        "p_partkey", F.levenshtein(F.col("p_name"), word, 4).alias("distance")
    )


# URL shapes (ours): the page URL with some hosts swapped for local ones.
_HOSTS = [
    "", "http://localhost:3000/a", "http://10.0.0.5/x", "https://172.20.1.1/", "https://172.40.1.1/",
    "http://192.168.0.9:8080", "http://127.0.0.1", "http://169.254.169.254/latest", "http://[::1]/",
    "ftp://10.0.0.1/", "https://u:p@10.1.1.1/", "http://300.1.1.1/", "http://0.0.0.0/", "not a url",
]
_URL = f"CASE WHEN page_id % {len(_HOSTS)} = 0 THEN url ELSE " + sql_pick(_HOSTS, f"page_id % {len(_HOSTS)}") + " END"


def _urls(spark: SparkSession, sf: str) -> DataFrame:
    i = F.pmod(F.col("page_id"), F.lit(len(_HOSTS)))
    return table(spark, sf, "pages").select("page_id", F.when(i == 0, F.col("url")).otherwise(pick(_HOSTS, i)).alias("u"))


@query(
    "is_private_url",
    f"""WITH u AS (SELECT page_id, {_URL} AS u FROM pages),
h AS (SELECT page_id, u, regexp_replace(lower(regexp_extract(u, '(?i)^https?://(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/:?#]*)', 1)),
  '^\\[|\\]$', '', 'g') AS h FROM u),
o AS (SELECT *, list_transform(string_split(h, '.'), lambda p: CASE WHEN regexp_full_match(p, '[0-9]{{1,3}}') THEN p::INT END)
  AS o FROM h)
SELECT page_id, u AS url, regexp_matches(u, '(?i)^https?://') AND (h IN ('localhost', 'localhost.localdomain', '::1',
 '0.0.0.0', '169.254.169.254') OR coalesce(len(o) = 4 AND len(list_filter(o, lambda x: x BETWEEN 0 AND 255)) = 4 AND
 (o[1] = 10 OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31) OR (o[1] = 192 AND o[2] = 168) OR o[1] = 127), false)) AS private
FROM o""",
)
def is_private_url(spark: SparkSession, sf: str) -> DataFrame:
    return _urls(spark, sf).select("page_id", F.col("u").alias("url"), T.is_private_url(F.col("u")).alias("private"))


@query(
    "safe_https_url",
    f"WITH u AS (SELECT page_id, {_URL} AS u FROM pages) SELECT page_id, length(u) BETWEEN 1 AND 2048 AND "
    "regexp_matches(u, '(?i)^https://') AND NOT regexp_matches(u, '[@?#\\s]') AND length(u) > 8 AS safe FROM u",
)
def safe_https_url(spark: SparkSession, sf: str) -> DataFrame:
    return _urls(spark, sf).select("page_id", T.safe_https_url(F.col("u")).alias("safe"))


_BASE = "list_last(string_split(path, '/'))"


def _vend(group: int) -> str:
    return "coalesce(" + ", ".join(
        f"nullif(regexp_extract(trim({_BASE}), {rx(p, True)}, {group}), '')" for p in T.VENDORED_NAME_SHAPES
    ) + ")"


@query(
    "parse_vendored_name",
    f"WITH {SHAPED_PATHS_CTE} SELECT doc_id, path, lower({_vend(1)}) AS name, {_vend(2)} AS version, "
    f"regexp_matches(path, {rx('|'.join(T.VENDORED_DIRS), True)}) AS vendored FROM shaped_paths",
)
def parse_vendored_name(spark: SparkSession, sf: str) -> DataFrame:
    parsed = T.parse_vendored_name(T.basename(F.col("path")))
    return (
        shaped_paths(spark, sf)
        .select("doc_id", "path", parsed.alias("v"), T.is_vendored_path(F.col("path")).alias("vendored"))
        .select("doc_id", "path", "v.name", "v.version", "vendored")
    )


_SPECIFIERS = [
    "react", "./local", "../up/file", "@scope/pkg/sub/file", "lodash/fp", "node:fs", "fs", "#internal", "/abs/x",
    "@solo", "crypto", "next/router", "url", "path/posix",
]


@query(
    "package_from_specifier",
    "WITH s AS (SELECT event_id, " + sql_pick(_SPECIFIERS, f"event_id % {len(_SPECIFIERS)}") + " AS s FROM events), "
    "n AS (SELECT event_id, s, string_split(s, '/') AS p FROM s), "
    "m AS (SELECT event_id, s, CASE WHEN starts_with(s, '@') THEN array_to_string(p[1:2], '/') ELSE p[1] END AS n FROM n) "
    "SELECT event_id, s AS specifier, CASE WHEN NOT regexp_matches(s, '^(\\.|/|#|node:)') AND n NOT IN ("
    + ", ".join(quote(b) for b in T.BUILTIN_MODULES) + ") THEN n END AS package FROM m",
)
def package_from_specifier(spark: SparkSession, sf: str) -> DataFrame:
    s = pick(_SPECIFIERS, F.pmod(F.col("event_id"), F.lit(len(_SPECIFIERS))))
    return table(spark, sf, "events").select("event_id", s.alias("specifier")).withColumn(
        "package", T.package_from_specifier(F.col("specifier"))
    )


@query(
    "valid_npm_name",
    "SELECT p_partkey, n AS name, regexp_full_match(n, '(?i)(?:@[a-z0-9-][a-z0-9._-]*/)?[a-z0-9-][a-z0-9._-]*') AS valid "
    "FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '-') WHEN 2 THEN "
    "'@' || replace(p_name, ' ', '/') ELSE '.' || p_brand END AS n FROM part)",
)
def valid_npm_name(spark: SparkSession, sf: str) -> DataFrame:
    n = F.expr(
        "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '-') WHEN 2 THEN "
        "concat('@', replace(p_name, ' ', '/')) ELSE concat('.', p_brand) END"
    )
    return table(spark, sf, "part").select("p_partkey", n.alias("name")).withColumn(
        "valid", T.valid_npm_name(F.col("name"))
    )


_OCI = [
    "nginx:1.25", "ghcr.io/acme/app:v1", "localhost:5000/app", "localhost/app:dev", "acme/app@sha256:abc",
    "registry.example.com:443/a/b/c:tag", "nginx", "https://x/y:1", "a b:c", "a@b@c", "app:",
]


@query(
    "parse_oci_reference",
    "WITH s AS (SELECT event_id, " + sql_pick(_OCI, f"event_id % {len(_OCI)}") + " AS ref FROM events), "
    "a AS (SELECT *, contains(ref, '@') AS has_d, string_split(ref, '@')[1] AS base FROM s), "
    "b AS (SELECT *, string_split(base, '/')[1] AS f FROM a), "
    "c AS (SELECT *, contains(base, '/') AND f <> '' AND (contains(f, '.') OR contains(f, ':') OR f = 'localhost') AS reg "
    "FROM b), d AS (SELECT *, CASE WHEN reg THEN substr(base, length(f) + 2) ELSE base END AS rest FROM c), "
    "e AS (SELECT *, NOT has_d AND regexp_matches(rest, ':[^/:]*$') AS tagged FROM d), "
    "g AS (SELECT *, CASE WHEN tagged THEN regexp_replace(rest, ':[^/:]*$', '') ELSE rest END AS repo, "
    "CASE WHEN tagged THEN regexp_extract(rest, ':([^/:]*)$', 1) END AS tag FROM e), "
    "h AS (SELECT *, NOT regexp_matches(ref, '\\s|://') AND len(string_split(ref, '@')) <= 2 AND repo <> '' AND "
    "(has_d OR coalesce(tag, '') <> '') AS ok FROM g) "
    "SELECT event_id, ref, CASE WHEN ok THEN CASE WHEN reg THEN f ELSE 'docker.io' END END AS registry, "
    "CASE WHEN ok THEN repo END AS repository, CASE WHEN ok THEN tag END AS tag, "
    "CASE WHEN ok AND has_d THEN string_split(ref, '@')[2] END AS digest FROM h",
)
def parse_oci_reference(spark: SparkSession, sf: str) -> DataFrame:
    ref = pick(_OCI, F.pmod(F.col("event_id"), F.lit(len(_OCI))))
    return (
        table(spark, sf, "events")
        .select("event_id", ref.alias("ref"))
        .select("event_id", "ref", T.parse_oci_reference(F.col("ref")).alias("o"))
        .select("event_id", "ref", "o.registry", "o.repository", "o.tag", "o.digest")
    )


_LICENSES = [
    "MIT", "Apache-2.0", "BSD-3-Clause", "isc", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "UNKNOWN", "Proprietary", "0BSD",
    "CC0-1.0", "AGPL-3.0-only", "MIT OR GPL-2.0",
]
_LICENSE_CLASS = (
    f"CASE WHEN regexp_matches(l, {rx(T.PERMISSIVE_LICENSE, True)}) THEN 'permissive' WHEN regexp_matches(l, "
    f"{rx(T.COPYLEFT_LICENSE, True)}) THEN 'copyleft' ELSE 'unknown' END"
)


@query(
    "license_class",
    "SELECT l AS license, " + _LICENSE_CLASS + " AS class, count(*)::BIGINT AS parts FROM (SELECT "
    + sql_pick(_LICENSES, f"p_partkey % {len(_LICENSES)}") + " AS l FROM part) GROUP BY ALL",
)
def license_class(spark: SparkSession, sf: str) -> DataFrame:
    name = pick(_LICENSES, F.pmod(F.col("p_partkey"), F.lit(len(_LICENSES))))
    return (
        table(spark, sf, "part")
        .select(name.alias("license"))
        .withColumn("class", T.license_class(F.col("license")))
        .groupBy("license", "class")
        .agg(F.count(F.lit(1)).alias("parts"))
    )


_SEVERITY_WORDS = [" Critical", "severe", "HIGH", "moderate", "Medium ", "low", "informational", "info", "", "bogus"]


@query(
    "normalize_severity",
    "WITH s AS (SELECT n_nationkey, r_name, " + sql_pick(_SEVERITY_WORDS, f"n_nationkey % {len(_SEVERITY_WORDS)}")
    + " AS s FROM nation JOIN region ON n_regionkey = r_regionkey), "
    "k AS (SELECT *, lower(trim(s)) AS k FROM s), "
    "n AS (SELECT *, CASE WHEN k IN ('critical', 'severe') THEN 'critical' WHEN k = 'high' THEN 'high' WHEN k IN "
    "('medium', 'moderate') THEN 'medium' WHEN k = 'low' THEN 'low' WHEN k IN ('info', 'informational') THEN 'info' ELSE "
    "'unknown' END AS n FROM k) SELECT n_nationkey, s AS original, n AS normalized, n = 'unknown' AS uncertain FROM n",
)
def normalize_severity(spark: SparkSession, sf: str) -> DataFrame:
    word = pick(_SEVERITY_WORDS, F.pmod(F.col("n_nationkey"), F.lit(len(_SEVERITY_WORDS))))
    return (
        table(spark, sf, "nation")
        .select("n_nationkey", word.alias("w"))
        .select("n_nationkey", S.normalize_severity(F.col("w")).alias("s"))
        .select("n_nationkey", "s.*")
    )


_LABELS = ["critical", "HIGH", "Moderate", "MEDIUM", "low", "", "none"]


@query(
    "advisory_severity",
    "SELECT s_suppkey, CASE upper(l) WHEN 'CRITICAL' THEN 'critical' WHEN 'HIGH' THEN 'high' WHEN 'MODERATE' THEN "
    "'medium' WHEN 'MEDIUM' THEN 'medium' WHEN 'LOW' THEN 'low' ELSE 'high' END AS severity FROM (SELECT s_suppkey, "
    + sql_pick(_LABELS, f"s_suppkey % {len(_LABELS)}") + " AS l FROM supplier)",
)
def advisory_severity(spark: SparkSession, sf: str) -> DataFrame:
    word = pick(_LABELS, F.pmod(F.col("s_suppkey"), F.lit(len(_LABELS))))
    return table(spark, sf, "supplier").select("s_suppkey", S.advisory_severity(word).alias("severity"))


_VERSIONS = ["1.0.0", "1.1.0", "1.1.4", "2.0.0", "0.9.0", "1.x", "1.10.0", "01.0.0", "1.0"]
_SEMVER = "^(0|[1-9][0-9]*)\\.(0|[1-9][0-9]*)\\.(0|[1-9][0-9]*)$"


@query(
    "schema_compatibility",
    "WITH v AS (SELECT o_orderkey, " + sql_pick(_VERSIONS, f"o_orderkey % {len(_VERSIONS)}") + " AS d, "
    + sql_pick(_VERSIONS, f"o_custkey % {len(_VERSIONS)}") + " AS r FROM orders), p AS (SELECT *, "
    f"regexp_matches(d, '{_SEMVER}') AND regexp_matches(r, '{_SEMVER}') AS ok, "
    "TRY_CAST(string_split(d, '.')[1] AS INT) AS dm, TRY_CAST(string_split(d, '.')[2] AS INT) AS dn, "
    "TRY_CAST(string_split(r, '.')[1] AS INT) AS rm, TRY_CAST(string_split(r, '.')[2] AS INT) AS rn FROM v) "
    "SELECT d AS document, r AS reader, CASE WHEN NOT ok THEN 'invalid' WHEN d = r THEN 'exact' WHEN dm = rm AND dn <= rn "
    "THEN 'backward-compatible' WHEN dm >= rm THEN 'upgrade-required' ELSE 'incompatible' END AS compatibility, "
    "count(*)::BIGINT AS n FROM p GROUP BY ALL",
)
def schema_compatibility(spark: SparkSession, sf: str) -> DataFrame:
    d = pick(_VERSIONS, F.pmod(F.col("o_orderkey"), F.lit(len(_VERSIONS))))
    r = pick(_VERSIONS, F.pmod(F.col("o_custkey"), F.lit(len(_VERSIONS))))
    return (
        table(spark, sf, "orders")
        .select(d.alias("document"), r.alias("reader"))
        .withColumn("compatibility", T.schema_compatibility(F.col("document"), F.col("reader")))
        .groupBy("document", "reader", "compatibility")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "canonical_json",
    "SELECT o_orderkey, to_json({'customer': o_custkey, 'flag': CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END, "
    "'id': o_orderkey, 'status': o_orderstatus})::VARCHAR AS doc FROM orders",
)
def canonical_json(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    doc = D.canonical_json(
        status=F.col("o_orderstatus"), id=F.col("o_orderkey"), customer=F.col("o_custkey"),
        flag=F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")),
    )
    return o.select("o_orderkey", doc.alias("doc"))


FINGERPRINT_SQL = (
    "'sha256:' || sha256(to_json({{'advisory': {advisory}, 'evidenceClass': {cls}, 'location': {location}, "
    "'package': {package}, 'rule': {rule}, 'subjectId': {subject}, 'version': 'v1'}}))"
)


@query(
    "fingerprint_v1",
    "SELECT l_orderkey, l_linenumber, l_partkey, "
    + FINGERPRINT_SQL.format(
        advisory="NULL::VARCHAR", cls="'native'", location="l_partkey::VARCHAR", package="NULL::VARCHAR",
        rule="l_returnflag", subject="l_orderkey::VARCHAR",
    )
    + " AS fingerprint FROM lineitem",
)
def fingerprint_v1(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        D.fingerprint_v1(
            F.col("l_orderkey"), F.lit("native"), location=F.col("l_partkey"), rule=F.col("l_returnflag")
        ).alias("fingerprint"),
    )


@query(
    "subject_id",
    "SELECT p_partkey, 'urn:assayline:subject:' || k || ':sha256:' || sha256(b) AS subject_id FROM (SELECT p_partkey, "
    "CASE p_partkey % 3 WHEN 0 THEN 'package' WHEN 1 THEN 'artifact' ELSE 'repository-tree' END AS k, "
    "CASE p_partkey % 3 WHEN 0 THEN '{\"ecosystem\":\"npm\",\"kind\":\"package\",\"name\":' || to_json(p_name) || "
    "',\"version\":\"' || p_size || '\"}' WHEN 1 THEN '{\"digest\":\"' || p_brand || '\",\"kind\":\"artifact\"}' ELSE "
    "'{\"commit\":\"' || p_partkey || '\",\"kind\":\"repository-tree\",\"vcs\":\"git\"}' END AS b FROM part)",
)
def subject_id(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'package' WHEN 1 THEN 'artifact' ELSE 'repository-tree' END")
    artifact = F.expr("p_partkey % 3 = 1")
    fields = {
        "kind": kind,
        "ecosystem": F.lit("npm"),
        "name": F.col("p_name"),
        "version": F.col("p_size").cast("string"),
        "digest": F.when(artifact, F.col("p_brand")),
        "vcs": F.lit("git"),
        "commit": F.col("p_partkey").cast("string"),
    }
    return table(spark, sf, "part").select("p_partkey", D.subject_id(fields).alias("subject_id"))


_REMOTES = [
    "git@github.com:acme/App.git", "https://github.com/acme/app/", " ssh://git@host.io/a/b.git ",
    "http://Example.com//x//y.git/", "", "plain/path",
]
_REMOTE_SQL = sql_pick(_REMOTES, f"o_custkey % {len(_REMOTES)}")
_CLEAN = f"regexp_replace({_REMOTE_SQL}, '^\\s+|\\s+$', '', 'g')"
for _pat, _rep in [
    ("(?i)^\\s*git@", ""), ("(?i)^\\s*https?://", ""), ("(?i)^\\s*ssh://git@", ""), (":", "/"), ("/{2,}", "/"),
    ("(?i)\\.git/?$", ""), ("/$", ""),
]:
    _CLEAN = f"regexp_replace({_CLEAN}, '{_pat}', '{_rep}', 'g')"


@query(
    "project_fingerprint",
    f"SELECT o_orderkey, CASE WHEN {_REMOTE_SQL} <> '' THEN sha256(o_custkey || '|' || lower({_CLEAN})) WHEN "
    "o_orderstatus <> 'P' THEN sha256(o_orderpriority || '|' || o_orderstatus) END AS fingerprint, CASE WHEN "
    f"{_REMOTE_SQL} <> '' THEN 'git' WHEN o_orderstatus <> 'P' THEN 'package' ELSE 'ephemeral' END AS source FROM orders",
)
def project_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    remote = pick(_REMOTES, F.pmod(F.col("o_custkey"), F.lit(len(_REMOTES))))
    f = D.project_fingerprint(
        F.col("o_custkey").cast("string"), remote,
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")), F.col("o_orderstatus"),
    )
    return (
        table(spark, sf, "orders").select("o_orderkey", f.alias("f")).select("o_orderkey", "f.fingerprint", "f.source")
    )


_H = "sha256(o_orderkey || ':' || o_custkey)"


@query(
    "uuid_from_text",
    f"SELECT o_orderkey, 'urn:uuid:' || substr({_H}, 1, 8) || '-' || substr({_H}, 9, 4) || '-4' || substr({_H}, 14, 3) "
    f"|| '-' || substr('89ab', (('0x' || substr({_H}, 17, 1))::INT % 4) + 1, 1) || substr({_H}, 18, 3) || '-' || "
    f"substr({_H}, 21, 12) AS id FROM orders",
)
def uuid_from_text(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.col("o_orderkey").cast("string"), F.lit(":"), F.col("o_custkey").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", D.uuid_from_text(text).alias("id"))


@query(
    "probe_predicates",
    "SELECT page_id, contains(html, 'track') AS contains_needle, list_contains(string_split_regex(url, '[\\\\/]+'), '..') "
    "AS path_traversal, regexp_matches(url, '[;&|`$()<>\\n\\r]') AS command_injection, "
    "regexp_matches(url, '(?i)^https?://(localhost|127\\.)') AS ssrf_target, page_id % 3 <> page_id % 2 AS "
    "tenant_mismatch, regexp_matches(html, '(?i)(?:[''\"`]\\s*(?:OR|AND)\\s+[''\"`]?\\w+[''\"`]?\\s*=|--|/\\*)') AS "
    "sql_injection, regexp_matches(html, '(?i)<script\\b|\\bon[a-z]+\\s*=|javascript\\s*:') AS unsafe_html, "
    "NOT list_contains(['read', 'list'], CASE WHEN page_id % 2 = 0 THEN 'read' ELSE 'write' END) AS tool_not_allowed "
    "FROM pages",
)
def probe_predicates(spark: SparkSession, sf: str) -> DataFrame:
    url, html, key = F.col("url"), F.col("html"), F.col("page_id")
    return table(spark, sf, "pages").select(
        "page_id",
        F.contains(html, F.lit("track")).alias("contains_needle"),
        T.probe_path_traversal(url).alias("path_traversal"),
        T.probe_command_injection(url).alias("command_injection"),
        T.is_private_url(url).alias("ssrf_target"),
        (F.pmod(key, F.lit(3)) != F.pmod(key, F.lit(2))).alias("tenant_mismatch"),
        T.probe_sql_injection(html).alias("sql_injection"),
        T.probe_unsafe_html(html).alias("unsafe_html"),
        T.probe_tool_not_allowed(
            F.when(F.pmod(key, F.lit(2)) == 0, "read").otherwise("write"), F.lit("read, list,")
        ).alias("tool_not_allowed"),
    )


_ = PATH_SHAPES
