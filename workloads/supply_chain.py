"""Supply-chain queries over ``part``, ``lineitem``, ``orders`` and ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.functions import text as T
from assayline.operators import inventory, supply
from assayline.sources import packages
from workloads import query
from workloads.bindings import (
    CODE_LINES_CTE, PATH_SHAPES, SHAPED_PATHS_CTE, code_files, pick, quote, rx, shaped_paths, sql_list, sql_pick, table,
)
from workloads.scalars import _LICENSE_CLASS, _LICENSES

NOW = "2024-01-31 00:00:00"

# --------------------------------------------------------------------------- bindings
_NAME = "concat(replace(p_name, ' ', '-'), '-', p_partkey)"
_VERSION = "concat(p_size, '.', p_partkey % 4, '.', p_partkey % 3)"


def part_packages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.expr(_NAME).alias("name"), F.expr(_VERSION).alias("version"))


def dependencies(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_partkey").alias("p_partkey"))
    return li.join(part_packages(spark, sf), "p_partkey").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("repo_id"), "name", "version"
    )


def advisories(spark: SparkSession, sf: str) -> DataFrame:
    """One advisory per part; only those of the economy type name a version that is in use."""
    p = table(spark, sf, "part")
    return p.select(
        F.expr(_NAME).alias("name"),
        F.when(F.col("p_type") == "ECONOMY", F.expr(_VERSION)).otherwise("0.0.0-none").alias("version"),
        F.concat(F.lit("ADV-"), F.col("p_partkey").cast("string")).alias("vuln_id"),
        pick(["CRITICAL", "moderate", "LOW", "", "HIGH"], F.pmod(F.col("p_partkey"), F.lit(5))).alias("raw_severity"),
        F.array(F.concat(F.lit("CVE-"), F.col("p_partkey").cast("string"))).alias("aliases"),
    )


def registry(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.expr(_NAME).alias("name"),
        (F.col("p_size") != 7).alias("exists"),
        F.expr(f"TIMESTAMP '{NOW}' - make_interval(0, 0, 0, 0, int(p_partkey % 48))").alias("checked_at"),
    )


_CTE = f"""pk AS (SELECT p_partkey, {_NAME} AS name, {_VERSION} AS version, p_size, p_type FROM part),
deps AS (SELECT 's' || l_suppkey AS repo_id, name, version FROM lineitem JOIN pk ON l_partkey = p_partkey),
adv AS (SELECT name, CASE WHEN p_type = 'ECONOMY' THEN version ELSE '0.0.0-none' END AS version, 'ADV-' || p_partkey AS vuln_id, 'CVE-' || p_partkey AS alias,
  (['CRITICAL', 'moderate', 'LOW', '', 'HIGH'])[(p_partkey % 5)::INT + 1] AS raw FROM pk),
reg AS (SELECT name, p_size <> 7 AS exists_, p_partkey % 48 AS age FROM pk)"""
_SEV = "CASE upper(raw) WHEN 'CRITICAL' THEN 'critical' WHEN 'HIGH' THEN 'high' WHEN 'MODERATE' THEN 'medium' WHEN 'LOW' THEN 'low' ELSE 'high' END"


@query(
    "vulnerable_dependencies",
    f"WITH {_CTE} SELECT DISTINCT repo_id, name AS package, version, vuln_id AS cve, {_SEV} AS severity FROM deps "
    "JOIN adv USING (name, version)",
)
def vulnerable_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    return supply.vulnerable_dependencies(dependencies(spark, sf), advisories(spark, sf)).select(
        "repo_id", "package", F.col("label").alias("version"), "cve", "severity"
    )


@query(
    "vendored_vulnerabilities",
    f"""WITH {SHAPED_PATHS_CTE}, b AS (SELECT repo_id, path, trim(list_last(string_split(path, '/'))) AS b FROM shaped_paths
 WHERE regexp_matches(path, {rx('|'.join(T.VENDORED_DIRS), True)})),
v AS (SELECT repo_id, path, lower(coalesce({', '.join(f"nullif(regexp_extract(b, {rx(p, True)}, 1), '')" for p in T.VENDORED_NAME_SHAPES)})) AS name,
 coalesce({', '.join(f"nullif(regexp_extract(b, {rx(p, True)}, 2), '')" for p in T.VENDORED_NAME_SHAPES)}) AS version FROM b),
o AS (SELECT repo_id, name, version, min(path) AS path FROM v WHERE name IS NOT NULL GROUP BY ALL),
a AS (SELECT DISTINCT name, version, 'ADV-' || name AS cve FROM v WHERE name IN ('jquery', 'chart'))
SELECT repo_id, path AS file, name AS package, version, cve, 'high' AS severity FROM o JOIN a USING (name, version)""",
)
def vendored_vulnerabilities(spark: SparkSession, sf: str) -> DataFrame:
    files = shaped_paths(spark, sf)
    parsed = files.where(T.is_vendored_path(F.col("path"))).select(
        T.parse_vendored_name(T.basename(F.col("path"))).alias("v")
    )
    adv = (
        parsed.where(F.col("v.name").isin("jquery", "chart"))
        .select("v.name", "v.version")
        .distinct()
        .select(
            "name", "version", F.concat(F.lit("ADV-"), "name").alias("vuln_id"), F.lit("").alias("raw_severity"),
            F.array().cast("array<string>").alias("aliases"),
        )
    )
    return supply.vendored_vulnerabilities(files, adv).select(
        "repo_id", "file", "package", F.col("label").alias("version"), "cve", "severity"
    )


@query(
    "external_dependencies",
    f"WITH {_CTE}, w AS (SELECT DISTINCT 's' || s_suppkey AS repo_id, name FROM supplier JOIN pk ON s_suppkey = p_partkey) "
    "SELECT d.repo_id, d.name, d.version FROM deps d WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.repo_id = d.repo_id AND "
    "w.name = d.name)",
)
def external_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("p_partkey")).join(
        part_packages(spark, sf), "p_partkey"
    )
    names = own.select(F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("repo_id"), "name")
    return supply.external_dependencies(dependencies(spark, sf), names).select("repo_id", "name", "version")


@query(
    "missing_packages",
    f"WITH {_CTE} SELECT DISTINCT repo_id, name AS package FROM deps JOIN reg USING (name) WHERE NOT exists_ AND age < 24",
)
def missing_packages(spark: SparkSession, sf: str) -> DataFrame:
    now = F.lit(NOW).cast("timestamp")
    return supply.missing_packages(dependencies(spark, sf), registry(spark, sf), now).select("repo_id", "package")


# Look-alikes: a popular name with the character at a varying place left out.
_POP = supply.POPULAR_PACKAGES


def squats(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("l_partkey")
    top = pick(_POP, F.pmod(key, F.lit(len(_POP))))
    at = F.pmod(key, F.length("top")) + 1
    return (
        table(spark, sf, "lineitem")
        .select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("repo_id"), "l_partkey", top.alias("top"))
        .select(
            "repo_id",
            F.when(F.pmod(key, F.lit(5)) == 0, F.col("top"))
            .otherwise(
                F.concat(F.substring("top", F.lit(1), (at - 1).cast("int")), F.substring("top", (at + 1).cast("int"), F.length("top")))
            )
            .alias("name"),
        )
    )


_SQUAT_CTE = f"""tops AS (SELECT 's' || l_suppkey AS repo_id, l_partkey AS k, {sql_pick(_POP, f"l_partkey % {len(_POP)}")} AS top
 FROM lineitem), squats AS (SELECT repo_id, CASE WHEN k % 5 = 0 THEN top ELSE left(top, (k % length(top))::INT) ||
 substr(top, (k % length(top))::INT + 2) END AS name FROM tops),
popular AS (SELECT unnest({sql_list(_POP)}) AS top, unnest(range(0, {len(_POP)})) AS pos),
names AS (SELECT DISTINCT name FROM squats),
near AS (SELECT name, pos, top, levenshtein(lower(name), lower(top)) AS d FROM names, popular WHERE levenshtein(lower(name), lower(top)) <= 2),
best AS (SELECT name, arg_min(top, d * 1000 + pos) AS top, min(d) AS distance FROM near GROUP BY 1 HAVING min(d) > 0)"""


@query(
    "lookalike_packages",
    f"WITH {_SQUAT_CTE} SELECT DISTINCT repo_id, name AS package, top AS label FROM squats JOIN best USING (name) "
    "WHERE length(name) % 3 <> 0",
)
def lookalike_packages(spark: SparkSession, sf: str) -> DataFrame:
    deps = squats(spark, sf)
    reg = deps.select("name").distinct().select(
        "name", (F.length("name") % 3 != 0).alias("exists"), F.lit(NOW).cast("timestamp").alias("checked_at")
    )
    return supply.lookalike_packages(deps, reg, F.lit(NOW).cast("timestamp")).select("repo_id", "package", "label")


@query(
    "lookalikes_by_key",
    f"WITH {_SQUAT_CTE} SELECT name, top, distance::INT AS distance FROM best",
)
def lookalikes_by_key(spark: SparkSession, sf: str) -> DataFrame:
    popular = table(spark, sf, "lineitem").sparkSession.createDataFrame(
        [(p, i) for i, p in enumerate(_POP)], "top string, pos int"
    )
    return supply.lookalikes_by_key(squats(spark, sf), popular)


@query(
    "package_verdict",
    f"""WITH {_CTE}, {_SQUAT_CTE.replace("names AS (SELECT DISTINCT name FROM squats)", "names AS (SELECT name FROM pk)")},
q AS (SELECT DISTINCT name, CASE WHEN p_partkey % 3 = 0 THEN 'latest' ELSE version END AS version, p_partkey FROM lineitem JOIN pk ON l_partkey = p_partkey),
l AS (SELECT name, version AS latest FROM pk WHERE p_size <> 9),
r AS (SELECT q.name, q.version, CASE WHEN p_partkey % 10 = 1 THEN NULL ELSE exists_ END AS e, latest, CASE WHEN q.version = 'latest' THEN coalesce(latest, 'latest') ELSE q.version END AS rv
  FROM q LEFT JOIN reg ON reg.name = q.name LEFT JOIN l ON l.name = q.name),
c AS (SELECT name, version AS rv, count(*) AS n, count(*) FILTER (upper(raw) IN ('CRITICAL', 'HIGH')) AS s FROM adv GROUP BY ALL)
SELECT r.name, r.version, CASE WHEN NOT e THEN 'block' WHEN e IS NULL THEN 'warn' WHEN coalesce(s, 0) > 0 THEN 'block'
  WHEN coalesce(n, 0) > 0 OR (r.version = 'latest' AND latest IS NULL) OR best.top IS NOT NULL THEN 'warn' ELSE 'safe' END AS verdict,
  CASE WHEN NOT e THEN 'complete' WHEN e IS NULL OR (r.version = 'latest' AND latest IS NULL) THEN 'incomplete' ELSE 'complete' END AS coverage,
  coalesce(n, 0)::BIGINT AS n_cves, best.top AS lookalike_of
FROM r LEFT JOIN c ON c.name = r.name AND c.rv = r.rv LEFT JOIN best ON best.name = r.name""",
)
def package_verdict(spark: SparkSession, sf: str) -> DataFrame:
    pk = part_packages(spark, sf)
    asked = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct().join(pk, "p_partkey")
    requests = asked.select(
        "name", F.when(F.pmod("p_partkey", F.lit(3)) == 0, "latest").otherwise(F.col("version")).alias("version")
    )
    reg = table(spark, sf, "part").select(
        F.expr(_NAME).alias("name"), F.expr("CASE WHEN p_partkey % 10 = 1 THEN NULL ELSE p_size <> 7 END").alias("exists")
    )
    known = F.when(F.col("p_size") != 9, F.expr(_NAME)).otherwise(F.concat(F.expr(_NAME), F.lit("-unlisted")))
    latest = table(spark, sf, "part").select(known.alias("name"), F.expr(_VERSION).alias("version"))
    return supply.package_verdict(requests, reg, advisories(spark, sf), latest)


_VERS = (
    "concat(p_size % 12, '.', p_partkey % 13, '.', p_partkey % 3, CASE WHEN p_partkey % 7 = 0 THEN '-beta.1' ELSE '' END)"
)


@query(
    "latest_stable_version",
    f"WITH v AS (SELECT p_brand AS name, {_VERS} AS version, p_size % 12 AS a, p_partkey % 13 AS b, p_partkey % 3 AS c FROM part "
    "WHERE NOT contains(" + _VERS + ", '-')) SELECT name, arg_max(version, a * 1000000 + b * 1000 + c) AS version FROM v GROUP BY 1",
)
def latest_stable_version(spark: SparkSession, sf: str) -> DataFrame:
    versions = table(spark, sf, "part").select(F.col("p_brand").alias("name"), F.expr(_VERS).alias("version"))
    return supply.latest_stable_version(versions)


_LIC = sql_pick(_LICENSES, f"l_partkey % {len(_LICENSES)}")
_SRC = "CASE WHEN l_partkey % 9 = 0 THEN '' ELSE 'https://src/' || (l_partkey % 5) END"


def _license_rows(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("l_partkey")
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("pkg"), (key % 300).cast("string")).alias("name"),
        F.concat((key % 7).cast("string"), F.lit(".0.0")).alias("version"),
        pick(_LICENSES, F.pmod(key, F.lit(len(_LICENSES)))).alias("license"),
        F.when(key % 9 == 0, "").otherwise(F.concat(F.lit("https://src/"), (key % 5).cast("string"))).alias("source"),
        key.alias("key"),
    )


@query(
    "license_inventory",
    f"""WITH p AS (SELECT DISTINCT 'pkg' || (l_partkey % 300) AS name, (l_partkey % 7) || '.0.0' AS version, {_LIC} AS l, {_SRC} AS source,
  l_partkey % 7 = 6 AS ok FROM lineitem),
k AS (SELECT *, CASE WHEN ok THEN 'owner-reviewed' ELSE {_LICENSE_CLASS} END AS class,
  CASE WHEN regexp_matches(name, '[05]$') THEN 'direct' ELSE 'transitive' END AS scope FROM p),
b AS (SELECT *, NOT ok AND (class <> 'permissive' OR source = '') AS blocked FROM k)
SELECT name, scope, l AS license, source, class, list_sort(list(DISTINCT version)) AS versions,
 count(*) FILTER (blocked)::BIGINT AS blockers, CASE WHEN bool_or(blocked) THEN CASE WHEN class <> 'permissive' THEN
 'license-review-required' ELSE 'source-missing' END END AS reason FROM b GROUP BY name, scope, l, source, class""",
)
def license_inventory(spark: SparkSession, sf: str) -> DataFrame:
    rows = _license_rows(spark, sf)
    direct = rows.where(F.col("name").rlike("[05]$")).select("name").distinct()
    decisions = rows.where(F.col("key") % 7 == 6)
    return supply.license_inventory(rows, direct, decisions)


@query(
    "license_inventory_gaps",
    f"WITH {_CTE}, l AS (SELECT DISTINCT CASE WHEN p_size = 3 THEN name || '-gone' ELSE name END AS name, version FROM pk), f AS (SELECT DISTINCT name, version FROM deps) "
    "SELECT coalesce(l.name, f.name) AS name, coalesce(l.version, f.version) AS version, CASE WHEN l.name IS NULL THEN "
    "'unexpected' ELSE 'missing' END AS side FROM l FULL JOIN f ON l.name = f.name AND l.version = f.version WHERE l.name IS "
    "NULL OR f.name IS NULL",
)
def license_inventory_gaps(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("p_size") == 3, F.concat(F.expr(_NAME), F.lit("-gone"))).otherwise(F.expr(_NAME))
    locked = table(spark, sf, "part").select(name.alias("name"), F.expr(_VERSION).alias("version"))
    return supply.license_inventory_gaps(locked, dependencies(spark, sf))


# --------------------------------------------------------------------------- documents built from orders
_LOCK = (
    "CASE o_orderstatus WHEN 'F' THEN concat('{\"packages\":{\"\":{\"version\":\"1.0.0\"},\"node_modules/a', o_orderkey % 50, "
    "'\":{\"version\":\"', o_orderkey % 9, '.1\"},\"node_modules/a/node_modules/@s/b', o_custkey % 20, '\":{\"version\":\"2.0\"},"
    "\"node_modules/linked\":{}}}') WHEN 'O' THEN concat('{\"dependencies\":{\"c', o_orderkey % 50, '\":{\"version\":\"', "
    "o_orderkey % 9, '.2\"},\"d\":{}}}') ELSE '{broken' END"
)


@query(
    "flatten_lockfile",
    "SELECT DISTINCT * FROM (SELECT 'c' || o_custkey AS repo_id, 'a' || (o_orderkey % 50) AS name, (o_orderkey % 9) || '.1' AS "
    "version FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'c' || o_custkey, '@s/b' || (o_custkey % 20), '2.0' FROM "
    "orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'c' || o_custkey, 'c' || (o_orderkey % 50), (o_orderkey % 9) || '.2' "
    "FROM orders WHERE o_orderstatus = 'O')",
)
def flatten_lockfile(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("repo_id"), F.expr(_LOCK).alias("content")
    )
    return packages.flatten_lockfile(docs)


_MANIFEST = (
    "concat('{\"name\":\"m\",\"dependencies\":{\"a', o_orderkey % 40, '\":\"^1\",\"shared\":\"1\"},\"devDependencies\":{\"b', "
    "o_custkey % 30, '\":\"*\",\"shared\":\"1\"}', CASE WHEN o_orderstatus = 'F' THEN ',\"peerDependencies\":{\"p\":\"1\"},"
    "\"optionalDependencies\":{\"Bad Name\":\"1\"}' ELSE '' END, '}')"
)


def _manifests(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("repo_id"), F.expr(_MANIFEST).alias("content")
    )


_MANIFEST_ROWS = (
    "SELECT 'c' || o_custkey AS repo_id, 'a' || (o_orderkey % 40) AS name FROM orders UNION SELECT 'c' || o_custkey, 'shared' FROM "
    "orders UNION SELECT 'c' || o_custkey, 'b' || (o_custkey % 30) FROM orders UNION SELECT 'c' || o_custkey, 'p' FROM orders "
    "WHERE o_orderstatus = 'F' UNION SELECT 'c' || o_custkey, 'Bad Name' FROM orders WHERE o_orderstatus = 'F'"
)


@query("manifest_dependencies", _MANIFEST_ROWS)
def manifest_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    return packages.manifest_dependencies(_manifests(spark, sf))


@query(
    "union_distinct_dependencies",
    f"SELECT * FROM ({_MANIFEST_ROWS} UNION SELECT 'c' || o_custkey, 'a' || (o_orderkey % 50) FROM orders WHERE o_orderstatus = "
    "'F' UNION SELECT 'c' || o_custkey, '@s/b' || (o_custkey % 20) FROM orders WHERE o_orderstatus = 'F' UNION SELECT 'c' || "
    "o_custkey, 'c' || (o_orderkey % 50) FROM orders WHERE o_orderstatus = 'O') WHERE name <> 'Bad Name'",
)
def union_distinct_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    return packages.union_distinct_dependencies(
        packages.manifest_dependencies(_manifests(spark, sf)), flatten_lockfile(spark, sf)
    )


_PNPM = (
    "concat('lockfileVersion: ''', CASE WHEN o_orderstatus = 'P' THEN '6.0' ELSE '9.0' END, '''\\n\\npackages:\\n\\n  a@', "
    "o_orderkey % 9, '.0.0:\\n    resolution: x\\n\\n  ''@s/b@', o_custkey % 9, '.1.0'':\\n    x: y\\n', "
    "CASE WHEN o_orderpriority = '1-URGENT' THEN '\\n  a@1.0.0:\\n\\n  noversion:\\n' ELSE '' END, '\\nsnapshots:\\n\\n  z@1.0.0:\\n')"
)


@query(
    "pnpm_lock_packages",
    "WITH r AS (SELECT o_orderkey AS k, 'a' AS name, (o_orderkey % 9) || '.0.0' AS version FROM orders WHERE o_orderstatus <> 'P' "
    "UNION ALL SELECT o_orderkey, '@s/b', (o_custkey % 9) || '.1.0' FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT "
    "o_orderkey, 'a', '1.0.0' FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority = '1-URGENT') "
    "SELECT k::VARCHAR AS repo_id, name, version, CASE WHEN count(*) > 1 THEN 'duplicate entry' END AS issue FROM r GROUP BY k, "
    "name, version UNION ALL SELECT o_orderkey::VARCHAR, '', '', 'unsupported id noversion' FROM orders WHERE o_orderstatus <> "
    "'P' AND o_orderpriority = '1-URGENT'",
)
def pnpm_lock_packages(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("repo_id"), F.expr(_PNPM).alias("content")
    )
    return packages.pnpm_lock_packages(docs)


@query(
    "workspace_package_names",
    "WITH f AS (SELECT o_custkey, o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'packages/p' || o_orderkey || '/package.json' WHEN 1 "
    "THEN 'apps/x/y/package.json' WHEN 2 THEN 'other/package.json' ELSE 'packages/node_modules/q/package.json' END AS path FROM "
    "orders) SELECT DISTINCT 'c' || o_custkey AS repo_id, 'n' || o_orderkey AS name FROM f JOIN customer ON o_custkey = c_custkey "
    "WHERE (path LIKE 'packages/p%' AND c_nationkey % 3 <> 2) OR (path LIKE 'apps/%' AND c_nationkey % 3 = 1)",
)
def workspace_package_names(spark: SparkSession, sf: str) -> DataFrame:
    manifests = table(spark, sf, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("repo_id"),
        F.expr(
            "CASE o_orderkey % 4 WHEN 0 THEN concat('packages/p', o_orderkey, '/package.json') WHEN 1 THEN "
            "'apps/x/y/package.json' WHEN 2 THEN 'other/package.json' ELSE 'packages/node_modules/q/package.json' END"
        ).alias("path"),
        F.expr("concat('{\"name\":\"n', o_orderkey, '\"}')").alias("content"),
    )
    roots = table(spark, sf, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("repo_id"),
        F.expr("CASE WHEN c_nationkey % 3 = 1 THEN 'pnpm-workspace.yaml' ELSE 'package.json' END").alias("path"),
        F.expr(
            "CASE c_nationkey % 3 WHEN 0 THEN '{\"workspaces\":[\"packages/*\"]}' WHEN 1 THEN "
            "'packages:\\n  - ''packages/*''\\n  - apps/**\\n' ELSE '{\"name\":\"root\"}' END"
        ).alias("content"),
    )
    return packages.workspace_package_names(manifests.unionByName(roots))


# --------------------------------------------------------------------------- agent servers
_AGENT_ROWS = [
    # (server json, expected rows of rule|severity|label)
    ('"fs":{"command":"npx","args":["-y","@modelcontextprotocol/server-filesystem","/"],"allowedTools":"*"}',
     [("AGENT-001", "high", "tool list"), ("AGENT-003", "medium", "unpinned package"), ("AGENT-004", "high", "filesystem root")]),
    ('"web":{"url":"http://tools.example.com/x","allowedTools":["read"]}', [("AGENT-005", "high", "plaintext url")]),
    ('"local":{"url":"http://localhost:3000","allowedTools":["read","*"]}', [("AGENT-001", "high", "tool list")]),
    ('"gh":{"command":"npx","args":["pkg@1.2.3"],"env":{"GITHUB_TOKEN":"ghp_' + "Z9y8X7w6V5u4T3s2R1q0P9o8N7m6L5k4" + '","HOME":"$HOME"}}',
     [("AGENT-001", "medium", "tool list"), ("AGENT-002", "critical", "GitHub:GITHUB_TOKEN")]),
    ('"db":{"command":"node","args":["x.js"],"env":{"DB_PASSWORD":"abcdefghij0123456789","SHORT_TOKEN":"abc1","REF_TOKEN":"${SECRET_TOKEN_VALUE_1}"},"allowedTools":[]}',
     [("AGENT-002", "critical", "credential-shaped:DB_PASSWORD")]),
    ('"pin":{"command":"npx","args":["@scope/tool@2.0.0"],"allowedTools":["a"]}', []),
    ('"scoped":{"command":"npx","args":["@scope/tool"],"allowedTools":["a"]}', [("AGENT-003", "medium", "unpinned package")]),
]


def _agent_configs(spark: SparkSession, sf: str) -> DataFrame:
    body = pick([j for j, _ in _AGENT_ROWS], F.pmod(F.col("o_orderkey"), F.lit(len(_AGENT_ROWS))))
    cline = F.col("o_orderstatus") == "P"
    return table(spark, sf, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("repo_id"),
        F.concat(F.lit("~/"), F.col("o_orderkey").cast("string"), F.lit("/mcp.json")).alias("path"),
        F.concat(
            F.when(cline, F.lit('{"cline.mcpServers":{')).otherwise(F.lit('{"mcpServers":{')), body, F.lit("}}")
        ).alias("content"),
    )


_SERVER_NAMES = ["fs", "web", "local", "gh", "db", "pin", "scoped"]


@query(
    "read_agent_configs",
    "SELECT 'c' || o_custkey AS repo_id, '~/' || o_orderkey || '/mcp.json' AS path, "
    + sql_pick(_SERVER_NAMES, f"o_orderkey % {len(_SERVER_NAMES)}") + " AS server, "
    + "([3, 0, 0, 1, 1, 1, 1])[(o_orderkey % 7)::INT + 1]::INT AS n_args, "
    + "(['*', '[\"read\"]', '[\"read\",\"*\"]', NULL, '[]', '[\"a\"]', '[\"a\"]'])[(o_orderkey % 7)::INT + 1] AS allowed_tools, "
    + "([0, 0, 0, 2, 3, 0, 0])[(o_orderkey % 7)::INT + 1]::INT AS n_env FROM orders",
)
def read_agent_configs(spark: SparkSession, sf: str) -> DataFrame:
    return packages.read_agent_configs(_agent_configs(spark, sf)).select(
        "repo_id", "path", "server", F.greatest(F.coalesce(F.size("args"), F.lit(0)), F.lit(0)).alias("n_args"), "allowed_tools",
        F.greatest(F.coalesce(F.size("env"), F.lit(0)), F.lit(0)).alias("n_env"),
    )


def _agent_sql(rule: str) -> str:
    parts = []
    for i, (_, rows) in enumerate(_AGENT_ROWS):
        for r, sev, label in rows:
            if r == rule:
                parts.append(
                    f"SELECT 'c' || o_custkey AS repo_id, '~/' || o_orderkey || '/mcp.json' AS file, '{_SERVER_NAMES[i]}' AS "
                    f"server, '{sev}' AS severity, {quote(label)} AS label FROM orders WHERE o_orderkey % {len(_AGENT_ROWS)} = {i}"
                )
    return " UNION ALL ".join(parts)


def _register_agent(rule: str) -> None:
    @query("rule_" + rule.lower().replace("-", "_"), _agent_sql(rule))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        servers = packages.read_agent_configs(_agent_configs(spark, sf))
        return (
            supply.agent_findings_of_servers(servers)
            .where(F.col("rule") == rule)
            .select("repo_id", "file", F.col("package").alias("server"), "severity", "label")
        )


for _r in ("AGENT-001", "AGENT-002", "AGENT-003", "AGENT-004", "AGENT-005"):
    _register_agent(_r)


# --------------------------------------------------------------------------- surface inventory
_SRC_FILE = f"regexp_matches(path, {rx(inventory.SOURCE_FILE)})"
_INV_SQL = f"""WITH {CODE_LINES_CTE}, l AS (SELECT * FROM code_lines WHERE {_SRC_FILE}),
i AS (SELECT repo_id, path, unnest(regexp_extract_all(line, {rx(inventory.IMPORT_SHAPE)}, 1)) AS s FROM l),
ip AS (SELECT repo_id, path, CASE WHEN starts_with(s, '@') THEN array_to_string(string_split(s, '/')[1:2], '/') ELSE string_split(s, '/')[1] END AS n, s FROM i),
pkgs AS (SELECT DISTINCT repo_id, path, n FROM ip WHERE NOT regexp_matches(s, '^(\\.|/|#|node:)') AND n NOT IN ({', '.join(quote(b) for b in T.BUILTIN_MODULES)})),
r AS (SELECT repo_id, path, unnest(regexp_extract_all(line, {rx(inventory.ROUTE_SHAPE)}, 1)) AS m, unnest(regexp_extract_all(line, {rx(inventory.ROUTE_SHAPE)}, 2)) AS p FROM l),
inv AS (SELECT repo_id, path, 'package' AS kind, n AS name, NULL::VARCHAR AS detail, NULL::INT AS line FROM pkgs
UNION ALL SELECT repo_id, path, 'framework', n, NULL, NULL FROM pkgs WHERE n IN ({', '.join(quote(f) for f in inventory.FRAMEWORKS)})
UNION ALL SELECT DISTINCT repo_id, path, 'route', p, upper(m), NULL FROM r
""" + "".join(
    f"UNION ALL SELECT repo_id, path, 'sink', '{k}', NULL, line_no FROM l WHERE regexp_matches(line, {rx(p)})\n"
    for k, p in inventory.SINK_SHAPES
) + ")"


@query("surface_inventory", _INV_SQL + " SELECT * FROM inv")
def surface_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.surface_inventory(code_files(spark, sf))


@query(
    "surface_counts",
    _INV_SQL + f""", s AS (SELECT repo_id, count(*)::BIGINT AS files_inspected, sum(strlen(content))::BIGINT AS bytes_inspected FROM
code_files WHERE {_SRC_FILE} GROUP BY 1), c AS (SELECT repo_id, """
    + ", ".join(f"count(*) FILTER (kind = '{k}')::BIGINT AS n_{k}" for k in ("package", "framework", "route", "tool", "sink"))
    + " FROM inv GROUP BY 1) SELECT s.*, "
    + ", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in ("package", "framework", "route", "tool", "sink"))
    + ", 'complete' AS status FROM s LEFT JOIN c USING (repo_id)",
)
def surface_counts(spark: SparkSession, sf: str) -> DataFrame:
    files = code_files(spark, sf)
    return inventory.surface_counts(files, inventory.surface_inventory(files))


# root manifests, one per supplier, beside the generated code
_ROOT_MANIFEST = (
    "CASE s_suppkey % 5 WHEN 4 THEN '[1]' WHEN 3 THEN '{\"name\":\"plain\"}' ELSE concat('{\"scripts\":{\"build\":\"x\",\"test', s_suppkey, '\":\"y\"},\"dependencies\":{\"express\":\"4\",\"p', s_suppkey, '\":\"1\"},\"devDependencies\":{\"vue\":\"3\"}}') END"
)
_MAN_OK = "FROM supplier WHERE s_suppkey % 5 < 3"
_POINTS_SQL = f"""points AS (SELECT repo_id, path, CASE WHEN regexp_matches(lower(path), {rx(inventory.CONFIG_NAME)}) THEN 'config' WHEN regexp_matches(lower(path), {rx(inventory.TEST_PATH)}) THEN 'test'
WHEN regexp_matches(lower(path), {rx(inventory.SOURCE_FILE)}) THEN 'source' ELSE 'config' END AS kind, NULL::VARCHAR AS name FROM (SELECT DISTINCT repo_id, path FROM code_files)
UNION ALL SELECT 's' || s_suppkey, 'package.json', 'config', NULL FROM supplier UNION ALL SELECT 's' || s_suppkey, 'package.json', 'script', 'build' {_MAN_OK} UNION ALL SELECT 's' || s_suppkey, 'package.json', 'script', 'test' || s_suppkey {_MAN_OK})"""


def _with_manifests(spark: SparkSession, sf: str) -> DataFrame:
    manifests = table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("repo_id"), F.lit("package.json").alias("path"), F.expr(_ROOT_MANIFEST).alias("content"))
    return code_files(spark, sf).unionByName(manifests)


@query("entry_points", _INV_SQL + f", {_POINTS_SQL} SELECT * FROM points")
def entry_points(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.entry_points(_with_manifests(spark, sf))


@query(
    "target_inventory",
    _INV_SQL + f""", {_POINTS_SQL}, m AS (SELECT 's' || s_suppkey AS repo_id, unnest([('package', 'express', 'dependencies'), ('framework', 'express', 'dependencies'), ('package', 'p' || s_suppkey, 'dependencies'),
('package', 'vue', 'devDependencies'), ('framework', 'vue', 'devDependencies')]) AS x {_MAN_OK} UNION ALL SELECT 's' || s_suppkey, ('unreadable', 'manifest', NULL) FROM supplier WHERE s_suppkey % 5 = 4)
SELECT * FROM inv UNION ALL SELECT repo_id, 'package.json', x[1], x[2], x[3], NULL FROM m UNION ALL SELECT repo_id, path, 'entry-point', name, kind, NULL FROM points""",
)
def target_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.target_inventory(_with_manifests(spark, sf))


_FIX_LINES = [
    "const otp = Math.floor(100000 + Math.random() * 900000);",
    "const token = Math.random().toString(36).slice(2);",
    "const pin = Math.random();",
    "const safe = crypto.randomBytes(32);",
    "const a = Math.floor(1 + Math.random() * 6) + Math.floor(10+Math.random()*90);",
    "plain()",
]
_FIXED = [
    "'import * as crypto from \"node:crypto\";' || chr(10) || 'const otp = crypto.randomInt(100000, 1000000);'",
    "'import * as crypto from \"node:crypto\";' || chr(10) || 'const token = crypto.randomBytes(32).toString(''base64url'');'",
    # the comment itself names crypto.randomInt, so the import is added as well
    "'import * as crypto from \"node:crypto\";' || chr(10) || " + quote("const pin = " + inventory.REVIEW_COMMENT + ";"),
    "'import * as crypto from \"node:crypto\";' || chr(10) || 'const safe = crypto.randomBytes(32);'",
    "'import * as crypto from \"node:crypto\";' || chr(10) || 'const a = crypto.randomInt(1, 7) + crypto.randomInt(10, 100);'",
    "NULL",
]


@query(
    "suggest_fix",
    "SELECT event_id, ([" + ", ".join(_FIXED) + f"])[(event_id % {len(_FIXED)})::INT + 1] AS fixed FROM events",
)
def suggest_fix(spark: SparkSession, sf: str) -> DataFrame:
    code = pick(_FIX_LINES, F.pmod(F.col("event_id"), F.lit(len(_FIX_LINES))))
    return table(spark, sf, "events").select("event_id", inventory.suggest_fix(code).alias("fixed"))


_ = PATH_SHAPES
