"""Provenance queries: ``orders`` are commits, ``lineitem`` the files they touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.operators import provenance as P
from assayline.operators.spread import carry_forward, dealt
from assayline.sources import history
from workloads import query
from workloads.bindings import pick, quote, rx, sql_pick, table

GAP = 86400 * 20
_BODIES = [
    "Fix the build", "Add form\n\nCo-Authored-By: Claude <x@y.z>", "Bump\n\nCo-authored-by: renovate[bot] <r@b>",
    "Tidy\nGenerated-By: a tool", "co-authored-by: GitHub Copilot <c@g>", "Docs",
    "Work\n\nCo-Authored-By: Claudette <n@m>", "x\nCo-Authored-By: Cursor\nAssisted-By: y",
]
_TS = "o_orderdate + make_interval(0, 0, 0, 0, 0, 0, CAST(o_orderkey * 61 % 86400 AS INT))"
_TS_SQL = "(o_orderdate + to_seconds(o_orderkey * 61 % 86400))"
_PATHS = ["src/a{}.ts", "lib/b{}.js", "docs/c{}.md"]


def commits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("repo_id"),
        F.col("o_orderkey").alias("sha"),
        F.expr(_TS).cast("timestamp").alias("ts"),
        pick(_BODIES, F.pmod(F.col("o_orderkey"), F.lit(len(_BODIES)))).alias("body"),
    )


def commit_files(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    files = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return (
        dealt(files, "l_orderkey")
        .join(o, "l_orderkey")
        .select(
            F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("repo_id"),
            F.col("l_orderkey").alias("sha"),
            F.concat(F.lit("src/f"), (F.col("l_partkey") % 12).cast("string"), F.lit(".ts")).alias("path"),
            (F.col("l_quantity") * 10).cast("bigint").alias("lines_added"),
        )
    )


_CTE = f"""commits AS (SELECT 'c' || o_custkey AS repo_id, o_orderkey AS sha, {_TS_SQL} AS ts,
 ([{', '.join("E'" + b.replace(chr(39), chr(39) * 2).replace(chr(10), chr(92) + 'n') + "'" for b in _BODIES)}])[(o_orderkey % {len(_BODIES)})::INT + 1] AS body FROM orders),
commit_files AS (SELECT 'c' || o_custkey AS repo_id, l_orderkey AS sha, 'src/f' || (l_partkey % 12) || '.ts' AS path,
 (l_quantity * 10)::BIGINT AS lines_added FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
gaps AS (SELECT *, (epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY repo_id ORDER BY ts, sha))::BIGINT AS gap_s FROM commits)"""


@query("seconds_since_previous_commit", f"WITH {_CTE} SELECT repo_id, sha, gap_s FROM gaps")
def seconds_since_previous_commit(spark: SparkSession, sf: str) -> DataFrame:
    return P.seconds_since_previous(commits(spark, sf)).select("repo_id", "sha", "gap_s")


_SHAPE = f"""shaped AS (SELECT c.repo_id, c.sha FROM gaps c JOIN (SELECT repo_id, sha, sum(lines_added) AS a, count(*) AS n FROM
 commit_files GROUP BY ALL) s USING (repo_id, sha) WHERE gap_s <= {GAP} AND a >= 400 AND n >= 3),
shape AS (SELECT f.repo_id, f.path, count(*)::BIGINT AS n_commits FROM commit_files f JOIN shaped USING (repo_id, sha) GROUP BY ALL)"""


@query("commit_shape", f"WITH {_CTE}, {_SHAPE} SELECT * FROM shape")
def commit_shape(spark: SparkSession, sf: str) -> DataFrame:
    return P.commit_shape_counts(commits(spark, sf), commit_files(spark, sf), max_gap=GAP)


_AGENT = rx(P.AGENT_TRAILER)
_TRAIL = f"""lab AS (SELECT repo_id, sha, ts, CASE WHEN regexp_matches(body, {_AGENT}) THEN 'agent:' || regexp_extract(body, {_AGENT}, 1)
 WHEN regexp_matches(body, {rx(P.BOT_TRAILER)}) THEN 'bot' WHEN regexp_matches(body, {rx(P.PROVENANCE_HEADER)}) THEN 'header' END AS label FROM commits),
t AS (SELECT DISTINCT repo_id, sha, path FROM commit_files),
n AS (SELECT t.repo_id, path, label, row_number() OVER (PARTITION BY t.repo_id, path ORDER BY ts DESC, sha DESC) AS rn FROM t JOIN lab USING (repo_id, sha)),
trail AS (SELECT repo_id, path, count(*)::BIGINT AS n_commits, count(label)::BIGINT AS ai_commits,
 coalesce(list_sort(list(DISTINCT substr(label, 7)) FILTER (label LIKE 'agent:%')), []::VARCHAR[]) AS agents,
 coalesce(bool_or(label = 'bot'), false) AS saw_bot, coalesce(bool_or(label = 'header'), false) AS saw_header
 FROM n WHERE rn <= 3 GROUP BY ALL HAVING count(label) > 0)"""


@query("file_trailers", f"WITH {_CTE}, {_TRAIL} SELECT * FROM trail")
def file_trailers(spark: SparkSession, sf: str) -> DataFrame:
    return P.file_trailers(commits(spark, sf), commit_files(spark, sf), 3)


@query(
    "recent_n_per_key",
    f"WITH {_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY ts DESC, sha DESC) AS rn FROM commits) "
    "SELECT repo_id, sha FROM r WHERE rn <= 5",
)
def recent_n_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return P.recent_n_per_key(commits(spark, sf), ["repo_id"], 5).select("repo_id", "sha")


@query(
    "cap_per_repo",
    "WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, "
    "l_linenumber, l_partkey, l_quantity, l_extendedprice) AS rn FROM lineitem) SELECT l_suppkey, l_orderkey, l_linenumber "
    "FROM r WHERE rn <= 50",
)
def cap_per_repo(spark: SparkSession, sf: str) -> DataFrame:
    """The optional per-key limit (off by default in the library's joins)."""
    from assayline.operators.spread import top_n

    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    rows = table(spark, sf, "lineitem").select("l_suppkey", *order)
    return top_n(rows, ["l_suppkey"], [F.col(c).asc() for c in order], 50, spread=F.col("l_orderkey")).select(
        "l_suppkey", "l_orderkey", "l_linenumber"
    )


@query(
    "carry_forward",
    "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY "
    "user_id ORDER BY ts, event_id) AS last_purchase FROM events",
)
def carry_forward_(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    e = e.withColumn("mark", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return carry_forward(e, ["user_id"], ["ts", "event_id"], "mark", None, "last_purchase").select(
        "event_id", "user_id", "last_purchase"
    )


# --------------------------------------------------------------------------- logs as text
_LOG_LINES = "concat('<<', lpad(hex(o_orderkey), 8, '0'), ' ', 1700000000 + o_orderkey * 60, '>>')"


@query(
    "parse_commit_log",
    "SELECT 'c' || o_custkey AS repo_id, lower(lpad(printf('%X', o_orderkey), 8, '0')) AS sha, epoch_ms((1700000000 + o_orderkey "
    "* 60) * 1000) AS ts, p AS path, a::BIGINT AS lines_added FROM orders, (SELECT unnest([0, 1, 2]) AS i) t, LATERAL (SELECT "
    "CASE i WHEN 0 THEN 'src/a' || (o_orderkey % 7) || '.ts' WHEN 1 THEN 'img.png' ELSE 'lib/b.js' END AS p, CASE i WHEN 0 THEN "
    "o_orderkey % 90 WHEN 1 THEN 0 ELSE 3 END AS a)",
)
def parse_commit_log(spark: SparkSession, sf: str) -> DataFrame:
    log = F.expr(
        "concat('noise\\n<<', lower(lpad(hex(o_orderkey), 8, '0')), ' ', 1700000000 + o_orderkey * 60, '>>\\n\\n', "
        "o_orderkey % 90, '\\t1\\tsrc/a', o_orderkey % 7, '.ts\\n-\\t-\\timg.png\\nbroken line\\n3\\t0\\tlib/b.js\\n')"
    )
    logs = table(spark, sf, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("repo_id"), log.alias("log")
    )
    parsed = history.parse_commit_log(logs)
    return (
        parsed.select("repo_id", "sha", "ts", F.inline("files"))
        .select("repo_id", "sha", F.col("ts").cast("timestamp_ntz").alias("ts"), "path", "lines_added")
    )


# --------------------------------------------------------------------------- code shape
SHAPE_BLOCK = 128
_SHAPED = [
    "/** Adds two numbers. */", "export function add(a, b) {", "  return a + b;", "// note", "const mul = (a, b) => a * b;",
    "", "x = 1;", "  deep();",
]
_PLAIN = ["let a = 1;", "        const f = (x) => x;", "call(a);", "", "if (a) {", "                b();", "// TODO later", "}"]


def shape_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files of 128 event rows; every third is written in a second, uneven style."""
    e = table(spark, sf, "events").select("event_id", F.expr(f"event_id div {SHAPE_BLOCK}").alias("b"))
    i = F.pmod(F.col("event_id"), F.lit(8))
    line = F.when(F.col("b") % 3 == 0, pick(_PLAIN, i)).otherwise(pick(_SHAPED, i))
    line = F.when((F.col("event_id") % 641 == 0) & (F.col("b") % 3 != 0), F.lit("// FIXME")).otherwise(line)
    return (
        e.select("b", "event_id", line.alias("line"))
        .groupBy("b")
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\n"
            ).alias("content")
        )
        .select(
            F.concat(F.lit("r"), F.expr("b div 8").cast("string")).alias("repo_id"),
            F.concat(F.lit("src/f"), F.col("b").cast("string"), F.lit(".ts")).alias("path"),
            "content",
        )
    )


_SHAPE_CTE = f"""sl AS (SELECT event_id // {SHAPE_BLOCK} AS b, event_id, row_number() OVER (PARTITION BY event_id // {SHAPE_BLOCK} ORDER BY
 event_id) AS n, CASE WHEN event_id % 641 = 0 AND (event_id // {SHAPE_BLOCK}) % 3 <> 0 THEN '// FIXME' WHEN (event_id // {SHAPE_BLOCK}) % 3 = 0
 THEN {sql_pick(_PLAIN, "event_id % 8")} ELSE {sql_pick(_SHAPED, "event_id % 8")} END AS line FROM events),
sw AS (SELECT *, coalesce(string_agg(line, chr(10)) OVER (PARTITION BY b ORDER BY n ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), '') AS above FROM sl),
sm AS (SELECT 'r' || (b // 8) AS repo_id, 'src/f' || b || '.ts' AS path, count(*) FILTER (line <> '' AND NOT regexp_matches(line, {rx(P.COMMENT_LINE)}))::INT AS code_lines,
 count(*) FILTER (regexp_matches(line, {rx(P.COMMENT_LINE)})) / count(*) FILTER (line <> '') AS comment_density,
 count(*) FILTER (regexp_matches(line, {rx(P.FUNCTION_LINE)}))::INT AS functions,
 count(*) FILTER (regexp_matches(line, {rx(P.FUNCTION_LINE)}) AND regexp_matches(above, {rx(P.DOC_ABOVE)}))::INT AS documented,
 count(*) FILTER (regexp_matches(line, {rx(P.OPEN_WORK)}))::INT AS open_work,
 stddev_pop(length(line) - length(ltrim(line))) FILTER (line <> '' AND NOT regexp_matches(line, {rx(P.COMMENT_LINE)})) AS indent_stddev,
 count(*)::BIGINT AS n_lines FROM sw GROUP BY b),
ss AS (SELECT repo_id, path FROM sm WHERE code_lines >= 40 AND (comment_density >= .15)::INT + (functions >= 2 AND documented >= 0.8 * functions)::INT
 + (open_work = 0)::INT + (indent_stddev < 1.5)::INT >= 3)"""


@query(
    "code_shape",
    f"WITH {_SHAPE_CTE} SELECT repo_id, path, code_lines, round(comment_density, 6) AS comment_density, functions, documented, "
    "open_work, round(indent_stddev, 6) AS indent_stddev FROM sm",
)
def code_shape(spark: SparkSession, sf: str) -> DataFrame:
    m = P.code_shape_metrics(shape_files(spark, sf))
    return m.withColumn("comment_density", F.round("comment_density", 6)).withColumn(
        "indent_stddev", F.round("indent_stddev", 6)
    )


@query("code_shape_signals", f"WITH {_SHAPE_CTE} SELECT repo_id, path, 'code-shape' AS name, 0.4::DOUBLE AS weight FROM ss")
def code_shape_signals(spark: SparkSession, sf: str) -> DataFrame:
    return P.code_shape_signals(shape_files(spark, sf)).select("repo_id", "path", "name", "weight")


_ARTIFACTS = [
    ".cursor/rules", "src/a.ts", "CLAUDE.md", ".aider.conf", "docs/CLAUDE.md", ".continue", ".continuerc", "x/.cursor/y",
    ".windsurfrules", ".codyrules", ".claude/settings.json", "README.md", "lib/z.ts",
]


@query(
    "repo_prior",
    "WITH p AS (SELECT DISTINCT source AS repo_id, " + sql_pick(_ARTIFACTS, f"(doc_id // 7) % {len(_ARTIFACTS)}") + " AS path FROM "
    "documents), h AS (SELECT DISTINCT repo_id, CASE WHEN starts_with(path, '.cursor/') THEN 1 WHEN path = 'CLAUDE.md' THEN 2 "
    "WHEN starts_with(path, '.aider') THEN 3 WHEN path = '.continue' THEN 4 WHEN path = '.continuerc' THEN 5 WHEN path = '.windsurfrules' "
    "THEN 6 WHEN path = '.codyrules' THEN 7 WHEN starts_with(path, '.claude/') THEN 8 END AS k FROM p) SELECT repo_id, count(k)::INT AS "
    "artifacts, least(count(k) * 0.1, 0.35)::DOUBLE AS prior FROM h WHERE k IS NOT NULL GROUP BY 1",
)
def repo_prior(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    files = docs.select(
        F.col("source").alias("repo_id"),
        pick(_ARTIFACTS, F.pmod(F.expr("doc_id div 7"), F.lit(len(_ARTIFACTS)))).alias("path"),
    )
    return P.repo_prior(files)


# --------------------------------------------------------------------------- roll-up
def _provenance(spark: SparkSession, sf: str) -> DataFrame:
    c, f = commits(spark, sf), commit_files(spark, sf)
    files = f.groupBy("repo_id", "path").agg(F.sum("lines_added").alias("n_lines"))
    signals = P.trailer_signals(c, f, 1).unionByName(
        P.commit_shape_signals(c, f, max_gap=GAP)
    )
    prior = (
        table(spark, sf, "customer")
        .select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("repo_id"), F.expr("CASE WHEN c_nationkey % 4 = 1 THEN 0.1D ELSE 0D END").alias("prior"))
    )
    return P.combine_signals(files, signals, prior)


_PROV = f"""{_CTE.replace("FROM orders),", "FROM orders),", 1)}, {_SHAPE},
lab AS (SELECT repo_id, sha, ts, CASE WHEN regexp_matches(body, {_AGENT}) OR regexp_matches(body, {rx(P.BOT_TRAILER)}) OR
 regexp_matches(body, {rx(P.PROVENANCE_HEADER)}) THEN 1 END AS label FROM commits),
t AS (SELECT DISTINCT repo_id, sha, path FROM commit_files),
n AS (SELECT t.repo_id, path, label, row_number() OVER (PARTITION BY t.repo_id, path ORDER BY ts DESC, sha DESC) AS rn FROM t JOIN lab USING (repo_id, sha)),
files AS (SELECT repo_id, path, sum(lines_added)::BIGINT AS n_lines FROM commit_files GROUP BY ALL),
j AS (SELECT f.*, x.repo_id IS NOT NULL AS t1, s.repo_id IS NOT NULL AS s1, CASE WHEN c_nationkey % 4 = 1 THEN 0.1 ELSE 0 END AS prior
 FROM files f LEFT JOIN (SELECT repo_id, path FROM n WHERE rn = 1 AND label = 1) x USING (repo_id, path) LEFT JOIN shape s USING (repo_id, path)
 JOIN customer ON f.repo_id = 'c' || c_custkey),
prov AS (SELECT repo_id, path, CASE WHEN t1 THEN 1.0 WHEN s1 THEN 0.7 + prior ELSE prior END::DOUBLE AS ai_likelihood,
 CASE WHEN NOT t1 AND NOT s1 AND prior = 0 THEN 'unknown' WHEN t1 OR s1 THEN 'ai-likely' ELSE 'human-likely' END AS bucket,
 CASE WHEN t1 THEN 'high' WHEN s1 THEN 'medium' ELSE 'low' END AS confidence, n_lines FROM j)"""


@query(
    "file_provenance",
    f"WITH {_PROV} SELECT repo_id, path, round(ai_likelihood, 6) AS ai_likelihood, bucket, confidence, n_lines FROM prov",
)
def file_provenance(spark: SparkSession, sf: str) -> DataFrame:
    return _provenance(spark, sf).withColumn("ai_likelihood", F.round("ai_likelihood", 6))


def _file_findings(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return (
        table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_linenumber")
        .join(o, "l_orderkey")
        .select(
            F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("repo_id"),
            F.concat(F.lit("src/f"), (F.col("l_partkey") % 14).cast("string"), F.lit(".ts")).alias("file"),
            F.when(F.col("l_quantity") > 45, "critical").otherwise("high").alias("severity"),
            "l_orderkey", "l_linenumber", "l_partkey",
        )
    )


_FF = """ff AS (SELECT 'c' || o_custkey AS repo_id, 'src/f' || (l_partkey % 14) || '.ts' AS file, CASE WHEN l_quantity > 45 THEN 'critical'
 ELSE 'high' END AS severity, l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(
    "findings_with_provenance",
    f"WITH {_PROV}, {_FF} SELECT ff.repo_id, file, severity, l_orderkey, l_linenumber, l_partkey, bucket FROM ff LEFT JOIN prov ON "
    "prov.repo_id = ff.repo_id AND prov.path = ff.file",
)
def findings_with_provenance(spark: SparkSession, sf: str) -> DataFrame:
    return P.findings_with_provenance(_file_findings(spark, sf), _provenance(spark, sf)).drop("ai_likelihood")


@query(
    "repo_provenance",
    f"""WITH {_PROV}, {_FF}, x AS (SELECT ff.repo_id, severity, bucket FROM ff LEFT JOIN prov ON prov.repo_id = ff.repo_id AND prov.path = ff.file),
a AS (SELECT repo_id, count(*) FILTER (bucket = 'ai-likely') AS fa, count(*) FILTER (bucket = 'human-likely') AS fh,
 count(*) FILTER (bucket = 'ai-likely' AND severity = 'critical') AS ca, count(*) FILTER (severity = 'critical') AS ct FROM x GROUP BY 1),
b AS (SELECT repo_id, count(*) AS files, sum(n_lines) AS loc, sum(n_lines * ai_likelihood) AS w, coalesce(sum(n_lines) FILTER (bucket = 'ai-likely'), 0) AS la,
 coalesce(sum(n_lines) FILTER (bucket = 'human-likely'), 0) AS lh, bool_or(confidence IN ('high', 'medium')) AS okc,
 CASE WHEN bool_or(confidence = 'high') THEN 'high' WHEN bool_or(confidence = 'medium') THEN 'medium' ELSE 'low' END AS confidence FROM prov GROUP BY 1),
d AS (SELECT *, CASE WHEN la > 0 THEN fa / la * 1000 ELSE 0 END AS da, CASE WHEN lh > 0 THEN fh / lh * 1000 ELSE 0 END AS dh FROM b JOIN a USING (repo_id))
SELECT repo_id, files::BIGINT AS files, loc::BIGINT AS loc, CASE WHEN loc > 0 THEN floor(w / loc * 1000 + 0.5) / 10 ELSE 0 END::DOUBLE AS ai_authored_percent,
 (floor(da * 10 + 0.5) / 10)::DOUBLE AS finding_density_ai, (floor(dh * 10 + 0.5) / 10)::DOUBLE AS finding_density_human,
 CASE WHEN la >= 200 AND lh >= 200 AND okc AND dh > 0 THEN floor(da / dh * 10 + 0.5) / 10 END::DOUBLE AS density_ratio,
 ca::BIGINT AS criticals_in_ai_files, ct::BIGINT AS criticals_total, confidence FROM d""",
)
def repo_provenance(spark: SparkSession, sf: str) -> DataFrame:
    return P.repo_provenance(_provenance(spark, sf), _file_findings(spark, sf))


_ = quote
