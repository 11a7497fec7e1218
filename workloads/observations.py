"""Observations, snapshots, differences and lineage over ``lineitem`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.functions.digest import fingerprint_v1, sha256_tag
from assayline.operators import evidence as E
from assayline.sources import evidence as S
from workloads import query
from workloads.bindings import pick, sql_pick, table
from workloads.findings_score import TABLE_FINDINGS_CTE, table_findings
from workloads.scalars import FINGERPRINT_SQL

SPLIT = "1997-06-01"
_SEV5 = "CASE WHEN l_quantity > 47 THEN 'critical' WHEN l_quantity > 38 THEN 'high' WHEN l_quantity > 20 THEN 'medium' WHEN l_quantity > 8 THEN 'low' ELSE 'unknown' END"
_POS = "l_orderkey * 8 + l_linenumber"


def observations(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate", "l_tax"
    )
    subject = F.concat(F.lit("part"), F.col("l_partkey").cast("string"))
    location = F.concat(F.lit("line"), F.col("l_linenumber").cast("string"))
    return li.select(
        F.concat(F.lit("s"), (F.col("l_partkey") % 10).cast("string")).alias("repo_id"),
        subject.alias("subject_id"),
        F.col("l_returnflag").alias("rule"),
        location.alias("location"),
        F.concat(F.lit("p"), (F.col("l_suppkey") % 5).cast("string")).alias("producer_id"),
        F.expr(_SEV5).alias("severity"),
        F.when(F.col("l_tax") > 0.02, F.concat(F.lit("fix "), (F.col("l_suppkey") % 12).cast("string"))).alias("remediation"),
        (F.col("l_orderkey") % 13 != 0).alias("is_valid"),
        fingerprint_v1(subject, F.lit("native"), location, rule=F.col("l_returnflag")).alias("fingerprint"),
        F.expr(_POS).alias("pos"),
        F.expr("concat('{\"sev\": \"', " + _SEV5 + ", '\", \"line\": ', l_linenumber, '}')").alias("payload"),
        "l_shipdate",
    )


_FP = FINGERPRINT_SQL.format(
    advisory="NULL::VARCHAR", cls="'native'", location="'line' || l_linenumber", package="NULL::VARCHAR", rule="l_returnflag",
    subject="'part' || l_partkey",
)
OBS_CTE = f"""obs AS (SELECT 's' || (l_partkey % 10) AS repo_id, 'part' || l_partkey AS subject_id, l_returnflag AS rule,
 'line' || l_linenumber AS location, 'p' || (l_suppkey % 5) AS producer_id, {_SEV5} AS severity,
 CASE WHEN l_tax > 0.02 THEN 'fix ' || (l_suppkey % 12) END AS remediation, l_orderkey % 13 <> 0 AS is_valid, {_FP} AS fingerprint,
 {_POS} AS pos, l_linenumber, l_shipdate FROM lineitem)"""


@query(
    "correlate",
    f"WITH {OBS_CTE} SELECT fingerprint, list_sort(list(DISTINCT producer_id)) AS producer_ids, count(*)::BIGINT AS n_payloads, "
    "count(DISTINCT severity) > 1 AS disagreement FROM obs GROUP BY 1",
)
def correlate(spark: SparkSession, sf: str) -> DataFrame:
    return E.correlate(observations(spark, sf), S.canonical_document(F.col("payload")))


_RISK = """risk AS (SELECT repo_id, fingerprint, count(*) = count(*) FILTER (is_valid) AS whole, count(*)::BIGINT AS n_payloads, count(*) FILTER (NOT is_valid)::BIGINT AS n_invalid,
 count(DISTINCT severity) FILTER (is_valid) AS k, min(severity) FILTER (is_valid) AS lo,
 count(DISTINCT remediation) FILTER (is_valid)::BIGINT AS n_remediations FROM {src} GROUP BY ALL),
snap AS (SELECT repo_id, fingerprint, CASE WHEN whole AND k = 1 AND lo <> 'unknown' THEN 'known' WHEN whole AND k > 1 THEN 'mixed'
 ELSE 'unavailable' END AS severity_status, CASE WHEN whole AND k = 1 AND lo <> 'unknown' THEN lo END AS severity_value,
 n_payloads, n_invalid, n_remediations FROM risk)"""


@query(
    "risk_projection",
    f"WITH {OBS_CTE}, {_RISK.format(src='obs')} SELECT fingerprint, severity_status, severity_value, n_payloads, n_invalid, n_remediations FROM snap",
)
def risk_projection(spark: SparkSession, sf: str) -> DataFrame:
    return E.risk_projection(observations(spark, sf))


@query(
    "remediation_texts",
    f"WITH {OBS_CTE} SELECT DISTINCT fingerprint, remediation FROM obs WHERE is_valid AND remediation IS NOT NULL",
)
def remediation_texts(spark: SparkSession, sf: str) -> DataFrame:
    return E.remediation_texts(observations(spark, sf))


def _risk(spark: SparkSession, sf: str, head: bool) -> DataFrame:
    o = observations(spark, sf)
    late = F.col("l_shipdate") >= F.lit(SPLIT).cast("timestamp_ntz")
    return E.risk_projection(o.where(late if head else ~late), ["repo_id"])


_DIFF = f"""{OBS_CTE}, b AS (SELECT * FROM obs WHERE l_shipdate < TIMESTAMP '{SPLIT}'), h AS (SELECT * FROM obs WHERE l_shipdate >= TIMESTAMP '{SPLIT}'),
{_RISK.format(src='b').replace('risk AS', 'brisk AS').replace('snap AS', 'bsnap AS').replace('FROM risk', 'FROM brisk')},
{_RISK.format(src='h').replace('risk AS', 'hrisk AS').replace('snap AS', 'hsnap AS').replace('FROM risk', 'FROM hrisk')},
rank AS (SELECT unnest(['critical', 'high', 'medium', 'low', 'info']) AS s, unnest([5, 4, 3, 2, 1]) AS r),
diff AS (SELECT coalesce(x.repo_id, y.repo_id) AS repo_id, coalesce(x.fingerprint, y.fingerprint) AS fingerprint,
 CASE WHEN x.fingerprint IS NULL THEN 'added' WHEN y.fingerprint IS NULL THEN 'fixed' WHEN x.severity_value IS NULL OR y.severity_value IS NULL
 THEN 'severity-unassessed' WHEN ry.r > rx.r THEN 'worsened' WHEN ry.r < rx.r THEN 'improved' ELSE 'unchanged' END AS change,
 x.severity_status AS base_status, x.severity_value AS before, y.severity_status AS head_status, y.severity_value AS after
 FROM bsnap x FULL JOIN hsnap y ON x.repo_id = y.repo_id AND x.fingerprint = y.fingerprint LEFT JOIN rank rx ON rx.s = x.severity_value
 LEFT JOIN rank ry ON ry.s = y.severity_value)"""


def _diff(spark: SparkSession, sf: str) -> DataFrame:
    return E.diff_snapshots(_risk(spark, sf, False), _risk(spark, sf, True), ["repo_id"])


@query("diff_snapshots", f"WITH {_DIFF} SELECT * FROM diff")
def diff_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return _diff(spark, sf)


@query(
    "change_actions",
    f"WITH {_DIFF} SELECT repo_id, fingerprint, change, before, after, CASE WHEN base_status = 'mixed' OR head_status = 'mixed' THEN "
    "'mixed' WHEN base_status = 'known' AND head_status = 'known' THEN 'known' ELSE 'unavailable' END AS assessment, CASE WHEN change "
    "IN ('added', 'worsened') THEN 'required' ELSE 'unknown' END AS rescan, CASE WHEN change = 'fixed' THEN 'base' ELSE 'head' END AS "
    "remediation_from FROM diff WHERE change IN ('added', 'fixed', 'worsened', 'improved')",
)
def change_actions(spark: SparkSession, sf: str) -> DataFrame:
    return E.change_actions(_diff(spark, sf))


@query(
    "fingerprint_except_intersect",
    f"WITH {OBS_CTE}, b AS (SELECT DISTINCT fingerprint FROM obs WHERE l_shipdate < TIMESTAMP '{SPLIT}'), h AS (SELECT DISTINCT "
    f"fingerprint FROM obs WHERE l_shipdate >= TIMESTAMP '{SPLIT}') SELECT fingerprint, 'both' AS side FROM b INTERSECT SELECT fingerprint, "
    "'both' FROM h UNION ALL (SELECT fingerprint, 'base-only' FROM (SELECT * FROM b EXCEPT SELECT * FROM h)) UNION ALL (SELECT fingerprint, "
    "'head-only' FROM (SELECT * FROM h EXCEPT SELECT * FROM b))",
)
def fingerprint_except_intersect(spark: SparkSession, sf: str) -> DataFrame:
    o = observations(spark, sf)
    late = F.col("l_shipdate") >= F.lit(SPLIT).cast("timestamp_ntz")
    return E.fingerprint_changes(o.where(~late), o.where(late))


@query(
    "fuzzy_duplicates",
    f"WITH {OBS_CTE} SELECT DISTINCT a.producer_id AS \"left\", b.producer_id AS \"right\" FROM obs a JOIN obs b ON a.subject_id = b.subject_id AND "
    "a.rule = b.rule AND a.pos < b.pos AND a.location <> b.location",
)
def fuzzy_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return E.fuzzy_duplicates(observations(spark, sf))


@query(
    "fuzzy_duplicate_groups",
    f"WITH {OBS_CTE} SELECT DISTINCT a.producer_id || a.rule AS \"left\", b.producer_id || b.rule AS \"right\" FROM obs a JOIN obs b ON a.subject_id = "
    "b.subject_id AND a.pos < b.pos AND a.location <> b.location ",
)
def fuzzy_duplicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The same with finer producers and one rule."""
    o = observations(spark, sf).withColumn("producer_id", F.concat("producer_id", "rule")).withColumn("rule", F.lit("any"))
    return E.fuzzy_duplicates(o)


# --------------------------------------------------------------------------- runs and coverage
_RUN = "l_suppkey"


@query(
    "evidence_with_runs",
    "WITH r AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_nationkey % 3 = 0 THEN 'incomplete' ELSE 'complete' END AS coverage, CASE WHEN "
    "s_nationkey % 4 = 0 THEN 'failed' ELSE 'complete' END AS st, CASE WHEN s_nationkey % 5 = 0 THEN ['timeout', 'db-stale', 'timeout'] ELSE [] "
    "END AS reasons FROM supplier), j AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, r.* FROM lineitem LEFT JOIN r ON "
    "l_suppkey = s_suppkey AND s_nationkey <> 7) SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN coverage IS NULL THEN 'unavailable' ELSE 'available' END AS "
    "timestamp_status, list_sort(list_distinct(list_filter([CASE WHEN coverage IS NULL THEN 'tool-run-metadata-unavailable' END, CASE WHEN "
    "coverage <> 'complete' THEN 'tool-run-incomplete' END, CASE WHEN st <> 'complete' THEN 'producer-coverage-incomplete' END], lambda x: x IS NOT "
    "NULL) || coalesce(reasons, []::VARCHAR[]))) AS limitations FROM j",
)
def evidence_with_runs(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "supplier").select(
        F.expr("CASE WHEN s_nationkey = 7 THEN -s_suppkey ELSE s_suppkey END").alias("run_id"),
        F.lit("2024-01-01").alias("started_at"), F.lit("2024-01-02").alias("completed_at"),
        F.expr("CASE WHEN s_nationkey % 3 = 0 THEN 'incomplete' ELSE 'complete' END").alias("coverage"),
        F.expr("CASE WHEN s_nationkey % 4 = 0 THEN 'failed' ELSE 'complete' END").alias("producer_state"),
        F.expr("CASE WHEN s_nationkey % 5 = 0 THEN array('timeout', 'db-stale', 'timeout') ELSE array() END").alias("reasons"),
    )
    obs = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("run_id"))
    return E.evidence_with_runs(obs, runs).select(
        "l_orderkey", "l_linenumber", "l_partkey", "timestamp_status", "limitations"
    )


@query(
    "coverage_rollup",
    "SELECT o_custkey, CASE WHEN bool_and(o_orderstatus <> 'P' AND o_orderpriority <> '1-URGENT') THEN 'complete' ELSE 'incomplete' END AS status, "
    "count(*)::BIGINT AS producers, count(*) FILTER (NOT (o_orderstatus <> 'P' AND o_orderpriority <> '1-URGENT'))::BIGINT AS "
    "incomplete_producers FROM orders GROUP BY 1",
)
def coverage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(
        "o_custkey",
        F.when(F.col("o_orderstatus") == "P", "failed").otherwise("complete").alias("state"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("n_limitations"),
    )
    return E.coverage_rollup(rows, ["o_custkey"])


_COV = "SELECT 'c' || (l_suppkey % 20) AS repo_id, CASE WHEN {w} THEN 'p' ELSE '{o}' END || l_linenumber AS producer, CASE WHEN max(l_quantity) > {q} THEN 'complete' ELSE 'incomplete' END AS state, count(*)::BIGINT AS observation_count FROM lineitem GROUP BY ALL"


def _coverage(spark: SparkSession, sf: str, both: str, other: str, q: int) -> DataFrame:
    """Every row counts: for a producer that both snapshots have, or for one of this snapshot's own."""
    return (
        table(spark, sf, "lineitem")
        .groupBy(
            F.concat(F.lit("c"), (F.col("l_suppkey") % 20).cast("string")).alias("repo_id"),
            F.concat(F.when(F.expr(both), "p").otherwise(other), F.col("l_linenumber").cast("string")).alias("producer"),
        )
        .agg(
            F.when(F.max("l_quantity") > q, "complete").otherwise("incomplete").alias("state"),
            F.count(F.lit(1)).alias("observation_count"),
        )
    )


_CW = ("l_returnflag = 'A' AND l_linenumber < 7", "l_returnflag = 'R' AND l_linenumber > 1")


@query(
    "coverage_delta",
    f"WITH b AS ({_COV.format(q=49, w=_CW[0], o='q')}), h AS ({_COV.format(q=48, w=_CW[1], o='r')}) SELECT coalesce(b.repo_id, h.repo_id) AS repo_id, "
    "coalesce(b.producer, h.producer) AS producer, b.state AS before_state, b.observation_count AS before_observation_count, h.state AS "
    "after_state, h.observation_count AS after_observation_count, NOT (b.state IS NOT DISTINCT FROM h.state AND b.observation_count IS NOT "
    "DISTINCT FROM h.observation_count) AS changed FROM b FULL JOIN h ON b.repo_id = h.repo_id AND b.producer = h.producer",
)
def coverage_delta(spark: SparkSession, sf: str) -> DataFrame:
    return E.coverage_delta(_coverage(spark, sf, _CW[0], "q", 49), _coverage(spark, sf, _CW[1], "r", 48), ["repo_id"])


# --------------------------------------------------------------------------- lineage
_EDGE = (
    "SELECT 'c' || (l_suppkey % 20) AS repo_id, 'u' || l_orderkey AS from_subject_id, 'v' || l_partkey AS to_subject_id, CASE WHEN l_linestatus = 'O' THEN "
    "'built-from' ELSE 'contains' END AS relation, CASE l_linenumber WHEN 1 THEN 'mismatched' WHEN 2 THEN 'unverifiable' END AS status, "
    "CASE WHEN l_tax > 0.04 THEN 'ref' || (l_partkey % 9) END AS evidence_ref, l_shipdate FROM lineitem"
)
_EDGE_CTE = f"""decl AS ({_EDGE}), subj AS (SELECT 'u' || o_orderkey AS subject_id FROM orders WHERE o_orderstatus <> 'P' UNION SELECT 'v' || p_partkey FROM
 part WHERE p_size > 10),
edges AS (SELECT DISTINCT from_subject_id, to_subject_id, relation, coalesce(status, CASE WHEN f.subject_id IS NOT NULL AND t.subject_id IS NOT NULL
 THEN 'matched' ELSE 'unavailable' END) AS status, evidence_ref, f.subject_id IS NOT NULL AND t.subject_id IS NOT NULL AS endpoints_known FROM decl
 LEFT JOIN subj f ON f.subject_id = from_subject_id LEFT JOIN subj t ON t.subject_id = to_subject_id)"""


def declarations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("c"), (F.col("l_suppkey") % 20).cast("string")).alias("repo_id"),
        F.concat(F.lit("u"), F.col("l_orderkey").cast("string")).alias("from_subject_id"),
        F.concat(F.lit("v"), F.col("l_partkey").cast("string")).alias("to_subject_id"),
        F.when(F.col("l_linestatus") == "O", "built-from").otherwise("contains").alias("relation"),
        F.when(F.col("l_linenumber") == 1, "mismatched").when(F.col("l_linenumber") == 2, "unverifiable").alias("status"),
        F.when(F.col("l_tax") > 0.04, F.concat(F.lit("ref"), (F.col("l_partkey") % 9).cast("string"))).alias("evidence_ref"),
        "l_shipdate",
    )


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    # A subject that no declaration names stands in for each one that is not known.
    subjects = (
        table(spark, sf, "orders").select(F.concat(F.when(F.col("o_orderstatus") != "P", "u").otherwise("other u"), F.col("o_orderkey").cast("string")).alias("subject_id"))
        .union(table(spark, sf, "part").select(F.concat(F.when(F.col("p_size") > 10, "v").otherwise("other v"), F.col("p_partkey").cast("string"))))
    )
    return E.resolve_lineage(subjects, declarations(spark, sf).drop("repo_id", "l_shipdate"))


@query("resolve_lineage", f"WITH {_EDGE_CTE} SELECT * FROM edges")
def resolve_lineage(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf)


_ARROW = "from_subject_id || ' -> ' || to_subject_id"


@query(
    "lineage_gaps",
    f"WITH {_EDGE_CTE} SELECT 'lineage endpoint is unavailable for ' || {_ARROW} AS gap FROM edges WHERE NOT endpoints_known UNION SELECT 'lineage "
    f"declaration mismatches ' || {_ARROW} FROM edges WHERE status = 'mismatched' UNION SELECT 'lineage declaration is unverifiable for ' || "
    f"{_ARROW} FROM edges WHERE status = 'unverifiable'",
)
def lineage_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return E.lineage_gaps(_edges(spark, sf))


_LCOLS = "from_subject_id, to_subject_id, relation, coalesce(status, 'matched') AS status, evidence_ref"


@query(
    "lineage_delta",
    f"WITH decl AS ({_EDGE}), b AS (SELECT {_LCOLS} FROM decl WHERE l_shipdate < TIMESTAMP '{SPLIT}'), h AS (SELECT {_LCOLS} FROM decl WHERE "
    f"l_shipdate >= TIMESTAMP '{SPLIT}' OR relation = 'contains') SELECT *, 'removed' AS side FROM (SELECT * FROM b EXCEPT SELECT * FROM h) UNION ALL "
    "SELECT *, 'added' FROM (SELECT * FROM h EXCEPT SELECT * FROM b)",
)
def lineage_delta(spark: SparkSession, sf: str) -> DataFrame:
    d = declarations(spark, sf).withColumn("status", F.coalesce("status", F.lit("matched")))
    late = F.col("l_shipdate") >= F.lit(SPLIT).cast("timestamp_ntz")
    return E.lineage_delta(d.where(~late), d.where(late | (F.col("relation") == "contains")))


@query(
    "gap_delta",
    "WITH b AS (SELECT DISTINCT 'gap ' || p_brand || least(p_size, 24) AS gap FROM part), h AS (SELECT DISTINCT 'gap ' || p_brand || greatest(p_size, 21) FROM part), x AS (SELECT gap, 'removed' AS side FROM (SELECT * FROM b EXCEPT SELECT * FROM h) UNION ALL SELECT gap, 'added' FROM "
    "(SELECT * FROM h EXCEPT SELECT * FROM b) t(gap)) SELECT 'sha256:' || sha256(gap) AS gap_digest, side FROM x",
)
def gap_delta(spark: SparkSession, sf: str) -> DataFrame:
    gap = lambda size: table(spark, sf, "part").select(F.concat(F.lit("gap "), "p_brand", F.expr(size).cast("string")).alias("gap"))
    return E.gap_delta(gap("least(p_size, 24)"), gap("greatest(p_size, 21)"))


@query(
    "comparison_blockers",
    f"""WITH {_DIFF}, e AS (SELECT DISTINCT 's' || (l_partkey % 10) AS repo_id, l_orderkey, l_linestatus AS st FROM lineitem WHERE l_linestatus <> 'O'),
g AS (SELECT DISTINCT 's' || (p_partkey % 7) AS repo_id, p_brand FROM part),
k AS (SELECT DISTINCT repo_id FROM diff), u AS (SELECT repo_id, count(*) FILTER (change = 'severity-unassessed') AS n FROM diff GROUP BY 1),
l AS (SELECT repo_id, sum(n) AS n FROM (SELECT repo_id, count(*) AS n FROM e GROUP BY 1 UNION ALL SELECT repo_id, count(*) FROM g GROUP BY 1) GROUP BY 1)
SELECT repo_id, 'identity-changed' AS code, NULL::BIGINT AS count FROM k WHERE repo_id = 's3' UNION ALL
SELECT repo_id, 'coverage-unavailable', NULL FROM k WHERE repo_id = 's4' UNION ALL
SELECT repo_id, 'coverage-incomplete', NULL FROM k WHERE repo_id IN ('s5', 's6') UNION ALL
SELECT repo_id, 'severity-unassessed', n::BIGINT FROM u WHERE n > 0 UNION ALL SELECT k.repo_id, 'lineage-unresolved', n::BIGINT FROM k JOIN l USING (repo_id)""",
)
def comparison_blockers(spark: SparkSession, sf: str) -> DataFrame:
    diff = _diff(spark, sf)
    repo = F.col("repo_id")
    pairs = diff.select("repo_id").distinct().select(
        "repo_id", F.lit("a").alias("base_subject"), F.when(repo == "s3", "b").otherwise("a").alias("head_subject"),
        F.when(repo == "s5", "incomplete").otherwise("complete").alias("base_coverage"),
        F.when(repo == "s6", "incomplete").when(repo != "s4", "complete").alias("head_coverage"),
    )
    edges = table(spark, sf, "lineitem").select(
        F.concat(F.lit("s"), (F.col("l_partkey") % 10).cast("string")).alias("repo_id"), "l_orderkey",
        F.when(F.col("l_linestatus") == "O", "matched").otherwise("unverifiable").alias("status"),
    )
    gaps = table(spark, sf, "part").select(
        F.concat(F.lit("s"), (F.col("p_partkey") % 7).cast("string")).alias("repo_id"), "p_brand"
    )
    return E.comparison_blockers(pairs, diff, edges, gaps, ["repo_id"])


# --------------------------------------------------------------------------- digests
def _tree_sql(src: str, key: str, member: str, out: str) -> str:
    return f"""h AS (SELECT DISTINCT {key}, sha256({member}) AS h FROM {src}),
t6 AS (SELECT {key}, left(h, 6) AS b, left(h, 6) || sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY ALL),
t3 AS (SELECT {key}, left(h, 3) AS b, left(h, 3) || sha256(string_agg(h, '' ORDER BY h)) AS h FROM (SELECT {key}, h FROM t6) GROUP BY ALL),
tree AS (SELECT {key}, 'sha256:' || sha256(string_agg(h, '' ORDER BY h)) AS {out} FROM t3 GROUP BY {key})"""


def _tree_fix(sql: str) -> str:
    # GROUP BY ALL would also group by the aggregated expression's inputs; name the keys instead
    return sql.replace("FROM h GROUP BY ALL", "FROM h GROUP BY KEY, left(h, 6)").replace(
        "FROM t6) GROUP BY ALL", "FROM t6) GROUP BY KEY, left(h, 3)"
    )


@query(
    "tree_digest",
    "WITH f AS (SELECT source AS repo_id, 'text/' || doc_id || '.txt' AS path, text AS content FROM documents), "
    + _tree_fix(_tree_sql("f", "repo_id", "path || chr(31) || sha256(content)", "tree_digest")).replace("KEY", "repo_id")
    + " SELECT * FROM tree",
)
def tree_digest(spark: SparkSession, sf: str) -> DataFrame:
    from workloads.bindings import document_files

    return E.file_tree_digest(document_files(spark, sf))


@query(
    "create_snapshot",
    f"WITH {OBS_CTE}, c AS (SELECT repo_id, fingerprint, list_sort(list(DISTINCT producer_id)) AS producer_ids, count(*)::BIGINT AS n_payloads, "
    "count(DISTINCT severity) > 1 AS disagreement FROM obs GROUP BY ALL), m AS (SELECT repo_id, disagreement, to_json({'disagreement': disagreement, "
    "'fingerprint': fingerprint, 'n_payloads': n_payloads, 'producer_ids': producer_ids}) AS j FROM c), "
    + _tree_fix(_tree_sql("m", "repo_id", "j", "snapshot_digest")).replace("KEY", "repo_id")
    + ", n AS (SELECT repo_id, count(*)::BIGINT AS n_observations, count(*) FILTER (disagreement)::BIGINT AS n_disagreements FROM m GROUP BY 1) "
    "SELECT * FROM n JOIN tree USING (repo_id)",
)
def create_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    groups = E.correlate(observations(spark, sf), S.canonical_document(F.col("payload")), ["repo_id"])
    return E.create_snapshot(groups, ["repo_id"])


# --------------------------------------------------------------------------- baseline
@query(
    "compare_baseline",
    f"""WITH {OBS_CTE}, cur AS (SELECT DISTINCT repo_id AS subject_id, CASE WHEN repo_id = 's1' THEN 'other' ELSE 'pol' END AS policy_digest, fingerprint FROM obs),
acc AS (SELECT DISTINCT repo_id AS subject_id, fingerprint FROM obs WHERE l_shipdate < TIMESTAMP '{SPLIT}' AND repo_id <> 's6')
SELECT c.subject_id, c.fingerprint, CASE WHEN c.subject_id = 's6' THEN 'unavailable' WHEN c.subject_id IN ('s1', 's2') THEN 'mismatched' WHEN c.subject_id = 's3' THEN 'stale' ELSE 'matched' END AS
baseline_status, CASE WHEN a.fingerprint IS NULL THEN 'new' ELSE 'accepted' END AS verdict FROM cur c LEFT JOIN acc a USING (subject_id, fingerprint)""",
)
def compare_baseline(spark: SparkSession, sf: str) -> DataFrame:
    o = observations(spark, sf)
    repo = F.col("repo_id")
    current = o.select(
        repo.alias("subject_id"), F.when(repo == "s1", "other").otherwise("pol").alias("policy_digest"), "fingerprint"
    )
    # s6 has no baseline; s5 a second one, sooner over, that accepts everything.
    early = F.col("l_shipdate") < F.lit(SPLIT).cast("timestamp_ntz")
    second = o.select(
        F.when(repo == "s5", repo).otherwise("nobody").alias("subject_id"), repo.alias("baseline_subject_id"), F.lit("old").alias("policy_digest"), F.lit("2023-06-01").cast("timestamp").alias("expires_at"),
        F.col("fingerprint").alias("accepted"),
    )
    base = o.select(
        F.when(repo == "s6", "nobody").otherwise(repo).alias("subject_id"), F.when(repo == "s2", "elsewhere").otherwise(repo).alias("baseline_subject_id"),
        F.lit("pol").alias("policy_digest"),
        F.when(repo == "s3", F.lit("2023-01-01").cast("timestamp")).when(repo == "s4", F.lit("2030-01-01").cast("timestamp")).alias("expires_at"),
        F.when(early, F.col("fingerprint")).otherwise("later").alias("accepted"),
    )
    return E.compare_baseline(current, base.unionByName(second), F.lit("2024-01-01").cast("timestamp"))


# --------------------------------------------------------------------------- admission and normalisation
_CLS, _HND = ["non-sensitive", "sensitive", "secret"], ["included", "redacted", "omitted"]


@query(
    "evidence_admissible",
    "WITH e AS (SELECT o_orderkey, " + sql_pick(_CLS, "o_orderkey % 3") + " AS c, " + sql_pick(_HND, "o_custkey % 3") + " AS h, CASE WHEN o_orderstatus = "
    "'F' THEN 'x' END AS t FROM orders) SELECT o_orderkey, list_filter([CASE WHEN c = 'secret' AND h <> 'omitted' THEN 'secret evidence must be omitted' "
    "END, CASE WHEN h = 'omitted' AND t IS NOT NULL THEN 'omitted evidence cannot contain content' END, CASE WHEN h <> 'omitted' AND t IS NULL THEN "
    "'included or redacted evidence requires content' END, CASE WHEN c = 'sensitive' AND h = 'included' THEN 'sensitive evidence must be redacted or "
    "omitted' END], lambda x: x IS NOT NULL) AS issues FROM e",
)
def evidence_admissible(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        "o_orderkey",
        E.evidence_issues(
            pick(_CLS, F.pmod("o_orderkey", F.lit(3))), pick(_HND, F.pmod("o_custkey", F.lit(3))),
            F.when(F.col("o_orderstatus") == "F", "x"),
        ).alias("issues"),
    )


def _table_observations(spark: SparkSession, sf: str) -> DataFrame:
    return E.native_to_observation(
        table_findings(spark, sf), F.concat(F.lit("subject:"), "repo_id"), F.concat(F.lit("run:"), "rule")
    )


_NATIVE = f"""{TABLE_FINDINGS_CTE},
o AS (SELECT *, CASE WHEN confidence_score IS NULL THEN 'unknown' WHEN confidence_score >= .9 THEN 'certain' WHEN confidence_score >= .7 THEN 'high'
 WHEN confidence_score >= .4 THEN 'medium' WHEN confidence_score > 0 THEN 'low' ELSE 'unknown' END AS lvl FROM findings),
j AS (SELECT *, sha256(to_json({{'category': detector, 'confidence': lvl, 'label': label, 'path': file, 'ruleId': rule, 'runId': 'run:' || rule,
 'severity': severity, 'snippet': NULL::VARCHAR, 'startLine': line, 'subjectId': 'subject:' || repo_id, 'title': title}})) AS h FROM o),
nat AS (SELECT 'urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-8' || substr(h, 18, 3) || '-' || substr(h, 21, 12)
 AS observation_id, 'subject:' || repo_id AS subject_id, rule, title, severity, lvl AS confidence_level, file AS path, line::BIGINT AS start_line FROM j)"""


@query("native_to_observation", f"WITH {_NATIVE} SELECT * FROM nat")
def native_to_observation(spark: SparkSession, sf: str) -> DataFrame:
    return _table_observations(spark, sf).select(
        "observation_id", "subject_id", "rule", "title", "severity", "confidence_level", "path", "start_line"
    )


@query(
    "observation_fingerprint",
    f"WITH {_NATIVE} SELECT observation_id, 'sha256:' || sha256(to_json({{'advisory': NULL::VARCHAR, 'evidenceClass': 'native', 'location': path || ':' || "
    "start_line, 'package': NULL::VARCHAR, 'rule': rule, 'subjectId': subject_id, 'version': 'v1'})) AS fingerprint FROM nat",
)
def observation_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return _table_observations(spark, sf).select("observation_id", E.observation_fingerprint().alias("fingerprint"))


@query(
    "validate_rows",
    f"WITH {_NATIVE} SELECT observation_id, list_filter([CASE WHEN path = '' OR starts_with(path, '/') OR contains(path, '\\') OR regexp_matches(path, "
    "'^[A-Za-z]:') OR list_has_any(string_split(path, '/'), ['', '.', '..']) THEN 'path is unsafe' END], lambda x: x IS NOT NULL) AS issues FROM nat",
)
def validate_rows(spark: SparkSession, sf: str) -> DataFrame:
    return E.validate_rows(_table_observations(spark, sf)).select("observation_id", "issues")


@query(
    "valid_and_quarantined",
    f"WITH {_NATIVE}, v AS (SELECT path = '' OR starts_with(path, '/') OR contains(path, '\\') OR regexp_matches(path, '^[A-Za-z]:') OR "
    "list_has_any(string_split(path, '/'), ['', '.', '..']) AS bad FROM nat) SELECT CASE WHEN bad THEN 'quarantined' ELSE 'valid' END AS part, "
    "count(*)::BIGINT AS n FROM v GROUP BY 1",
)
def valid_and_quarantined(spark: SparkSession, sf: str) -> DataFrame:
    checked = E.validate_rows(_table_observations(spark, sf))
    return checked.groupBy(E.row_part().alias("part")).agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------- provenance, binding, linkage
@query(
    "match_provenance_digest",
    "WITH e AS (SELECT o_orderkey AS doc_id, sha256(o_custkey::VARCHAR) AS e FROM orders), h AS (SELECT l_orderkey AS doc_id, sha256((l_partkey % 1500)::VARCHAR) AS v "
    "FROM lineitem WHERE l_linestatus = 'O' UNION ALL SELECT o_orderkey, sha256(o_custkey::VARCHAR) FROM orders WHERE o_orderstatus = 'F') SELECT e.doc_id, "
    "CASE WHEN count(v) = 0 THEN 'unavailable' WHEN bool_or(v = e) THEN 'matched' ELSE 'mismatched' END AS state FROM e LEFT JOIN h USING (doc_id) GROUP BY 1",
)
def match_provenance_digest(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        F.when(F.col("l_linestatus") == "O", "sha256").otherwise("sha512").alias("algorithm"),
        F.sha2((F.col("l_partkey") % 1500).cast("string"), 256).alias("value"),
    )
    o = table(spark, sf, "orders")
    own = o.select(
        F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "F", "sha256").otherwise("sha512").alias("algorithm"),
        F.upper(F.sha2(F.col("o_custkey").cast("string"), 256)).alias("value"),
    )
    expected = o.select(F.col("o_orderkey").alias("doc_id"), sha256_tag(F.col("o_custkey").cast("string")).alias("expected"))
    return E.match_provenance_digest(li.unionByName(own), expected)


_KINDS = ["repository-tree", "filesystem", "sbom", "artifact", "package"]
_FORMATS = ["in-toto", "cyclonedx", "spdx"]


@query(
    "bind_evidence",
    "WITH s AS (SELECT o_orderkey, o_custkey, " + sql_pick(_KINDS, f"o_orderkey % {len(_KINDS)}") + " AS kind, " + sql_pick(_FORMATS, "o_custkey % 3")
    + " AS format FROM orders), d AS (SELECT s.*, l_partkey FROM s JOIN lineitem ON o_orderkey = l_orderkey), b AS (SELECT o_orderkey AS doc_id, format, "
    "bool_or(CASE WHEN format = 'in-toto' THEN l_partkey % 4 = 1 ELSE kind = 'sbom' AND l_partkey % 4 = 1 END) AS bound FROM d GROUP BY ALL) SELECT doc_id, bound, "
    "CASE WHEN format = 'in-toto' AND bound THEN 'digest matches the target; signature and builder remain unverified' WHEN format = 'in-toto' THEN "
    "'provenance does not prove the selected target identity' WHEN bound THEN 'document matches the subject; its contents are not policy observations' "
    "ELSE 'document digest does not match the selected subject' END AS limitation FROM b",
)
def bind_evidence(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    kind = pick(_KINDS, F.pmod("o_orderkey", F.lit(len(_KINDS))))
    digest = F.concat(F.lit("d"), F.col("o_orderkey").cast("string"))
    subjects = o.select(
        F.col("o_orderkey").alias("subject_id"), kind.alias("kind"),
        F.when(kind.isin("artifact", "package"), digest).alias("digest"), F.when(kind == "filesystem", digest).alias("tree_digest"),
        F.when(kind == "repository-tree", digest).alias("worktree_digest"), F.when(kind == "sbom", digest).alias("document_digest"),
    )
    fmt = o.select(F.col("o_orderkey").alias("l_orderkey"), pick(_FORMATS, F.pmod("o_custkey", F.lit(3))).alias("format"))
    docs = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(fmt, "l_orderkey").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_orderkey").alias("subject_id"), "format",
        F.when(F.col("l_partkey") % 4 == 1, F.concat(F.lit("d"), F.col("l_orderkey").cast("string"))).otherwise("x").alias("digest"),
    )
    return E.bind_evidence(docs, subjects)


@query(
    "source_artifact_linkage",
    "SELECT o_orderkey AS source_id, o_custkey AS artifact_id, CASE WHEN o_orderstatus = 'P' THEN 'unavailable' WHEN o_orderpriority = '1-URGENT' THEN "
    "'unverifiable' WHEN o_orderkey % 4 = 2 THEN 'mismatched' ELSE 'matched' END AS status FROM orders",
)
def source_artifact_linkage(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("source_id"), F.col("o_custkey").alias("artifact_id"),
        F.when(F.col("o_orderstatus") != "P", F.lit("d")).alias("declaration_id"),
        (F.col("o_orderpriority") != "1-URGENT").alias("verifiable"),
        F.when(F.col("o_orderkey") % 4 == 2, F.lit(-1).cast("bigint")).otherwise(F.col("o_orderkey")).alias("declared_source"),
        F.col("o_custkey").alias("declared_artifact"),
    )
    return E.source_artifact_linkage(rows)


# --------------------------------------------------------------------------- records
_TEXT = "l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_quantity"


@query(
    "record_integrity",
    f"""WITH m AS (SELECT DISTINCT l_suppkey AS record_id, {_TEXT} AS path, l_partkey % 11 AS k, l_orderkey % 6 AS r, 'sha256:' || sha256({_TEXT}) AS d0 FROM lineitem),
n AS (SELECT record_id, path, k, r, CASE WHEN k = 5 THEN 'sha256:same' ELSE d0 END AS d, CASE WHEN r = 0 THEN 'omitted' ELSE 'none' END AS red, r IN (0, 1) AND k < 4 AS req FROM m),
c AS (SELECT *, count(*) OVER (PARTITION BY record_id, d) AS n FROM n)
SELECT record_id, path, CASE WHEN n > 1 THEN 'member digest is duplicated' WHEN red = 'omitted' AND req THEN 'required member cannot be omitted' WHEN red = 'omitted' THEN NULL
 WHEN k = 6 OR k = 5 THEN 'payload is missing' WHEN k = 7 THEN 'size mismatch' WHEN k = 8 THEN 'digest mismatch' END AS error FROM c
WHERE n > 1 OR (red = 'omitted' AND req) OR (red <> 'omitted' AND k IN (5, 6, 7, 8))""",
)
def record_integrity(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat_ws(":", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_quantity"))
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("record_id"), text.alias("path"), (F.col("l_partkey") % 11).alias("k"), (F.col("l_orderkey") % 6).alias("r")
    ).distinct()
    digest = sha256_tag(F.col("path"))
    k, r = F.col("k"), F.col("r")
    members = rows.select(
        "record_id", "path", F.when(k == 5, "sha256:same").otherwise(digest).alias("digest"),
        (F.length("path") + F.when(k == 7, 1).otherwise(0)).cast("bigint").alias("size"),
        (r.isin(0, 1) & (k < 4)).alias("required"), F.when(r == 0, "omitted").otherwise("none").alias("redaction"),
    )
    payloads = rows.where(~k.isin(5, 6)).select(
        "record_id", digest.alias("digest"),
        F.when(k == 8, F.translate("path", "0123456789", "1234567890")).otherwise(F.col("path")).alias("payload"),
    )
    return E.record_integrity(members, payloads)


@query(
    "redaction_coverage",
    "WITH m AS (SELECT DISTINCT l_suppkey AS record_id, 'd' || l_partkey || CASE WHEN l_linenumber = 1 THEN 'a' ELSE '' END AS digest, CASE WHEN l_partkey % 3 = 0 THEN 'applied' ELSE 'none' END AS disposition FROM lineitem"
    "), e AS (SELECT DISTINCT l_suppkey, 'd' || l_partkey || CASE WHEN l_linenumber = 7 THEN 'b' ELSE '' END, CASE WHEN l_partkey % 3 = 0 AND l_partkey % 2 = 0 THEN 'applied' ELSE 'none' END FROM lineitem"
    ") SELECT *, 'undeclared' AS side FROM (SELECT * FROM m EXCEPT SELECT * FROM e) UNION ALL SELECT *, 'unexpected' FROM (SELECT * FROM e EXCEPT SELECT * FROM m)",
)
def redaction_coverage(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    digest = F.concat(F.lit("d"), F.col("l_partkey").cast("string"))
    third = F.col("l_partkey") % 3 == 0
    mark = lambda line, text: F.concat(digest, F.when(F.col("l_linenumber") == line, text).otherwise("")).alias("digest")
    members = li.select(
        F.col("l_suppkey").alias("record_id"), mark(1, "a"), F.when(third, "applied").otherwise("none").alias("redaction"),
        F.lit("policy").alias("kind"),
    )
    entries = li.select(
        F.col("l_suppkey").alias("record_id"), mark(7, "b"),
        F.when(third & (F.col("l_partkey") % 2 == 0), "applied").otherwise("none").alias("disposition"),
    )
    return E.redaction_coverage(members, entries)


