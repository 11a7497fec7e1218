"""Plans from end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.plans import inspection
from assayline.plans.project_scan import check_snippets
from workloads import query
from workloads.bindings import code_files
from workloads.documents_io import _SARIF_ROWS, _TRIVY, _col, _sarif_docs, _sql_expr, documents_of
from workloads.rule_pack import ALL_RULES, R, rules_sql


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    sarif = _sarif_docs(spark, sf).withColumn("producer", F.lit("sarif"))
    trivy = documents_of(spark, sf, _sql_expr(_TRIVY)).withColumn("producer", F.lit("trivy"))
    return sarif.unionByName(trivy)


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    producers = {"sarif": inspection.SarifNormalizer(), "trivy": inspection.TrivyNormalizer()}
    return inspection.group(inspection.observe(_documents(spark, sf), producers))


_OBS = f"""WITH {_SARIF_ROWS}, o AS (SELECT 'subject:' || o_custkey AS subject_id, 'sarif.import' AS p, {_col(3)} AS rule, {_col(1)} || ':' || coalesce({_col(2)}::VARCHAR, '') AS loc FROM res WHERE {_col(1)} IS NOT NULL
UNION ALL SELECT 'subject:' || o_custkey, 'trivy', 'v' || (o_orderkey % 99), 'p' || (o_custkey % 30) FROM orders
UNION ALL SELECT 'subject:' || o_custkey, 'trivy', 'm', 'Dockerfile:3' FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'subject:' || o_custkey, 'trivy', 's', 'Dockerfile' FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 > 0)"""


@query(
    "inspection_groups",
    _OBS + " SELECT subject_id, p AS producer_id, count(DISTINCT rule || '|' || loc)::BIGINT AS groups, count(*)::BIGINT AS payloads FROM o GROUP BY ALL",
)
def inspection_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of two producers: imported, validated, fingerprinted, correlated."""
    g = _groups(spark, sf)
    return (
        g.select("subject_id", F.explode("producer_ids").alias("producer_id"), "n_payloads")
        .groupBy("subject_id", "producer_id")
        .agg(F.count(F.lit(1)).alias("groups"), F.sum("n_payloads").alias("payloads"))
    )


@query(
    "inspection_snapshots",
    _OBS + " SELECT subject_id, count(DISTINCT p || '|' || rule || '|' || loc)::BIGINT AS n_observations, 71::INT AS digest_length FROM o GROUP BY 1",
)
def inspection_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    s = inspection.snapshot(_groups(spark, sf))
    return s.select("subject_id", "n_observations", F.length("snapshot_digest").alias("digest_length"))


_SNIPPET_RULES = [r for r in ALL_RULES if R.BY_ID[r].detector in ("secrets", "injection", "ai-patterns") and r != "AI-001"]


@query(
    "check_snippets",
    rules_sql(_SNIPPET_RULES)
    + " SELECT c.repo_id, c.path, CASE WHEN bool_or(severity = 'critical' AND confidence_level IN ('certain', 'high')) THEN 'block' WHEN bool_or(severity = 'high' AND confidence_level IN ('certain', 'high')) THEN 'warn' ELSE 'allow' END AS verdict "
    "FROM code_files c LEFT JOIN F ON F.repo_id = c.repo_id AND F.file = c.path GROUP BY ALL",
)
def check_snippets_query(spark: SparkSession, sf: str) -> DataFrame:
    return check_snippets(code_files(spark, sf))
