"""Registered queries against their SQL twins, regex parity, and the shape of all plans."""

from __future__ import annotations

import os
import re

import duckdb
import pytest
from check_oracle import TABLES, norm

import workloads
from assayline.functions.regex import portable
from assayline.operators import rules as R

workloads.load_all()

SAMPLE = [
    "security_score", "scan_all_rules", "document_secrets", "apply_context_tags", "vulnerable_dependencies", "package_verdict", "repo_provenance",
    "correlate", "diff_snapshots", "create_snapshot", "import_sarif", "import_trivy", "policy_decision", "export_sarif", "archive_member_safety",
    "weekly_digest", "missing_entrypoints", "comparison_blockers",
]
NAMES = list(workloads.QUERIES) if os.environ.get("ASSAYLINE_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, data, name):
    df = workloads.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    rel = con.sql(workloads.ORACLES[name])
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    want = sorted((tuple(norm(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    assert cols == [rel.columns[i] for i in order]
    assert got == want


def test_report_order(spark, data):
    rows = workloads.QUERIES["sort_findings"](spark, data).collect()
    keys = [(r.context_rank, -r.severity_rank, r.report_key) for r in rows]
    assert keys == sorted(keys)


def test_every_query_has_a_twin_and_a_plain_name():
    assert set(workloads.QUERIES) == set(workloads.ORACLES)
    assert not [n for n in workloads.QUERIES if re.match(r"op_?\d", n) or "pipeline" in n]


STREAMS = {"watch_scan", "monitor_alerts", "weekly_digest", "fresh_lookup", "one_time_approval", "deliver_if_changed", "score_history"}


JOINS = [
    "vulnerable_dependencies", "lookalike_packages", "lookalikes_by_key", "package_verdict", "fuzzy_duplicates", "resolve_lineage",
    "applicable_exceptions", "plan_hypotheses", "audit_proof_binding", "scenario_matrix_gaps", "missing_surfaces", "dangling_references",
    "workspace_package_names", "has_auth", "repo_prior",
]


def test_no_plan_pairs_everything_with_everything(spark, data):
    """All plans with ``ASSAYLINE_ALL``, else those whose definition tempts to it."""
    bad = []
    for name, fn in workloads.QUERIES.items():
        if name in STREAMS or not (os.environ.get("ASSAYLINE_ALL") or name in JOINS):
            continue
        plan = fn(spark, data)._jdf.queryExecution().executedPlan().toString()
        if "CartesianProduct" in plan or "NestedLoopJoin" in plan:
            bad.append(name)
    assert bad == []


def test_dangling_references_broadcasts_no_exploded_observations(spark, data):
    plan = workloads.QUERIES["dangling_references"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") == 2


def test_policy_profiles_shuffle_no_findings(spark, data):
    plan = workloads.QUERIES["policy_profiles"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_rows_are_checked_for_both_parts_in_one_pass(spark, data):
    plan = workloads.QUERIES["valid_and_quarantined"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("sha2(") == 1


def test_indents_of_a_file_are_measured_once(spark, data):
    plan = workloads.QUERIES["code_shape_signals"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 1


def test_evidence_is_parsed_once_to_tell_its_format(spark, data):
    plan = workloads.QUERIES["classify_evidence_format"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 1


def test_the_table_function_makes_no_frame_per_document(spark, data):
    for name in ("normalize_cyclonedx", "normalize_detect_secrets"):
        plan = workloads.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPythonUDTF" in plan and "ArrowEvalPythonUDTF" not in plan


def patterns():
    out = []
    for name, value in vars(R).items():
        if name.isupper() and isinstance(value, str) and len(value) > 8:
            out.append((name, value))
    return out


def test_patterns_mean_the_same_in_both_engines(spark, con):
    from workloads.bindings import SNIPPETS

    lines = [*SNIPPETS, "étoken = 1", "token = é", "évalue eval(x)", "naïve password", "über secret: x", "Math.random() é"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string")
    con.execute("CREATE OR REPLACE TABLE lines AS SELECT unnest(?) AS t, unnest(range(0, ?)) AS i", [lines, len(lines)])
    exprs = [df.t.rlike(portable(p)).alias(f"c{k}") for k, (_, p) in enumerate(patterns())]
    spark_rows = {r.i: list(r)[1:] for r in df.select("i", *exprs).collect()}
    for k, (name, p) in enumerate(patterns()):
        duck = dict(con.execute("SELECT i, regexp_matches(t, ?) FROM lines", [p]).fetchall())
        diff = [lines[i] for i in duck if duck[i] != spark_rows[i][k]]
        assert diff == [], (name, diff)
