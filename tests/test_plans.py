"""From a folder of files to scores; files, reports and determinism."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from assayline.operators import context, score
from assayline.plans.extension import Lookups
from assayline.plans.project_scan import ProjectScan, check_snippets
from assayline.sources import sinks
from assayline.operators import supply
from assayline.sources import packages
from assayline.sources.files import agent_config_files, scan_source_files, with_file_facts


def tree(root):
    files = {
        "shop/server.js": "import express from 'express'\nconst app = express()\napp.post('/login', h)\nconst token = Math.random()\n",
        "shop/package.json": '{"name":"shop","dependencies":{"express":"4","reakt":"1"},"workspaces":["packages/*"]}',
        "shop/package-lock.json": '{"packages":{"node_modules/express":{"version":"4.0.0"}}}',
        "shop/src/a.test.ts": "eval(x)\n",
        "shop/docs/guide.md": "password = letmein\n",
        "shop/.env": "A=1\n",
        "shop/public/vendor/jquery-3.4.1.js": "x\n",
        "shop/notes.bin": "eval(x)",
        "shop/.cursor/mcp.json": '{"mcpServers":{"web":{"url":"http://h.example/x","allowedTools":["a"]}}}',
        "clean/src/ok.ts": "export const a = 1\n",
    }
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def lookups(spark):
    adv = spark.createDataFrame(
        [("npm", "express", "4.0.0", "ADV-1", ["CVE-1"], "s", "HIGH", "4.1"), ("npm", "jquery", "3.4.1", "ADV-2", [], "s", "MODERATE", "3.5")],
        "ecosystem string, name string, version string, vuln_id string, aliases array<string>, summary string, raw_severity string, fixed_version string",
    )
    reg = spark.createDataFrame([("reakt", True), ("express", True)], "name string, exists boolean").withColumn("checked_at", F.lit("2024-01-01").cast("timestamp"))
    return Lookups(adv, reg, F.lit("2024-01-01 06:00:00").cast("timestamp"))


def test_folder_to_scores(spark, tmp_path):
    tree(tmp_path)
    files = scan_source_files(spark, str(tmp_path), ignore=["**/ignored/**"])
    assert {(r.repo_id, r.path) for r in files.collect()} == {
        ("shop", "server.js"), ("shop", "package.json"), ("shop", "package-lock.json"), ("shop", "src/a.test.ts"), ("shop", "docs/guide.md"),
        ("shop", ".env"), ("shop", "public/vendor/jquery-3.4.1.js"), ("clean", "src/ok.ts"),
    }
    plan = ProjectScan(
        detectors=["secrets", "dependencies", "injection", "misconfig", "ai-patterns", "slopsquat", "vendored-cves", "api-hardening", "deep-auth"],
        min_confidence=0.0, lookups=lookups(spark),
    )
    found = plan.findings(files)
    got = {(r.rule, r.file, r.severity, r.context_tag) for r in found.collect() if r.repo_id == "shop"}
    assert ("D5-001", ".env", "info", "dev-fixture") in got
    assert ("AI-002", "server.js", "critical", None) in got
    assert ("API-001", "server.js", "high", None) in got and ("API-005", "server.js", "medium", None) in got
    assert ("D5-003", "src/a.test.ts", "info", "test-fixture") in got
    assert ("D4-001", "docs/guide.md", "info", "docs") in got
    assert ("D6-001", "package-lock.json", "high", None) in got
    assert ("D6-002", "public/vendor/jquery-3.4.1.js", "medium", None) in got
    assert ("AI-006", "package.json", "high", None) in got
    scores = {r.repo_id: (r.score, r.unsupported) for r in plan.scores(files, found).collect()}
    assert scores["clean"] == (100, True)
    assert scores["shop"][0] < 80 and scores["shop"][1] is False


def test_agent_configs_are_found_in_hidden_folders(spark, tmp_path):
    tree(tmp_path)
    repos = spark.createDataFrame([("shop",), ("clean",)], "repo_id string")
    servers = packages.read_agent_configs(agent_config_files(repos, str(tmp_path)))
    (row,) = supply.agent_findings_of_servers(servers).collect()
    assert (row.repo_id, row.rule, row.file) == ("shop", "AGENT-005", ".cursor/mcp.json")


def test_default_threshold_drops_medium(spark, tmp_path):
    tree(tmp_path)
    files = scan_source_files(spark, str(tmp_path))
    rules = {r.rule for r in ProjectScan(lookups=lookups(spark)).findings(files).collect()}
    assert "AI-006" not in rules and "AI-002" in rules


def test_findings_do_not_depend_on_partitioning(spark, tmp_path):
    tree(tmp_path)
    files = scan_source_files(spark, str(tmp_path))
    plan = ProjectScan()
    one = sorted(r.finding_id for r in plan.findings(files.coalesce(1)).collect())
    many = sorted(r.finding_id for r in plan.findings(files.repartition(7)).collect())
    assert one == many and len(one) == len(set(one))


def test_report_is_written_by_repository(spark, tmp_path):
    tree(tmp_path / "in")
    files = scan_source_files(spark, str(tmp_path / "in"))
    found = ProjectScan().findings(files)
    sinks.write_json_report(found, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out"))
    assert back.count() == found.count()
    assert back.where(F.get_json_object("value", "$.report_version") == "2.0.0").count() == found.count()


def test_snippet_check_and_file_facts(spark):
    docs = spark.createDataFrame([("d", "a.ts", "const otp = Math.random()"), ("d", "b.ts", "const a = 1")], "repo_id string, path string, content string")
    assert {r.path: r.verdict for r in check_snippets(docs).collect()} == {"a.ts": "block", "b.ts": "allow"}
    assert {(r.ext, r.n_lines) for r in with_file_facts(docs).collect()} == {("ts", 1)}


def test_score_floor_without_criticals(spark):
    rows = [("r", f"D{d}", "high") for d in range(1, 9) for _ in range(9)]
    df = spark.createDataFrame(rows, "repo_id string, domain string, severity string")
    for c in ("context", "context_tag"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    df = df.withColumn("confidence_level", F.lit("high")).withColumn("confidence_score", F.lit(None).cast("double"))
    (row,) = score.security_score(df).collect()
    assert (row.score, row.band, row.high) == (10, "critical", 72)


def test_ignore_file_lines():
    assert context.ignore_lines("# note\n\n dist/** \n*.tmp") == ["dist/**", "*.tmp"]


def test_facts_meet_hits_and_never_file_content(spark):
    from assayline.operators.scan import scan_files

    files = spark.createDataFrame([("r", "a.js", "app.use(cors({ origin: '*' }))")], "repo_id string, path string, content string")
    facts = spark.createDataFrame([("r", True)], "repo_id string, has_auth boolean")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = scan_files(files, detectors=["ai-patterns", "misconfig"], repo_facts=facts)
        moved = [x for x in found._jdf.queryExecution().executedPlan().treeString().splitlines() if "Exchange" in x]
        text = found._jdf.queryExecution().explainString(found.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        inputs = [b for b in text.split("\n\n") if ") Exchange" in b]
        assert moved and inputs and not any("content" in b or "_lines" in b or "_low" in b for b in inputs)
        assert {r.rule for r in found.collect()} == {"AI-001"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_repository_of_hidden_files_is_found_and_ignored_folders_stay_closed(spark, tmp_path):
    for name in ("hub/.github/workflows/ci.yml", "hub/node_modules/x/a.js", "mono/a/b/c/d/deep.ts", "mono/dist/out.js", "mono/skip/s.ts", "top.ts"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("eval(x)")
    for closed in ("hub/node_modules", "mono/dist", "mono/skip"):
        (tmp_path / closed).chmod(0)  # listing it would fail for anyone but root
    try:
        got = scan_source_files(spark, str(tmp_path), ignore=["**/skip/**"])
        assert {(r.repo_id, r.path) for r in got.collect()} == {("hub", ".github/workflows/ci.yml"), ("mono", "a/b/c/d/deep.ts")}
        assert {r.path for r in scan_source_files(spark, str(tmp_path), ["**/skip/**"], include_hidden=False).collect()} == {"a/b/c/d/deep.ts"}
    finally:
        for closed in ("hub/node_modules", "mono/dist", "mono/skip"):
            (tmp_path / closed).chmod(0o755)


def test_bills_of_material_are_written_without_a_shuffle(spark, data):
    import workloads

    workloads.load_all()
    plan = workloads.QUERIES["export_bom"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Scan parquet") <= 6


def test_contents_are_read_once_for_lines(spark, tmp_path):
    """One scan of the plan reads contents; the files with a name of their own were routed out before."""
    files = [("r", "package.json", '{"dependencies":{"express":"4"},"workspaces":["p/*"]}'), ("r", "p/a/package.json", '{"name":"own"}'), ("r", ".env", "X=1"), ("r", "src/a.js", "eval(userInput)"), ("r", "next.config.js", "x")]
    spark.createDataFrame(files, "repo_id string, path string, content string").write.parquet(str(tmp_path / "files"))
    scan = ProjectScan(lookups=lookups(spark))
    found = scan.raw_findings(spark.read.parquet(str(tmp_path / "files")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: (struct<[^\n]*)", plan)
    assert len(schemas) >= 2 and sum("content" in s for s in schemas) == 1
    assert {"D5-001", "D5-004"} <= {r.rule for r in found.collect()}
