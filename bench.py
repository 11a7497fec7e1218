"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is planned and run to the end once cold and twice warm; the smaller warm
time counts, and the cold times are printed beside it.  ``noop`` consumes every row and column without writing them.
"""

from __future__ import annotations

import json
import os
import sys
import time

from assayline.session import local_session

HEADLINE = [
    "security_score", "scan_all_rules", "document_secrets", "security_score_table", "apply_context_tags", "top_findings", "rule_leaderboard",
    "campaign_summary", "redact_text", "vulnerable_dependencies", "lookalike_packages", "package_verdict", "license_inventory", "commit_shape",
    "file_trailers", "repo_provenance", "correlate", "risk_projection", "diff_snapshots", "fuzzy_duplicates", "create_snapshot", "resolve_lineage",
    "import_sarif", "import_trivy", "policy_decision", "applicable_exceptions", "record_integrity", "weekly_digest", "watch_scan",
]


def main() -> None:
    import workloads

    workloads.load_all()
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    cold: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            workloads.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(round(time.perf_counter() - start, 3))
        cold[name], times[name] = runs[0], min(runs[1:])
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "cold": cold, "sf": sf_dir.rsplit("sf", 1)[-1]}
        )
    )


if __name__ == "__main__":
    main()
