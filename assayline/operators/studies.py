"""Studies and release bookkeeping: triage, reviews, answers, regressions, checklists."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from assayline.operators.evidence import labels
from assayline.operators.rules import RULES
from assayline.operators.spread import dealt


def rules_table(df: DataFrame) -> DataFrame:
    """Rule metadata as rows (``df`` only lends its session); one row per rule, so always small."""
    rows = [
        (r.rule, r.detector, r.domain, r.category, r.title, None if callable(r.severity) else r.severity,
         None if callable(r.confidence) else r.confidence)
        for r in RULES
    ]
    return df.sparkSession.createDataFrame(
        rows, "rule string, rule_detector string, rule_domain string, rule_category string, rule_title string, "
        "rule_severity string, rule_confidence string",
    )


def explain_rules(findings: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Findings with their rule's metadata; the built-in table has about forty rows and is broadcast."""
    table = F.broadcast(rules_table(findings)) if rules is None else rules
    return findings.join(table, "rule", "left")


def rule_triage(findings: DataFrame) -> DataFrame:
    """Observed count and severities per rule (severities are a fixed domain)."""
    return findings.groupBy("rule").agg(
        F.count(F.lit(1)).alias("observed"), F.array_sort(F.collect_set("severity")).alias("severities")
    )


def coverage_triage(coverage: DataFrame) -> DataFrame:
    """``repo_id, triage`` from ``status, n_limitations``."""
    ok = (F.col("status") == "complete") & (F.col("n_limitations") == 0)
    return coverage.select(
        "repo_id", F.when(F.coalesce(ok, F.lit(False)), "no-coverage-gap-observed").otherwise("coverage-gap-requires-review").alias("triage")
    )


# --------------------------------------------------------------------------- reviews
def adjudicate_reviews(reviews: DataFrame, resolutions: DataFrame, required: int = 2) -> DataFrame:
    """``sample_id, final_label, disagreement, issue`` from two reviews per sample.

    A disagreement needs a later resolution; min and max of the labels tell a
    disagreement without collecting the reviews.
    """
    per = reviews.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.max("reviewed_at").alias("_last")
    )
    j = per.join(resolutions, "sample_id", "left")
    split = F.col("_lo") != F.col("_hi")
    issue = (
        F.when(F.col("_n") != required, "wrong number of reviews")
        .when(split & F.col("resolved_label").isNull(), "unresolved disagreement")
        .when(split & (F.col("resolved_at") <= F.col("_last")), "resolution before labels were frozen")
        .when(~split & F.col("resolved_label").isNotNull(), "resolution without disagreement")
    )
    return j.select(
        "sample_id", F.when(split, F.col("resolved_label")).otherwise(F.col("_lo")).alias("final_label"),
        split.alias("disagreement"), issue.alias("issue"),
    )


def adjudication_summary(samples: DataFrame, min_valid: int = 100) -> DataFrame:
    """One row: counts per final label, disagreements, valid samples, whether there are enough."""
    valid = F.count_if(F.col("final_label") != "out-of-scope")
    names = ["confirmed", "not-reproduced", "environment-failure", "out-of-scope"]
    return samples.agg(
        F.count(F.lit(1)).alias("samples"), valid.alias("valid_samples"), F.count_if("disagreement").alias("disagreements"),
        F.count("issue").alias("issues"),
        *[F.count_if(F.col("final_label") == n).alias(n.replace("-", "_")) for n in names],
        (valid >= min_valid).alias("enough"),
    )


CONFIDENCES = ["low", "medium", "high"]


def adjudicated_samples(samples: DataFrame, reviews: DataFrame, resolutions: DataFrame, author: str | None = None, required: int = 2) -> DataFrame:
    """Per row of ``samples`` (``sample_id, detector``): ``final_label, disagreement, reviews, low, medium, high, changed, limited, issues``.

    ``reviews``: ``sample_id, reviewer, label, reviewed_at, confidence, changed_finding, limitation, exclusion_reason``;
    ``resolutions``: ``sample_id, resolved_label, resolved_at, method, reviewer, exclusion_reason``, one per sample.
    A third reviewer has to be none of the sample's reviewers and not ``author``, who wrote what is
    judged; a sample out of scope needs a reason from its resolution, or without one from
    every review.  Reviews are aggregated to counts and extremes; that a resolver also reviewed
    is a semi join, so a sample may have any number of reviews.
    """
    c = F.col
    per = reviews.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.max("reviewed_at").alias("_last"),
        F.count_if(c("exclusion_reason").isNull()).alias("_unexplained"), F.count_if("changed_finding").alias("changed"), F.count("limitation").alias("limited"),
        *[F.count_if(c("confidence") == x).alias(x) for x in CONFIDENCES],
    )
    again = resolutions.select("sample_id", "reviewer").join(reviews.select("sample_id", "reviewer"), ["sample_id", "reviewer"], "left_semi")
    by = resolutions.select("sample_id", "resolved_label", "resolved_at", "method", c("reviewer").alias("_by"), c("exclusion_reason").alias("_why"))
    j = (
        samples.select("sample_id", "detector").join(per, "sample_id", "left").join(by, "sample_id", "left")
        .join(again.select("sample_id", F.lit(True).alias("_again")).distinct(), "sample_id", "left")
    )
    split = F.coalesce(c("_lo") != c("_hi"), F.lit(False))
    final = F.when(split, c("resolved_label")).otherwise(c("_lo"))
    resolved, n = c("resolved_at").isNotNull(), F.coalesce("_n", F.lit(0))
    own = c("_again").isNotNull() | F.coalesce(c("_by") == F.lit(author), F.lit(False))
    issues = labels(
        (n != required, "wrong number of reviews"),
        (split & ~resolved, "unresolved disagreement"),
        (split & (c("resolved_at") <= c("_last")), "resolution before labels were frozen"),
        (split & (c("method") == "third-reviewer") & own, "third reviewer is not independent"),
        (~split & resolved, "resolution without disagreement"),
        ((final == "out-of-scope") & F.when(split, c("_why").isNull()).otherwise(c("_unexplained") > 0), "exclusion without a reason"),
    )
    counts = [F.coalesce(x, F.lit(0)).cast("bigint").alias(x) for x in (*CONFIDENCES, "changed", "limited")]
    return j.select("sample_id", "detector", final.alias("final_label"), split.alias("disagreement"), n.cast("bigint").alias("reviews"), *counts, issues.alias("issues"))


def adjudication_report(adjudicated: DataFrame, min_valid: int = 100) -> DataFrame:
    """Per detector and over all (``detector`` null): samples, the denominator, labels, disagreements, confidences, changes, limitations, issues, ``valid``.

    Samples out of scope are no part of the denominator; a study is valid with enough others and no issue.
    """
    c = F.col
    names = ["confirmed", "not-reproduced", "environment-failure", "out-of-scope"]
    in_scope = F.count_if(~F.coalesce(c("final_label") == "out-of-scope", F.lit(False)))
    broken = F.count_if(F.size("issues") > 0)
    report = adjudicated.rollup("detector").agg(
        F.grouping("detector").alias("_all"), F.count(F.lit(1)).alias("samples"), in_scope.alias("denominator"), *[F.count_if(c("final_label") == x).alias(x.replace("-", "_")) for x in names],
        F.count_if("disagreement").alias("disagreements"), *[F.sum(x).cast("bigint").alias(x) for x in (*CONFIDENCES, "changed", "limited")], broken.alias("issues"),
        ((in_scope >= min_valid) & (broken == 0)).alias("valid"),
    )
    return report.withColumn("scope", F.when(c("_all") == 1, "study").otherwise("detector")).drop("_all")


def resolution_after_reviews(reviews: DataFrame, resolutions: DataFrame) -> DataFrame:
    """``sample_id, ok``: the resolution comes after the last review."""
    last = reviews.groupBy("sample_id").agg(F.max("reviewed_at").alias("_last"))
    return resolutions.join(last, "sample_id").select("sample_id", (F.col("resolved_at") > F.col("_last")).alias("ok"))


# --------------------------------------------------------------------------- answers
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalize_term(text: Column) -> Column:
    """NFKC, lower case, white space collapsed and trimmed.

    Spark has no Unicode normalisation; only texts outside ASCII go through the
    Arrow helper.
    """
    nfkc = F.pandas_udf(_nfkc, StringType())
    wide = F.when(text.rlike(r"[^\x00-\x7f]"), text)
    return F.trim(F.regexp_replace(F.lower(F.coalesce(nfkc(wide), text)), r"\s+", " "))


def plain_term(term: str) -> str:
    """The same for a rubric term, once, when the plan is built."""
    return " ".join(unicodedata.normalize("NFKC", term).lower().split())


def score_answers(answers: DataFrame, rubric: dict[str, list[list[str]]], forbidden: list[str]) -> DataFrame:
    """Per answer: groups hit, forbidden terms used, correct.

    ``answers`` has ``participant_id, question_id, answer``.  The rubric is part of the
    study's protocol: a handful of questions, held in the expression.
    """
    answers = answers.select("participant_id", "question_id", normalize_term(F.col("answer")).alias("_t"))

    def hit(terms: list[str]) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(F.col("_t"), F.lit(plain_term(t))) for t in terms])

    groups, needed = F.lit(0), F.lit(0)
    for question, parts in rubric.items():
        here = F.col("question_id") == question
        count = reduce(lambda a, b: a + b, [hit(p).cast("int") for p in parts])
        groups = F.when(here, count).otherwise(groups)
        needed = F.when(here, len(parts)).otherwise(needed)
    bad = reduce(lambda a, b: a + b, [F.contains(F.col("_t"), F.lit(plain_term(t))).cast("int") for t in forbidden], F.lit(0))
    return answers.select(
        "participant_id", "question_id", groups.alias("groups_hit"), bad.alias("forbidden_hits"),
        ((needed > 0) & (groups == needed) & (bad == 0)).alias("correct"),
    )


def score_participants(scored: DataFrame, required: int = 5) -> DataFrame:
    """Correct answers per participant; passed needs ``required`` and no forbidden term."""
    return scored.groupBy("participant_id").agg(
        F.count_if("correct").alias("correct_answers"), F.count(F.lit(1)).alias("answers"), F.sum("forbidden_hits").alias("forbidden_hits"),
        ((F.count_if("correct") >= required) & (F.sum("forbidden_hits") == 0)).alias("passed"),
    )


# --------------------------------------------------------------------------- gates, regressions, checklists
def gate_reconcile(rows: DataFrame, gates: DataFrame, work: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per row state, open gates, open work, and whether a release may go.

    ``rows``: ``state`` (shipped/partial/planned); ``gates``: ``state`` (open/closed); ``work``:
    one row per open correction or rollback.
    """
    r = rows.groupBy(*keys).agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("shipped", "partial", "planned")])
    g = gates.groupBy(*keys).agg(F.count_if(F.col("state") == "open").alias("open_gates"))
    w = work.groupBy(*keys).agg(F.count(F.lit(1)).alias("open_work"))
    j = r.join(g, keys, "left").join(w, keys, "left").fillna(0, ["open_gates", "open_work"])
    go = (F.col("open_gates") == 0) & (F.col("partial") == 0) & (F.col("planned") == 0) & (F.col("open_work") == 0)
    return j.withColumn("go_eligible", go)


def regression_compare(runs: DataFrame, threshold_percent: float) -> DataFrame:
    """Deltas of candidate against baseline per scenario, with regression flags.

    A zero baseline that grew has no percentage and counts as a regression.
    """
    base, cand = F.col("baseline_ms").cast("double"), F.col("candidate_ms").cast("double")
    delta = cand - base
    percent = F.when(base == 0, F.when(delta > 0, F.lit(None).cast("double")).otherwise(0.0)).otherwise(F.round(delta / base * 100, 3))
    return runs.select(
        "scenario", (F.col("candidate_findings") - F.col("baseline_findings")).alias("finding_delta"),
        (F.col("candidate_files") - F.col("baseline_files")).alias("files_delta"), delta.alias("duration_delta_ms"),
        percent.alias("duration_delta_percent"),
        F.when(base == 0, delta > 0).otherwise(percent > threshold_percent).alias("performance_regression"),
        (F.col("candidate_findings") > F.col("baseline_findings")).alias("finding_regression"),
        ((F.col("candidate_status") != "passed") | (F.col("candidate_coverage") != "complete")).alias("failed"),
    )


def regression_summary(deltas: DataFrame) -> DataFrame:
    flags = ["failed", "performance_regression", "finding_regression"]
    return deltas.agg(
        F.count(F.lit(1)).alias("runs"), *[F.count_if(f).alias(f"n_{f}") for f in flags], F.sum("finding_delta").alias("total_finding_delta"),
        F.sum("duration_delta_ms").alias("total_duration_delta_ms"),
        (reduce(lambda a, b: a + b, [F.count_if(f) for f in flags]) == 0).alias("go_eligible"),
    )


def scenario_matrix_gaps(fixtures: DataFrame, plans: list[str], roles: list[str], tenants: list[str], runs: DataFrame) -> DataFrame:
    """Expected fixture x plan x role x tenant combinations that were not run.

    The three dimensions are short literal lists, exploded inside each fixture row.
    """
    def lit_list(values: list[str]) -> Column:
        return F.explode(F.array(*[F.lit(v) for v in values]))

    expected = (
        fixtures.select("fixture").distinct().select("fixture", lit_list(plans).alias("plan"))
        .select("fixture", "plan", lit_list(roles).alias("role"))
        .select("fixture", "plan", "role", lit_list(tenants).alias("tenant"))
    )
    keys = ["fixture", "plan", "role", "tenant"]
    return expected.join(runs.select(*keys).distinct(), keys, "left_anti")


def holdout_leakage(observations: DataFrame, split: DataFrame, reviews: DataFrame, corrections: DataFrame, frozen_at: Column) -> DataFrame:
    """Rows ``(id, issue)`` where the holdout was touched.

    ``corrections`` has one row per ``correction_id, observation_id, created_at``.
    """
    sided = observations.join(split, "fixture", "left")
    rev = reviews.select("observation_id", "reviewed_at")
    high = sided.where(F.col("impact") == "high").join(rev, "observation_id", "left")
    issue = (
        F.when(F.col("reviewed_at").isNull(), "high-impact observation without review")
        .when((F.col("side") == "train") & (F.col("reviewed_at") > frozen_at), "training review after freeze")
        .when((F.col("side") == "holdout") & (F.col("reviewed_at") < frozen_at), "holdout review before freeze")
    )
    a = high.select(F.col("observation_id").cast("string").alias("id"), issue.alias("issue"))
    used = corrections.join(sided.select("observation_id", "side", F.lit(True).alias("_known")), "observation_id", "left")
    found = labels(
        (F.col("_known").isNull(), "correction references an unknown observation"),
        (F.col("side") == "holdout", "correction references a holdout observation"),
        (F.col("created_at") > frozen_at, "correction after freeze"),
    )
    b = used.select(F.col("correction_id").cast("string").alias("id"), F.explode(found).alias("issue"))
    return a.where(F.col("issue").isNotNull()).unionByName(b).distinct()


def missing_surfaces(stories: DataFrame, executed: DataFrame) -> DataFrame:
    """Required labels of stories that no run executed (``stories``: ``story_id, required``)."""
    need = stories.select("story_id", F.explode("required").alias("label")).distinct()
    return need.join(executed.select("label").distinct(), "label", "left_anti").select("story_id", "label")


def flatten_targets(manifests: DataFrame) -> DataFrame:
    """``package, field, target`` of every string under ``main``, ``types``, ``bin`` and ``exports``.

    Nested objects and lists are opened level by level until none is left; a text
    that only looks like one stays a target.  Manifests are as deep as their authors
    nest conditions, so a few rounds do.
    """
    fields = F.array(
        *[F.struct(F.lit(f).alias("field"), F.get_json_object("content", f"$.{f}").alias("v")) for f in ("main", "types", "bin", "exports")]
    )
    rows = manifests.select("package", F.inline(fields)).where(F.col("v").isNotNull())
    as_map = F.from_json("v", "map<string,string>")
    as_list = F.from_json("v", "array<string>")
    nested = (F.col("v").startswith("{") & as_map.isNotNull()) | (F.col("v").startswith("[") & as_list.isNotNull())
    while not rows.where(nested).isEmpty():

        def named(key: Column, value: Column) -> Column:
            return F.struct(key.alias("field"), value.alias("v"))

        opened = (
            F.when(~F.coalesce(nested, F.lit(False)), F.array(named(F.col("field"), F.col("v"))))
            .when(F.col("v").startswith("{"), F.transform(F.map_entries(as_map), lambda e: named(F.concat("field", F.lit("."), e["key"]), e["value"])))
            .otherwise(F.transform(as_list, lambda x, i: named(F.concat("field", F.lit("["), i.cast("string"), F.lit("]")), x)))
        )
        rows = rows.select("package", F.inline(opened)).where(F.col("v").isNotNull())
    return rows.select("package", "field", F.col("v").alias("target"))


def missing_entrypoints(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """``package, field, issue`` for manifest targets that are not relative, escape, or do not exist.

    Manifests are dealt out before they are parsed.  A target whose file is there leaves in an anti join, for
    which the files need not be made distinct; both sides are dealt out, for their narrow rows
    compress so well that partitions cut by size hold too many.
    """
    t = flatten_targets(dealt(manifests, "package"))
    path = F.substring("target", F.lit(3), F.length("target"))
    segments = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    shape = (
        F.when(~F.col("target").startswith("./"), "must be a package-relative path")
        .when((path == "") | path.startswith("/") | F.arrays_overlap(segments, F.array(F.lit(".."), F.lit("."))), "escapes the package root")
    )
    checked = t.select("package", "field", path.alias("path"), shape.alias("_shape"))
    known = dealt(files.select(F.col("package").alias("_package"), F.col("path").alias("_path")), "_package", "_path")
    there = (F.col("package") == F.col("_package")) & (F.col("path") == F.col("_path")) & F.col("_shape").isNull()
    issue = F.coalesce("_shape", F.concat(F.lit("missing file "), "path"))
    return dealt(checked, "package", "path").join(known, there, "left_anti").select("package", "field", issue.alias("issue"))


def checklist_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, checked, key`` of ``- [x] **KEY** text`` lines."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("_i", "line"))
    shape = r"^- \[([ xX])\] (.+)$"
    rest = F.regexp_extract("line", shape, 2)
    named = F.regexp_extract(rest, r"^\*\*([^*]+)\*\*", 1)
    plain = F.trim(F.regexp_replace(F.regexp_replace(rest, r"\s+Evidence:.*$", ""), r"[.]$", ""))
    return lines.where(F.col("line").rlike(shape)).select(
        "doc_id", (F.col("_i") + 1).alias("line_no"), (F.lower(F.regexp_extract("line", shape, 1)) == "x").alias("checked"),
        F.when(named != "", F.trim(named)).otherwise(plain).alias("key"),
    )


def checklist_audit(rows: DataFrame, classes: dict[str, str] | None = None) -> DataFrame:
    """Checked, open and percent (one decimal) per document; ``classes`` maps key prefixes to a class."""
    cls: Column = F.lit("unmapped")
    for prefix, name in (classes or {}).items():
        cls = F.when(F.col("key").startswith(prefix), F.lit(name)).otherwise(cls)
    done = F.count_if("checked")
    return rows.withColumn("_c", cls).groupBy("doc_id").agg(
        done.alias("checked"), F.count_if(~F.col("checked")).alias("open"), F.round(done / F.count(F.lit(1)) * 100, 1).alias("percent"),
        F.count_if(~F.col("checked") & (F.col("_c") == "unmapped")).alias("unmapped_open"),
    )


def evidence_kind_rollup(events: DataFrame, keys: list[str], kinds: list[str], repeat_kind: str, min_repeat: int = 2) -> DataFrame:
    """Counts per evidence kind and the list of what is missing.

    Digests are grouped first, so distinctness is a comparison of two sums rather
    than a distinct aggregate over a hot key.
    """
    per = events.groupBy(*keys, "digest").agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("kind") == k).alias(f"_k{i}") for i, k in enumerate(kinds)]
    )
    agg = per.groupBy(*keys).agg(
        F.sum("_n").alias("events"), F.count(F.lit(1)).alias("distinct_digests"),
        *[F.sum(f"_k{i}").alias(f"n_{k.replace('-', '_')}") for i, k in enumerate(kinds)],
    )
    names = [f"n_{k.replace('-', '_')}" for k in kinds]
    missing = labels(*[(F.col(n) == 0, f"missing {k}") for n, k in zip(names, kinds)])
    rest = labels(
        (F.col(f"n_{repeat_kind.replace('-', '_')}") < min_repeat, "too few repeat-use records"),
        (F.col("distinct_digests") != F.col("events"), "digests are not distinct"),
    )
    return agg.select(*keys, "events", "distinct_digests", *names, F.concat(missing, rest).alias("issues"))


def forbidden_paths(current: DataFrame, historical: DataFrame, patterns: list[str]) -> DataFrame:
    """Distinct current or historical paths on the deny list; filtered before the union is made distinct."""
    deny = "|".join(f"(?:{p})" for p in patterns)
    both = current.select("path").union(historical.select("path"))
    return both.where(F.col("path").rlike(deny)).distinct()


def workflow_acceptance(rows: DataFrame) -> DataFrame:
    """``workflow_id, accepted, reasons`` over consent, execution and deletion facts."""
    c = F.col
    reasons = labels(
        (c("outcome") != "passed", "workflow-outcome-failed"),
        (c("exit_code") != 0, "command-exit-nonzero"),
        ((c("coverage") != "complete") | (c("n_limitations") > 0), "coverage-incomplete-or-limited"),
        (~c("preflight_ok"), "preflight-not-passed"),
        (~c("summary_delivered"), "owner-summary-not-delivered"),
        (~F.coalesce(c("disposition").isin("deleted", "expired"), F.lit(False)), "deletion-or-expiry-not-recorded"),
        (c("deletion_status") != "confirmed", "deletion-or-expiry-not-confirmed"),
        (~c("may_store") & (c("retention") != "digest-only"), "retention-exceeds-consent"),
        (c("retention") == "raw", "raw-artifact-retention-forbidden"),
    )
    return rows.select("workflow_id", (F.size(reasons) == 0).alias("accepted"), reasons.alias("reasons"))
