"""Observations: validation, correlation, snapshots, differences, lineage, records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.functions.digest import (
    canonical_json, fingerprint_v1, native_uuid_from_digest, packed, sha256_tag, tree_digest, unpacked,
)
from assayline.functions.severity import SEVERITIES, native_confidence_level, severity_rank
from assayline.functions.text import safe_relative_path
from assayline.operators.spread import dealt, evaluate_once, sized, top_n
from assayline.sources.evidence import observation_rows


def labels(*checks: tuple[Column, str]) -> Column:
    """Sorted array of the labels whose condition holds."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in checks]))


# --------------------------------------------------------------------------- admission
def evidence_issues(classification: Column, handling: Column, content: Column) -> Column:
    """What forbids keeping an excerpt."""
    return labels(
        ((classification == "secret") & (handling != "omitted"), "secret evidence must be omitted"),
        ((handling == "omitted") & content.isNotNull(), "omitted evidence cannot contain content"),
        ((handling != "omitted") & content.isNull(), "included or redacted evidence requires content"),
        ((classification == "sensitive") & (handling == "included"), "sensitive evidence must be redacted or omitted"),
    )


_RULE_ID = r"^[A-Za-z0-9][A-Za-z0-9._:/-]*$"
_UUID_URN = r"^urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
_UNSAFE_TEXT = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


def _observation_checks() -> list[tuple[Column, str]]:
    c = F.col

    def outside(name: str, allowed: list[str]) -> tuple[Column, str]:
        return ~F.coalesce(c(name).isin(allowed), F.lit(False)), f"{name} is not allowed"

    def printable(name: str) -> tuple[Column, str]:
        ok = (F.length(c(name)) > 0) & ~c(name).rlike(_UNSAFE_TEXT)
        return ~F.coalesce(ok, F.lit(False)), f"{name} is missing or out of bounds"

    expected = F.when(c("origin_kind") == "native", "native").when(c("origin_kind") == "adapter", "external").otherwise(
        "imported"
    )
    return [
        (~F.coalesce(c("observation_id").rlike(_UUID_URN), F.lit(False)), "observation_id is malformed"),
        (~F.coalesce(F.length("subject_id") > 0, F.lit(False)), "subject_id is missing"),
        outside("origin_kind", ["native", "adapter", "imported"]),
        (~F.coalesce(c("rule").rlike(_RULE_ID), F.lit(False)), "rule is malformed"),
        ((c("origin_kind") != "native") & c("raw_digest").isNull(), "raw digest required"),
        (c("coverage_class") != expected, "coverage_class must match origin kind"),
        printable("category"), printable("title"),
        outside("severity", [*SEVERITIES, "unknown"]),
        outside("confidence_level", ["certain", "high", "medium", "low", "unknown"]),
        (F.coalesce(~c("confidence_score").between(0.0, 1.0), F.lit(False)), "confidence_score is out of range"),
        ((c("location_kind") == "source") & ~F.coalesce(safe_relative_path(c("path")), F.lit(False)), "path is unsafe"),
        ((c("location_kind") == "source") & ~F.coalesce(c("start_line") >= 1, F.lit(False)), "start_line is required"),
        ((c("location_kind") == "package") & c("package").isNull(), "package is required"),
    ]


def observation_issues() -> Column:
    """Issue labels of one observation row; empty when it is valid."""
    return labels(*_observation_checks())


def observation_is_valid() -> Column:
    """Whether a row has no issue, without making their list."""
    return reduce(lambda a, b: a & b, [~F.coalesce(bad, F.lit(False)) for bad, _ in _observation_checks()])


def validate_rows(observations: DataFrame) -> DataFrame:
    """Add ``issues``; split with :func:`valid_rows` and :func:`quarantined_rows`."""
    return observations.withColumn("issues", observation_issues())


def valid_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("issues") == 0).drop("issues")


def quarantined_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("issues") > 0)


def row_part() -> Column:
    """``valid`` or ``quarantined`` of a checked row; for both parts in one pass."""
    return F.when(F.size("issues") == 0, "valid").otherwise("quarantined")


# --------------------------------------------------------------------------- normalisation
def native_to_observation(findings: DataFrame, subject_id: Column, run_id: Column) -> DataFrame:
    """Findings as observations; an enum confidence carries no score and becomes unknown."""
    severity = F.lower("severity")
    known = F.when(severity.isin(SEVERITIES), severity).otherwise("unknown")
    level = F.when(F.col("confidence_score").isNull(), "unknown").otherwise(
        native_confidence_level(F.col("confidence_score"))
    )
    has_file = F.col("file").isNotNull()
    path = F.coalesce("file", F.lit("finding.json"))
    line = F.when(has_file, F.coalesce("line", F.lit(1)))
    rule = F.coalesce("rule", "detector")
    original = F.coalesce("original_severity", "severity")
    identity = canonical_json(
        subjectId=subject_id, runId=run_id, ruleId=rule, category=F.col("detector"), title=F.col("title"), path=path,
        startLine=line, severity=original, confidence=level, snippet=F.col("snippet"), label=F.col("label"),
    )
    return observation_rows(
        evaluate_once(findings, ["*"], _digest=F.sha2(identity, 256)),
        observation_id=native_uuid_from_digest(F.col("_digest")),
        subject_id=subject_id, origin_kind="native", producer_id="assayline.scanner", run_id=run_id, rule=rule,
        coverage_class="native", category=F.col("detector"), title=F.col("title"),
        location_kind=F.when(has_file, "source").otherwise("artifact"), path=path, start_line=line,
        package=F.col("package"), advisory=F.col("cve"), severity_original=original, severity=known,
        confidence_level=level, confidence_score=F.col("confidence_score"),
    )


def observation_fingerprint() -> Column:
    """Fingerprint from the observation's own location, package, advisory and rule."""
    location = (
        F.when(F.col("location_kind") == "source", F.concat_ws(":", "path", F.col("start_line").cast("string")))
        .when(F.col("location_kind") == "package", F.col("package"))
        .otherwise(F.concat(F.col("path"), F.lit(":")))
    )
    cls = (
        F.when(F.col("coverage_class") == "native", "native")
        .when(F.col("coverage_class") == "external", "adapter")
        .otherwise("imported")
    )
    package = F.when(F.col("location_kind") == "package", F.col("package"))
    return fingerprint_v1(F.col("subject_id"), cls, location, package, F.col("advisory"), F.col("rule"))


# --------------------------------------------------------------------------- correlation
def correlate(observations: DataFrame, payload: Column, keys: list[str] | None = None) -> DataFrame:
    """Groups by fingerprint: producers, number of payloads, and whether payloads disagree.

    Disagreement is ``min(digest) <> max(digest)`` of the canonical payload, which
    combines on the map side; no payload is collected.  The producer set is small
    by nature (the tools that ran).  Fingerprints and digests are shuffled as bytes.
    """
    keys = keys or []
    rows = observations.select(*keys, packed(F.col("fingerprint")).alias("_f"), "producer_id", F.unhex(F.sha2(payload, 256)).alias("_p"))
    groups = rows.groupBy(*keys, "_f").agg(*correlation_aggregates(F.col("_p")))
    return groups.select(*keys, unpacked(F.col("_f")).alias("fingerprint"), *groups.columns[len(keys) + 1:])


def correlation_aggregates(payload_digest: Column) -> list[Column]:
    """What :func:`correlate` says of a group."""
    return [
        F.array_sort(F.collect_set("producer_id")).alias("producer_ids"),
        F.count(F.lit(1)).alias("n_payloads"),
        (F.min(payload_digest) != F.max(payload_digest)).alias("disagreement"),
    ]


def risk_aggregates() -> list[Column]:
    """What :func:`with_risk` needs of a group; invalid rows count, and teach no severity."""
    sev = F.when(F.col("is_valid"), F.col("severity"))
    text = F.when(F.col("is_valid"), F.col("remediation"))
    return [
        F.count_if(~F.col("is_valid")).alias("n_invalid"), F.min(sev).alias("_lo"), F.max(sev).alias("_hi"),
        F.count_distinct(text).alias("n_remediations"),
    ]


def with_risk(groups: DataFrame) -> DataFrame:
    """``severity_status`` known / mixed / unavailable and ``severity_value``; a group with invalid evidence is unavailable."""
    whole = F.col("n_invalid") == 0
    known = whole & (F.col("_lo") == F.col("_hi")) & (F.col("_lo") != "unknown")
    status = F.when(known, "known").when(whole & (F.col("_lo") != F.col("_hi")), "mixed").otherwise("unavailable")
    return groups.withColumns({"severity_status": status, "severity_value": F.when(known, F.col("_lo"))}).drop("_lo", "_hi")


def risk_projection(observations: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Severity known / mixed / unavailable, and counts of payloads, invalid ones and remediation texts, per fingerprint.

    ``observations`` has ``fingerprint, severity, remediation, is_valid``.  Any number of
    payloads is assessed; the texts are the rows of :func:`remediation_texts`.
    """
    keys = [*(keys or []), "fingerprint"]
    groups = observations.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_payloads"), *risk_aggregates())
    return with_risk(groups).select(*keys, "severity_status", "severity_value", "n_payloads", "n_invalid", "n_remediations")


def remediation_texts(observations: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per fingerprint and distinct remediation text of valid rows."""
    return observations.where(F.col("is_valid") & F.col("remediation").isNotNull()).select(*(keys or []), "fingerprint", "remediation").distinct()


def evidence_with_runs(observations: DataFrame, tool_runs: DataFrame) -> DataFrame:
    """Run time, engine state and limitations per observation.

    ``tool_runs`` has ``run_id, started_at, completed_at, coverage, reasons,
    producer_state``; a run shared by most observations is a hot join key that AQE
    splits, or broadcasts when the run table is small.
    """
    joined = observations.join(tool_runs, "run_id", "left")
    seen = F.col("coverage").isNotNull()
    limits = F.concat(
        labels(
            (~seen, "tool-run-metadata-unavailable"),
            (F.col("coverage") != "complete", "tool-run-incomplete"),
            (F.col("producer_state") != "complete", "producer-coverage-incomplete"),
        ),
        F.coalesce("reasons", F.array().cast("array<string>")),
    )
    return joined.select(
        *observations.columns,
        F.when(seen, "available").otherwise("unavailable").alias("timestamp_status"),
        "started_at", "completed_at",
        F.array_sort(F.array_distinct(limits)).alias("limitations"),
    )


def fuzzy_duplicates(observations: DataFrame) -> DataFrame:
    """Distinct ``(left, right)`` producer pairs that saw one subject and rule at different locations.

    ``observations`` has ``subject_id, rule, location, producer_id, pos``; left is the
    earlier row.  No pair of rows is formed.  A pair (p, q) exists iff some row of p
    comes before some row of q at another location; for that it is enough to know
    each producer's two earliest and two latest positions over different locations.
    Those come from two aggregates, after which a group has one row per producer.
    NULL locations compare as a value of their own.
    """
    place = F.coalesce(F.concat(F.lit("="), F.col("location")), F.lit(""))
    # One column as the key, so that a constant part of it does not part the aggregates from their join.
    group = F.struct("subject_id", F.coalesce("rule", F.lit("")).alias("rule"), "producer_id").alias("_k")
    rows = observations.where(F.col("subject_id").isNotNull() & F.col("producer_id").isNotNull()).select(group, place.alias("_l"), "pos")
    ends = rows.groupBy("_k", "_l").agg(F.min("pos").alias("_first"), F.max("pos").alias("_last"))
    # After rows of one location are one, one exchange serves both aggregates and their join.
    ends = dealt(ends, "_k")
    best = ends.groupBy("_k").agg(
        F.min(F.struct("_first", "_l")).alias("e1"), F.max(F.struct("_last", "_l")).alias("f1")
    )
    keyed = ends.join(best, "_k")
    second = keyed.groupBy("_k").agg(
        F.first("e1").alias("e1"),
        F.first("f1").alias("f1"),
        F.min(F.when(F.col("_l") != F.col("e1._l"), F.col("_first"))).alias("e2"),
        F.max(F.when(F.col("_l") != F.col("f1._l"), F.col("_last"))).alias("f2"),
    )
    second = sized(second.select("_k.*", "e1", "f1", "e2", "f2"))  # both sides of the join read it
    a = second.select("subject_id", "rule", F.col("producer_id").alias("left"), "e1", "e2")
    b = second.select("subject_id", "rule", F.col("producer_id").alias("right"), "f1", "f2")
    same = F.col("e1._l") == F.col("f1._l")
    found = F.when(
        same,
        F.coalesce(F.col("e2") < F.col("f1._last"), F.lit(False)) | F.coalesce(F.col("e1._first") < F.col("f2"), F.lit(False)),
    ).otherwise(F.col("e1._first") < F.col("f1._last"))
    # e2/f2 at two further locations can only matter when the best ones share a location
    return dealt(a, "subject_id", "rule").join(dealt(b, "subject_id", "rule"), ["subject_id", "rule"]).where(found).select("left", "right").distinct()


# --------------------------------------------------------------------------- coverage, snapshots
def coverage_rollup(producers: DataFrame, keys: list[str]) -> DataFrame:
    """complete iff every producer and the target are complete without limitation.

    ``producers`` has ``state, n_limitations``; the target is one of the rows.
    """
    ok = (F.col("state") == "complete") & (F.col("n_limitations") == 0)
    return producers.groupBy(*keys).agg(
        F.when(F.bool_and(ok), "complete").otherwise("incomplete").alias("status"),
        F.count(F.lit(1)).alias("producers"),
        F.count_if(~ok).alias("incomplete_producers"),
    )


def snapshot_digest(groups: DataFrame, keys: list[str]) -> DataFrame:
    """``snapshot_digest`` per key over its observation groups, order independent."""
    member = canonical_json(**{c: F.col(c) for c in groups.columns if c not in keys})
    return tree_digest(groups, keys, member, "snapshot_digest")


def create_snapshot(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Snapshot header per key: digest, observation count, disagreements; the counts go up the digest's tree, so groups are read once."""
    member = canonical_json(**{c: F.col(c) for c in groups.columns if c not in keys})
    counts = {"n_observations": F.lit(1).cast("bigint"), "n_disagreements": F.coalesce(F.col("disagreement"), F.lit(False)).cast("bigint")}
    return tree_digest(groups, keys, member, "snapshot_digest", sums=counts)


def file_tree_digest(files: DataFrame) -> DataFrame:
    """One digest per repository over (path, content digest)."""
    member = F.concat_ws("\x1f", "path", F.sha2("content", 256))
    return tree_digest(files, ["repo_id"], member, "tree_digest")


# --------------------------------------------------------------------------- differences
def _sided(base: DataFrame, head: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct rows of both sides with ``in_base`` / ``in_head``: one shuffle for both differences."""
    left = base.select(*cols, F.lit(1).alias("_b"), F.lit(0).alias("_h"))
    right = head.select(*cols, F.lit(0).alias("_b"), F.lit(1).alias("_h"))
    return left.unionByName(right).groupBy(*cols).agg(
        (F.max("_b") == 1).alias("in_base"), (F.max("_h") == 1).alias("in_head")
    )


def diff_snapshots(base: DataFrame, head: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``fingerprint, change`` for every fingerprint of two snapshots, with both severities.

    Changes: added, fixed, unchanged, worsened, improved, severity-unassessed.  The
    two sides meet in one aggregate on the fingerprint instead of a join.
    """
    on = [*(keys or []), "fingerprint"]

    def side(df: DataFrame, tag: str) -> DataFrame:
        s = F.struct(F.col("severity_status").alias("status"), F.col("severity_value").alias("value"))
        other = "head" if tag == "base" else "base"
        return df.select(*on, s.alias(tag), F.lit(None).cast(s_type).alias(other))

    s_type = "struct<status:string,value:string>"
    both = side(base, "base").unionByName(side(head, "head")).groupBy(*on).agg(
        F.max("base").alias("base"), F.max("head").alias("head")
    )
    known = (
        (F.col("base.status") == "known") & (F.col("head.status") == "known")
        & F.col("base.value").isNotNull() & F.col("head.value").isNotNull()
    )
    before, after = severity_rank(F.col("base.value")), severity_rank(F.col("head.value"))
    change = (
        F.when(F.col("base").isNull(), "added")
        .when(F.col("head").isNull(), "fixed")
        .when(~F.coalesce(known, F.lit(False)), "severity-unassessed")
        .when(after > before, "worsened")
        .when(after < before, "improved")
        .otherwise("unchanged")
    )
    return both.select(
        *on, change.alias("change"), F.col("base.status").alias("base_status"), F.col("base.value").alias("before"),
        F.col("head.status").alias("head_status"), F.col("head.value").alias("after"),
    )


def fingerprint_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """``fingerprint, side``: base-only, head-only, both."""
    sided = _sided(base, head, ["fingerprint"])
    side = F.when(F.col("in_base") & F.col("in_head"), "both").when(F.col("in_base"), "base-only").otherwise("head-only")
    return sided.select("fingerprint", side.alias("side"))


def lineage_delta(base: DataFrame, head: DataFrame) -> DataFrame:
    """Edges on one side only: ``removed`` or ``added``."""
    cols = ["from_subject_id", "to_subject_id", "relation", "status", "evidence_ref"]
    return _sided(base, head, cols).where(F.col("in_base") != F.col("in_head")).select(
        *cols, F.when(F.col("in_head"), "added").otherwise("removed").alias("side")
    )


def gap_delta(base: DataFrame, head: DataFrame) -> DataFrame:
    """Hashes of gap texts on one side only."""
    def hashed(df: DataFrame) -> DataFrame:
        return df.select(sha256_tag(F.col("gap")).alias("gap_digest"))

    return _sided(hashed(base), hashed(head), ["gap_digest"]).where(F.col("in_base") != F.col("in_head")).select(
        "gap_digest", F.when(F.col("in_head"), "added").otherwise("removed").alias("side")
    )


def coverage_delta(base: DataFrame, head: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Producer state and observation count before and after, with ``changed``."""
    on = [*(keys or []), "producer"]
    cols = ["state", "observation_count"]
    b = base.select(*on, *[F.col(c).alias(f"before_{c}") for c in cols])
    h = head.select(*on, *[F.col(c).alias(f"after_{c}") for c in cols])
    same = reduce(lambda x, y: x & y, [F.col(f"before_{c}").eqNullSafe(F.col(f"after_{c}")) for c in cols])
    return b.join(h, on, "full_outer").withColumn("changed", ~same)


def comparison_blockers(pairs: DataFrame, diff: DataFrame, edges: DataFrame, gaps: DataFrame, keys: list[str]) -> DataFrame:
    """Rows ``(keys, code, count)`` that forbid reading a diff as a risk change.

    ``pairs`` has ``base_subject, head_subject, base_coverage, head_coverage`` per key;
    ``edges`` and ``gaps`` hold both sides' lineage.
    """
    unassessed = diff.groupBy(*keys).agg(F.count_if(F.col("change") == "severity-unassessed").alias("_u"))
    loose_edges = edges.where(F.col("status") != "matched").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_e"))
    loose_gaps = gaps.distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_g"))
    joined = (
        pairs.join(unassessed, keys, "left").join(loose_edges, keys, "left").join(loose_gaps, keys, "left")
        .fillna(0, ["_u", "_e", "_g"])
    )
    lineage = F.col("_e") + F.col("_g")

    def row(cond: Column, code: str, count: Column) -> Column:
        return F.when(cond, F.struct(F.lit(code).alias("code"), count.cast("bigint").alias("count")))

    none = F.lit(None).cast("bigint")
    missing = F.col("base_coverage").isNull() | F.col("head_coverage").isNull()
    rows = F.array(
        row(~F.col("base_subject").eqNullSafe(F.col("head_subject")), "identity-changed", none),
        row(missing, "coverage-unavailable", none),
        row((F.col("base_coverage") == "incomplete") | (F.col("head_coverage") == "incomplete"), "coverage-incomplete", none),
        row(F.col("_u") > 0, "severity-unassessed", F.col("_u")),
        row(lineage > 0, "lineage-unresolved", lineage),
    )
    return joined.select(*keys, F.inline(F.array_compact(rows)))


def change_actions(diff: DataFrame, always_rescan: Column | None = None) -> DataFrame:
    """One action row per changed fingerprint: assessment, rescan need, remediation side."""
    changed = diff.where(F.col("change").isin("added", "fixed", "worsened", "improved"))
    mixed = (F.col("base_status") == "mixed") | (F.col("head_status") == "mixed")
    known = (F.col("base_status") == "known") & (F.col("head_status") == "known")
    rescan = F.col("change").isin("added", "worsened") | (F.lit(False) if always_rescan is None else always_rescan)
    return changed.select(
        *[c for c in diff.columns if c not in ("base_status", "head_status")],
        F.when(F.coalesce(mixed, F.lit(False)), "mixed").when(F.coalesce(known, F.lit(False)), "known")
        .otherwise("unavailable").alias("assessment"),
        F.when(rescan, "required").otherwise("unknown").alias("rescan"),
        F.when(F.col("change") == "fixed", "base").otherwise("head").alias("remediation_from"),
    )


def compare_baseline(fingerprints: DataFrame, baselines: DataFrame, at: Column) -> DataFrame:
    """``subject_id, fingerprint, baseline_status, verdict`` (new or accepted).

    ``fingerprints`` has ``subject_id, policy_digest, fingerprint``; ``baselines`` has
    ``subject_id, baseline_subject_id, policy_digest, expires_at`` and exploded
    ``accepted`` rows.  Of a subject's baselines the one that lasts longest counts, facts and
    accepted fingerprints alike; a subject without any is ``unavailable`` and all new.
    The chosen facts, one row per subject, are written down first: where they are small, fingerprints
    move once, to where the accepted ones are.
    """
    fact = F.struct(
        F.col("expires_at").isNull().alias("never"), F.col("expires_at").alias("be"), F.col("policy_digest").alias("bp"),
        F.col("baseline_subject_id").alias("bs"),
    )
    rows = baselines.select("subject_id", fact.alias("_fact"), F.col("accepted").alias("fingerprint"))
    facts = sized(rows.groupBy("subject_id").agg(F.max("_fact").alias("_chosen")))
    accepted = (
        rows.join(facts, "subject_id").where(F.col("_fact").eqNullSafe(F.col("_chosen")))
        .select("subject_id", "fingerprint", F.lit(True).alias("_ok")).distinct()
    )
    # One exchange serves the distinct rows and the join.
    current = fingerprints.select("subject_id", "policy_digest", "fingerprint").repartition("subject_id", "fingerprint").distinct()
    joined = current.join(accepted, ["subject_id", "fingerprint"], "left").join(facts, "subject_id", "left")
    joined = joined.select("*", *[F.col(f"_chosen.{c}").alias(f"_{c}") for c in ("bs", "bp", "be")])
    status = (
        F.when(F.col("_chosen").isNull(), "unavailable")
        .when((F.col("_bs") != F.col("subject_id")) | (F.col("_bp") != F.col("policy_digest")), "mismatched")
        .when(at >= F.col("_be"), "stale")
        .otherwise("matched")
    )
    return joined.select(
        "subject_id", "fingerprint", status.alias("baseline_status"),
        F.when(F.col("_ok"), "accepted").otherwise("new").alias("verdict"),
    )


# --------------------------------------------------------------------------- lineage
def resolve_lineage(subjects: DataFrame, declarations: DataFrame) -> DataFrame:
    """Distinct edges: matched when both endpoints are known, else unavailable."""
    known = subjects.select("subject_id").distinct()
    joined = (
        declarations.join(known.select(F.col("subject_id").alias("from_subject_id"), F.lit(True).alias("_f")), "from_subject_id", "left")
        .join(known.select(F.col("subject_id").alias("to_subject_id"), F.lit(True).alias("_t")), "to_subject_id", "left")
    )
    both = F.col("_f").isNotNull() & F.col("_t").isNotNull()
    return joined.select(
        "from_subject_id", "to_subject_id", "relation",
        F.coalesce("status", F.when(both, "matched").otherwise("unavailable")).alias("status"),
        "evidence_ref", both.alias("endpoints_known"),
    ).distinct()


def lineage_gaps(edges: DataFrame) -> DataFrame:
    """Distinct gap texts of resolved edges."""
    arrow = F.concat(F.col("from_subject_id"), F.lit(" -> "), F.col("to_subject_id"))
    texts = F.array_compact(
        F.array(
            F.when(~F.col("endpoints_known"), F.concat(F.lit("lineage endpoint is unavailable for "), arrow)),
            F.when(F.col("status") == "mismatched", F.concat(F.lit("lineage declaration mismatches "), arrow)),
            F.when(F.col("status") == "unverifiable", F.concat(F.lit("lineage declaration is unverifiable for "), arrow)),
        )
    )
    return edges.select(F.explode(texts).alias("gap")).distinct()


def match_provenance_digest(subjects: DataFrame, expected: DataFrame) -> DataFrame:
    """``doc_id, state``: matched / mismatched / unavailable against the expected digest."""
    value = F.lower(F.regexp_replace("value", "^sha256:", ""))
    want = expected.select("doc_id", F.lower(F.regexp_replace("expected", "^sha256:", "")).alias("_e"))
    have = subjects.where((F.col("algorithm") == "sha256") & value.rlike("^[0-9a-f]{64}$")).select("doc_id", value.alias("_v"))
    return want.join(have, "doc_id", "left").groupBy("doc_id").agg(
        F.when(F.count("_v") == 0, "unavailable").when(F.bool_or(F.col("_v") == F.col("_e")), "matched")
        .otherwise("mismatched").alias("state")
    )


def subject_digest(kind: Column, digest: Column, tree: Column, worktree: Column, document: Column) -> Column:
    """The digest that identifies a subject of each kind."""
    return (
        F.when(kind == "repository-tree", worktree)
        .when(kind == "filesystem", tree)
        .when(kind == "sbom", document)
        .when(kind.isin("package", "artifact", "oci-manifest", "oci-index"), digest)
    )


def bind_evidence(documents: DataFrame, subjects: DataFrame) -> DataFrame:
    """``doc_id, bound, limitation``: whether imported evidence names the selected subject.

    ``documents`` has ``doc_id, subject_id, format, digest`` (the document's digest for
    bills of material, a named subject digest for provenance; several rows allowed).
    """
    s = subjects.select("subject_id", "kind", subject_digest(*[F.col(c) for c in (
        "kind", "digest", "tree_digest", "worktree_digest", "document_digest")]).alias("_d"))
    joined = documents.join(s, "subject_id", "left")
    hit = F.when(F.col("format") == "in-toto", F.col("digest") == F.col("_d")).otherwise(
        (F.col("kind") == "sbom") & (F.col("digest") == F.col("_d"))
    )
    agg = joined.groupBy("doc_id", "format").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("bound"))
    prov = F.col("format") == "in-toto"
    return agg.select(
        "doc_id", "bound",
        F.when(prov & F.col("bound"), "digest matches the target; signature and builder remain unverified")
        .when(prov, "provenance does not prove the selected target identity")
        .when(F.col("bound"), "document matches the subject; its contents are not policy observations")
        .otherwise("document digest does not match the selected subject").alias("limitation"),
    )


def source_artifact_linkage(declared: DataFrame) -> DataFrame:
    """Status of declared source-to-artifact links, first reason wins."""
    c = F.col
    status = (
        F.when(c("declaration_id").isNull(), "unavailable")
        .when(~F.coalesce(c("verifiable"), F.lit(False)), "unverifiable")
        .when(
            ~c("declared_source").eqNullSafe(c("source_id")) | ~c("declared_artifact").eqNullSafe(c("artifact_id")), "mismatched"
        )
        .otherwise("matched")
    )
    return declared.select("source_id", "artifact_id", status.alias("status"))


# --------------------------------------------------------------------------- records
def record_integrity(members: DataFrame, payloads: DataFrame) -> DataFrame:
    """``record_id, path, error`` for members whose payload is missing, changed or ill-declared.

    ``members``: ``record_id, path, digest, size, required, redaction``; ``payloads``:
    ``record_id, digest, payload``.  Payload bytes are hashed where they are read;
    only digests, as bytes, and sizes are shuffled.  A member without a record or a digest is left out.
    """
    key = packed(F.col("digest"))
    facts = evaluate_once(
        payloads, ["record_id"], _d=key, _same=sha256_tag(F.col("payload")) == F.col("digest"), _size=F.octet_length("payload").cast("bigint")
    )
    named = evaluate_once(members, ["record_id", "path", "size", "required", "redaction"], _d=key).where(F.col("record_id").isNotNull() & F.col("_d").isNotNull())
    repeats = named.groupBy("record_id", "_d").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    joined = named.join(facts, ["record_id", "_d"], "left").join(repeats, ["record_id", "_d"], "left")
    omitted = F.col("redaction") == "omitted"
    error = (
        F.when(F.col("_n") > 1, "member digest is duplicated")
        .when(omitted & F.col("required"), "required member cannot be omitted")
        .when(omitted, F.lit(None).cast("string"))
        .when(F.col("_same").isNull(), "payload is missing")
        .when(F.col("_size") != F.col("size"), "size mismatch")
        .when(~F.col("_same"), "digest mismatch")
    )
    return joined.select("record_id", "path", error.alias("error")).where(F.col("error").isNotNull())


def redaction_coverage(members: DataFrame, entries: DataFrame) -> DataFrame:
    """(digest, disposition) on one side only; empty when the redaction list is exact."""
    cols = ["record_id", "digest", "disposition"]
    left = members.where(F.col("kind") != "redaction-manifest").select(
        "record_id", "digest", F.col("redaction").alias("disposition")
    )
    return _sided(left, entries, cols).where(F.col("in_base") != F.col("in_head")).select(
        *cols, F.when(F.col("in_base"), "undeclared").otherwise("unexpected").alias("side")
    )
