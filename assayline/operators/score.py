"""Counts, security score, leaderboards, verdicts and orderings over findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.functions.severity import (
    DOMAIN_CAP, SEVERITIES, SEVERITY_RANK, SEVERITY_WEIGHT, confidence_level, lookup, severity_rank,
)
from assayline.operators.spread import top_n

# Score limits.
NO_CRITICAL_PENALTY_CAP = 90.0
BANDS = [(50, "critical"), (70, "high"), (90, "medium")]


def scoreable(strict: bool = False) -> Column:
    """Findings that can count: not a placeholder, and outside strict mode neither test nor tagged."""
    ok = ~F.coalesce(F.col("context").isin("placeholder", "enum"), F.lit(False))
    if not strict:
        ok = ok & ~F.coalesce(F.col("context") == "test", F.lit(False)) & F.col("context_tag").isNull()
    return ok


def _counts(scoring: Column) -> list[Column]:
    out = [F.count_if(scoring & (F.col("severity") == s)).alias(s) for s in SEVERITIES[:-1]]
    return [*out, F.count_if(F.col("severity") == "info").alias("info")]


def count_by_severity(findings: DataFrame, keys: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Five zero-filled counts; ``info`` counts every finding, the others only scoreable ones."""
    return findings.groupBy(*(keys or ["repo_id"])).agg(*_counts(scoreable(strict)))


def _effective_level() -> Column:
    return F.coalesce(
        F.when(F.col("confidence_score").isNotNull(), confidence_level(F.col("confidence_score"))),
        F.col("confidence_level"),
    )


def score_value(penalty: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(100 - penalty + 0.5))).cast("int")


def risk_band(score: Column) -> Column:
    out = None
    for limit, label in BANDS:
        out = F.when(score < limit, label) if out is None else out.when(score < limit, label)
    assert out is not None
    return out.otherwise("low")


def security_score(findings: DataFrame, repos: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Score 0..100 and band per repository.

    Penalties are capped per (repository, domain, severity).  Everything is a sum
    that combines on the map side; after the first aggregate a repository has at
    most ``domains x 5`` rows, so neither exchange carries findings.
    """
    weight = lookup(F.col("severity"), SEVERITY_WEIGHT)
    cap = lookup(F.col("severity"), DOMAIN_CAP)
    counting = scoreable(strict) & _effective_level().isin("certain", "high")
    per_cell = findings.groupBy(
        "repo_id", F.coalesce("domain", F.lit("__unknown__")).alias("domain"), "severity"
    ).agg(
        F.count_if(counting).alias("_hits"),
        F.count_if(scoreable(strict)).alias("_seen"),
        F.count(F.lit(1)).alias("_all"),
    )
    per_repo = per_cell.groupBy("repo_id").agg(
        F.sum(F.coalesce(F.least(F.col("_hits") * weight, cap), F.lit(0.0))).alias("_raw"),
        *[
            F.sum(F.when(F.col("severity") == s, F.col("_all" if s == "info" else "_seen")).otherwise(0)).alias(s)
            for s in SEVERITIES
        ],
        F.sum("_all").alias("n_findings"),
    )
    if repos is not None:
        per_repo = repos.select("repo_id").join(per_repo, "repo_id", "left").fillna(
            0, ["_raw", *SEVERITIES, "n_findings"]
        )
    penalty = F.when(F.col("critical") == 0, F.least("_raw", F.lit(NO_CRITICAL_PENALTY_CAP))).otherwise(F.col("_raw"))
    score = score_value(penalty)
    return per_repo.select(
        "repo_id", score.alias("score"), risk_band(score).alias("band"), *SEVERITIES, "n_findings"
    )


def findings_by_domain(findings: DataFrame) -> DataFrame:
    """Domain by severity counts."""
    return findings.groupBy(F.coalesce("domain", F.lit("__unknown__")).alias("domain")).agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    )


def campaign_summary(scores: DataFrame) -> DataFrame:
    """One row over all repositories: mean, median, bands, share with a critical or high."""
    def share(col: Column) -> Column:
        return F.round(100.0 * F.count_if(col) / F.count(F.lit(1)), 1)

    return scores.agg(
        F.count(F.lit(1)).alias("repos"),
        F.round(F.avg("score"), 6).alias("mean_score"),
        F.percentile("score", 0.5).alias("median_score"),
        *[F.count_if(F.col("band") == b).alias(f"band_{b}") for b in ("low", "medium", "high", "critical")],
        share(F.col("critical") > 0).alias("pct_with_critical"),
        share((F.col("critical") > 0) | (F.col("high") > 0)).alias("pct_with_critical_or_high"),
        *[F.sum(s).alias(f"total_{s}") for s in SEVERITIES],
    )


def rule_leaderboard(findings: DataFrame) -> DataFrame:
    """Hits and distinct repositories per (severity, rule).

    Distinct repositories are counted from (severity, rule, repository) groups, so a
    rule that owns most findings is reduced on the map side before it meets itself.
    """
    per_repo = findings.groupBy("severity", "rule", "repo_id").agg(F.count(F.lit(1)).alias("_n"))
    return per_repo.groupBy("severity", "rule").agg(
        F.sum("_n").alias("hits"), F.count(F.lit(1)).alias("repos")
    )


def category_leaderboard(findings: DataFrame) -> DataFrame:
    per_repo = findings.groupBy("category", "repo_id").agg(F.count(F.lit(1)).alias("_n"))
    return per_repo.groupBy("category").agg(F.sum("_n").alias("findings"), F.count(F.lit(1)).alias("repos"))


# --------------------------------------------------------------------------- orderings
def context_rank() -> Column:
    return F.when(F.col("context") == "test", 2).when(F.col("severity") == "info", 1).otherwise(0)


def report_key() -> Column:
    """``file:line:title`` compared as one string, as reports do (line 10 before line 9)."""
    return F.concat(
        F.coalesce("file", F.lit("")), F.lit(":"), F.coalesce("line", F.lit(0)).cast("string"), F.lit(":"), "title"
    )


def report_order() -> list[Column]:
    return [context_rank().asc(), severity_rank(F.col("severity")).desc(), report_key().asc()]


def sort_findings(findings: DataFrame) -> DataFrame:
    """Report order (byte order of the key); a range-partitioned global sort."""
    return findings.orderBy(*report_order())


def agent_order() -> list[Column]:
    return [
        severity_rank(F.col("severity")).desc(), F.col("rule").asc(), F.col("file").asc(), F.col("line").asc(),
    ]


def agent_findings(findings: DataFrame, limit: int = 0) -> DataFrame:
    """Most severe first; ``limit`` 0 returns everything (sorted), else TakeOrdered."""
    ordered = findings.orderBy(*agent_order(), F.col("finding_id").asc())
    return ordered.limit(limit) if limit else ordered


def agent_summary(findings: DataFrame, limit: int = 20) -> DataFrame:
    """Per repository: total, how many a capped listing shows, whether it was cut, a headline."""
    total = F.count(F.lit(1))
    critical, high = (F.count_if(F.col("severity") == s) for s in ("critical", "high"))
    return findings.groupBy("repo_id").agg(
        total.alias("findings"),
        F.least(total, F.lit(limit)).alias("shown"),
        (total > limit).alias("truncated"),
        F.concat(
            total.cast("string"), F.lit(" findings: "), critical.cast("string"), F.lit(" critical, "),
            high.cast("string"), F.lit(" high"),
        ).alias("headline"),
    )


def top_findings(findings: DataFrame, n: int = 3, strict: bool = False) -> DataFrame:
    """The ``n`` first scoreable findings per repository, without one task per repository."""
    return top_n(
        findings.where(scoreable(strict)), ["repo_id"], [*report_order(), F.col("finding_id").asc()], n,
        spread=F.col("finding_id"),
    )


def worst_repos(scores: DataFrame, k: int, by: str = "score") -> DataFrame:
    """The ``k`` worst repositories by score (ascending) or by a count (descending)."""
    first = F.col("score").asc() if by == "score" else F.col(by).desc()
    return scores.orderBy(first, F.col("repo_id").asc()).limit(k)


# --------------------------------------------------------------------------- verdicts
def should_block(findings: DataFrame) -> DataFrame:
    """Findings that stop a commit."""
    return findings.where(
        F.col("severity").isin("critical", "high")
        & _effective_level().isin("certain", "high")
        & ~F.coalesce(F.col("context").isin("test", "placeholder", "enum"), F.lit(False))
    )


def snippet_verdict(findings: DataFrame, keys: list[str]) -> DataFrame:
    """block / warn / allow per document from certain or high findings."""
    sure = _effective_level().isin("certain", "high")
    return findings.groupBy(*keys).agg(
        F.when(F.bool_or(sure & (F.col("severity") == "critical")), "block")
        .when(F.bool_or(sure & (F.col("severity") == "high")), "warn")
        .otherwise("allow")
        .alias("verdict")
    )


def ci_gate(scores: DataFrame, threshold: int | None = None) -> DataFrame:
    """Exit code per repository: any critical fails, then a score under the threshold."""
    low = F.lit(False) if threshold is None else F.col("score") < threshold
    return scores.select(
        "repo_id", "score", "critical", F.when(F.col("critical") > 0, 1).when(low, 1).otherwise(0).alias("exit_code")
    )


def first_match(labels: list[tuple[Column, str]]) -> Column:
    """Label of the first predicate that holds; later predicates are not evaluated."""
    return reduce(lambda acc, it: acc.when(it[0], it[1]), labels[1:], F.when(labels[0][0], labels[0][1]))


__all__ = ["SEVERITY_RANK", "first_match", "security_score"]
