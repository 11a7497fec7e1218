"""Severity and confidence scales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scales and weights that results depend on.
SEVERITIES = ["critical", "high", "medium", "low", "info"]
SEVERITY_RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
SEVERITY_WEIGHT = {"critical": 15.0, "high": 6.0, "medium": 2.0, "low": 0.5}
DOMAIN_CAP = {"critical": 40.0, "high": 25.0, "medium": 15.0, "low": 5.0}
SEVERITY_SYNONYMS = {
    "critical": "critical",
    "severe": "critical",
    "high": "high",
    "medium": "medium",
    "moderate": "medium",
    "low": "low",
    "info": "info",
    "informational": "info",
}
CONFIDENCE_NUMBER = {"certain": 0.95, "high": 0.8, "medium": 0.6, "low": 0.3}
DEFAULT_MIN_CONFIDENCE = 0.7


def lookup(col: Column, table: dict, default: object = None) -> Column:
    """CASE over a small fixed table (stays inside generated code, unlike a map literal)."""
    out = None
    for key, value in table.items():
        out = F.when(col == key, F.lit(value)) if out is None else out.when(col == key, F.lit(value))
    assert out is not None
    return out.otherwise(F.lit(default)) if default is not None else out


def severity_rank(col: Column) -> Column:
    return lookup(col, SEVERITY_RANK)


def confidence_level(score: Column) -> Column:
    return (
        F.when(score >= 0.9, "certain").when(score >= 0.7, "high").when(score >= 0.5, "medium").otherwise("low")
    )


def confidence_number(level: Column) -> Column:
    return lookup(level, CONFIDENCE_NUMBER)


def resolved_confidence(level: Column, score: Column) -> Column:
    """A finding carries either a level or a number; the number wins when present."""
    return F.coalesce(score, confidence_number(level))


def native_confidence_level(score: Column) -> Column:
    """Bands used when a native finding becomes an observation (medium starts at .4)."""
    return (
        F.when(score >= 0.9, "certain")
        .when(score >= 0.7, "high")
        .when(score >= 0.4, "medium")
        .when(score > 0, "low")
        .otherwise("unknown")
    )


def normalize_severity(value: Column) -> Column:
    """``struct(original, normalized, uncertain)``; unknown words stay visible."""
    from assayline.functions.regex import js_trim

    known = lookup(F.lower(js_trim(value)), SEVERITY_SYNONYMS, "unknown")
    return F.struct(
        value.alias("original"), known.alias("normalized"), (known == "unknown").alias("uncertain")
    )


def advisory_severity(label: Column) -> Column:
    """Advisory database label to severity; anything unlabelled counts as high."""
    upper = F.upper(label)
    return (
        F.when(upper == "CRITICAL", "critical")
        .when(upper == "HIGH", "high")
        .when(upper.isin("MODERATE", "MEDIUM"), "medium")
        .when(upper == "LOW", "low")
        .otherwise("high")
    )
