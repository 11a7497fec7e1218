"""Inspection: producers' documents to observations, groups, snapshots and differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.functions.digest import canonical_json
from assayline.operators import evidence
from assayline.plans.extension import Normalizer
from assayline.sources import evidence as docs


class SarifNormalizer:
    id = "sarif.import"

    def normalize(self, documents: DataFrame) -> DataFrame:
        return docs.import_sarif(documents)


class TrivyNormalizer:
    id = "trivy"

    def normalize(self, documents: DataFrame) -> DataFrame:
        return docs.import_trivy(documents)


def observe(documents: DataFrame, producers: dict[str, Normalizer]) -> DataFrame:
    """Observations of all producers; ``documents.producer`` selects the normaliser."""
    parts = [n.normalize(documents.where(F.col("producer") == name)) for name, n in producers.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def group(observations: DataFrame) -> DataFrame:
    """Observations, fingerprinted and correlated: one row per subject and fingerprint, in one aggregate.

    Invalid observations stay in their group: they count as payloads and in ``n_invalid``,
    and make its severity unavailable.
    """
    checked = observations.withColumn("is_valid", evidence.observation_is_valid())
    payload = canonical_json(**{c: F.col(c) for c in ("rule", "severity", "confidence_level", "title", "package", "advisory")})
    named = checked.select(
        "subject_id", "producer_id", "severity", "remediation", "is_valid",
        evidence.observation_fingerprint().alias("fingerprint"), F.sha2(payload, 256).alias("_p"),
    )
    groups = named.groupBy("subject_id", "fingerprint").agg(*evidence.correlation_aggregates(F.col("_p")), *evidence.risk_aggregates())
    return evidence.with_risk(groups)


def snapshot(groups: DataFrame) -> DataFrame:
    """Header and digest per subject."""
    return evidence.create_snapshot(groups, ["subject_id"])


def diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """Changes between two group tables of the same subjects."""
    return evidence.diff_snapshots(base, head, ["subject_id"])
