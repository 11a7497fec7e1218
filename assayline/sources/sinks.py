"""Writers: JSON reports, SARIF, bills of material, release statements.

A report is a table of JSON texts; writing it is ``df.write.text`` or ``json``.  Where
a format wants one document per subject, the subject is cut into documents of
bounded size, so a subject with a third of all findings neither lands in one task
nor loses rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.functions.digest import canonical_json, canonical_json_present
from assayline.operators.spread import chunked, dealt, evaluate_once
from assayline.sources.evidence import canonical_document, well_formed

REPORT_VERSION = "2.0.0"


def json_report(findings: DataFrame, version: str = REPORT_VERSION) -> DataFrame:
    """One JSON object per finding with ``verified`` defaulted to null and a version stamp."""
    verified = F.col("verified") if "verified" in findings.columns else F.lit(None).cast("boolean")
    body = {c: F.col(c) for c in findings.columns if c != "verified"}
    return findings.select("repo_id", canonical_json(verified=verified, report_version=F.lit(version), **body).alias("value"))


def write_json_report(findings: DataFrame, path: str, version: str = REPORT_VERSION) -> None:
    """Report files partitioned by repository; many tasks may write one repository."""
    json_report(findings, version).write.mode("overwrite").partitionBy("repo_id").text(path)


def sarif_result(rule: Column, level: Column, message: Column, uri: Column, line: Column, subject: Column) -> Column:
    region = F.when(line > 0, F.struct(line.alias("startLine")))
    place = F.when(
        uri.isNotNull(),
        F.array(F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), region.alias("region"))
                         .alias("physicalLocation"))),
    )
    return canonical_json_present(
        ruleId=rule,
        level=F.coalesce(level, F.lit("warning")),
        message=F.struct(message.alias("text")),
        locations=place,
        properties=F.struct(subject.alias("assayline.subjectId")),
    )


def export_sarif(findings: DataFrame, per_document: int = 10_000, tool_version: str = "1.0.0") -> DataFrame:
    """``subject_id, chunk, document``: SARIF logs of at most about ``per_document`` results.

    ``findings`` has ``subject_id, rule, level, message, uri, line``.
    """
    rows = findings.select(
        "subject_id",
        sarif_result(*[F.col(c) for c in ("rule", "level", "message", "uri", "line", "subject_id")]).alias("r"),
    )
    parts = chunked(rows, "subject_id", F.col("r"), per_document)
    head = '{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"results":['
    tail = '],"tool":{"driver":{"name":"assayline","version":"' + tool_version + '"}}}],"version":"2.1.0"}'
    # Results compress so well that partitions cut by size would hold too many of them.
    return dealt(parts, "subject_id", "chunk").groupBy("subject_id", "chunk").agg(
        F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list("r")), ","), F.lit(tail)).alias("document")
    )


def export_bom(docs: DataFrame) -> DataFrame:
    """Canonical JSON of well-formed CycloneDX, VEX and SPDX documents (``doc_id, format, document``)."""
    fmt = F.when(F.get_json_object("raw", "$.bomFormat") == "CycloneDX", "cyclonedx").when(
        F.get_json_object("raw", "$.spdxVersion").isNotNull(), "spdx"
    )
    good = well_formed(evaluate_once(docs, ["doc_id", "raw"], format=fmt), ("doc_id", "format", "raw"))
    return good.select("doc_id", "format", canonical_document(F.col("raw")).alias("document"))


def release_statement(manifests: DataFrame, subjects: DataFrame, per_statement: int = 4096) -> DataFrame:
    """In-toto statements binding a manifest digest to its sorted distinct subjects.

    ``subjects`` has ``manifest_digest, subject_id`` (ids end in their digest).  A
    statement holds at most about 4096 subjects, which is also what readers accept;
    larger manifests get several statements with the same manifest digest.
    """
    distinct = subjects.select("manifest_digest", "subject_id").distinct().join(
        manifests.select("manifest_digest").distinct(), "manifest_digest", "left_semi"
    )
    parts = chunked(distinct, "manifest_digest", F.col("subject_id"), per_statement)
    digest = F.regexp_extract("subject_id", r":sha256:([a-f0-9]{64})$", 1)
    entry = F.struct(F.struct(digest.alias("sha256")).alias("digest"), F.col("subject_id").alias("name"))
    grouped = parts.groupBy("manifest_digest", "chunk").agg(
        F.array_sort(F.collect_list(F.struct(F.col("subject_id").alias("k"), entry.alias("v")))).alias("s")
    )
    return grouped.select(
        "manifest_digest", "chunk",
        canonical_json(
            _type=F.lit("https://in-toto.io/Statement/v1"),
            predicateType=F.lit("https://assayline.example/release/v1"),
            subject=F.transform("s", lambda x: x["v"]),
            predicate=F.struct(
                F.col("manifest_digest").alias("manifestDigest"), F.transform("s", lambda x: x["k"]).alias("subjectIds")
            ),
        ).alias("statement"),
    )
