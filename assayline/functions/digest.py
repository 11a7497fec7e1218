"""Canonical JSON, content identities and digests of row sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(**fields: Column) -> Column:
    """JSON object with keys in code-unit order, no white space, nulls kept."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def canonical_json_present(**fields: Column) -> Column:
    """As :func:`canonical_json`, but absent (NULL) members are left out."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "true"})


def sha256_tag(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def fingerprint_v1(
    subject_id: Column,
    evidence_class: Column,
    location: Column | None = None,
    package: Column | None = None,
    advisory: Column | None = None,
    rule: Column | None = None,
) -> Column:
    """Identity of one observation across producers and runs."""
    null = F.lit(None).cast("string")

    def or_null(col: Column | None) -> Column:
        return null if col is None else col.cast("string")

    return sha256_tag(
        canonical_json(
            version=F.lit("v1"),
            subjectId=subject_id.cast("string"),
            location=or_null(location),
            package=or_null(package),
            advisory=or_null(advisory),
            rule=or_null(rule),
            evidenceClass=evidence_class,
        )
    )


def packed(tag: Column) -> Column:
    """A text in fewer bytes, different for different texts: 33 for ``sha256:`` and 64 digits.  Digits do not compress; as a key of an exchange they cost twice."""
    digest = F.unhex(F.substring(tag, 8, 64))
    exact = F.coalesce(F.concat(F.lit("sha256:"), F.lower(F.hex(digest))) == tag, F.lit(False))
    return F.when(exact, F.concat(F.lit(b"\x01"), digest)).otherwise(F.concat(F.lit(b"\x00"), tag.cast("binary")))


def unpacked(key: Column) -> Column:
    """The text of a :func:`packed` key."""
    rest = F.substring(key, F.lit(2), F.length(key))
    return F.when(F.substring(key, 1, 1) == F.lit(b"\x01"), F.concat(F.lit("sha256:"), F.lower(F.hex(rest)))).otherwise(rest.cast("string"))


# The members that make up each kind's identity.
SUBJECT_IDENTITY = {
    "repository-tree": ["kind", "vcs", "commit", "tree", "dirty", "worktreeDigest"],
    "package": ["kind", "ecosystem", "name", "version", "digest"],
    "filesystem": ["kind", "treeDigest", "ignorePolicyDigest"],
    "sbom": ["kind", "format", "documentDigest"],
    "artifact": ["kind", "digest"],
    "oci-manifest": ["kind", "digest", "platform"],
    "oci-index": ["kind", "digest"],
}


def subject_id(fields: dict[str, Column], namespace: str = "urn:assayline:subject") -> Column:
    """Content id of a subject; ``fields`` maps member names to columns and must hold ``kind``.

    Members that do not belong to the row's kind never reach the digest, and
    absent members are dropped, so adding unrelated metadata keeps the id.
    """
    kind = fields["kind"]
    body = None
    for name, members in SUBJECT_IDENTITY.items():
        present = {m: fields[m] for m in members if m in fields}
        text = canonical_json_present(**present)
        body = F.when(kind == name, text) if body is None else body.when(kind == name, text)
    assert body is not None
    return F.when(
        body.isNotNull(), F.concat(F.lit(namespace + ":"), kind, F.lit(":sha256:"), F.sha2(body, 256))
    )


def uuid_from_text(text: Column) -> Column:
    """``urn:uuid:`` id from the first 16 digest bytes with version 4 / variant 1 nibbles."""
    hexed = F.sha2(text, 256)
    # variant nibble: keep the low two bits of the 17th hex digit, set the high ones to 10
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(hexed, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(
        F.lit("urn:uuid:"),
        F.substring(hexed, 1, 8), F.lit("-"),
        F.substring(hexed, 9, 4), F.lit("-4"),
        F.substring(hexed, 14, 3), F.lit("-"),
        variant, F.substring(hexed, 18, 3), F.lit("-"),
        F.substring(hexed, 21, 12),
    )


def native_uuid_from_digest(hexed: Column) -> Column:
    """``urn:uuid:`` id of a native observation: nibbles replaced by 4 and 8."""
    return F.concat(
        F.lit("urn:uuid:"),
        F.substring(hexed, 1, 8), F.lit("-"),
        F.substring(hexed, 9, 4), F.lit("-4"),
        F.substring(hexed, 14, 3), F.lit("-8"),
        F.substring(hexed, 18, 3), F.lit("-"),
        F.substring(hexed, 21, 12),
    )


def project_fingerprint(first_sha: Column, remote: Column, name: Column, version: Column) -> Column:
    """``struct(fingerprint, source)``: git identity, else package identity, else none."""
    steps = [
        (r"(?i)^\s*git@", ""),
        (r"(?i)^\s*https?://", ""),
        (r"(?i)^\s*ssh://git@", ""),
        (r":", "/"),
        (r"/{2,}", "/"),
        (r"(?i)\.git/?$", ""),
        (r"/$", ""),
    ]
    clean = reduce(
        lambda col, step: F.regexp_replace(col, step[0], step[1]),
        steps,
        F.regexp_replace(remote, r"^\s+|\s+$", ""),
    )
    has_git = (F.length(first_sha) > 0) & (F.length(remote) > 0)
    has_package = (F.length(name) > 0) & (F.length(version) > 0)
    git = F.sha2(F.concat(first_sha, F.lit("|"), F.lower(clean)), 256)
    package = F.sha2(F.concat(name, F.lit("|"), version), 256)
    return F.struct(
        F.when(has_git, git).when(has_package, package).alias("fingerprint"),
        F.when(has_git, "git").when(has_package, "package").otherwise("ephemeral").alias("source"),
    )


def tree_digest(
    rows: DataFrame,
    keys: list[str],
    member: Column,
    out: str = "digest",
    levels: tuple[int, ...] = (6, 3),
    sums: dict[str, Column] | None = None,
) -> DataFrame:
    """One digest per key over a *set* of member strings, by a fixed hash tree.

    Members are hashed, de-duplicated, and hashed upwards through buckets named by
    the first ``levels`` hex digits, so no task ever holds a whole group: a leaf
    holds about ``n / 16**levels[0]`` hashes and every inner node at most 4096
    children.  One key holding a third of a huge table therefore still spreads
    over all tasks.  The result depends on the members and on ``levels`` only.
    ``sums`` are added up over all rows on the same way, repeated members too.
    """
    carried = [*(sums or {})]
    up = [F.sum(c).alias(c) for c in carried]
    hashed = rows.select(*keys, F.sha2(member, 256).alias("_h"), *[col.alias(c) for c, col in (sums or {}).items()])
    # One exchange by the shortest prefix serves the members and every level: longer prefixes lie inside it.
    hashed = hashed.withColumn("_t", F.substring("_h", 1, min(levels))).repartition(*keys, "_t")
    nodes = hashed.groupBy(*keys, "_t", "_h").agg(*up) if carried else hashed.distinct()
    for width in levels:
        nodes = (
            nodes.groupBy(*keys, "_t", F.substring("_h", 1, width).alias("_b"))
            .agg(F.array_sort(F.collect_list("_h")).alias("_hs"), *up)
            .select(
                *keys, "_t",
                # the bucket name is kept in front so that the next level can cut it shorter
                F.concat("_b", F.sha2(F.array_join("_hs", ""), 256)).alias("_h"),
                *carried,
            )
        )
    return (
        nodes.groupBy(*keys)
        .agg(F.array_sort(F.collect_list("_h")).alias("_hs"), *up)
        .select(*keys, sha256_tag(F.array_join("_hs", "")).alias(out), *carried)
    )
