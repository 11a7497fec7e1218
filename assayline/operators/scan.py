"""The rule scan: files in, findings out, without a shuffle.

Every file row is scanned where it lies.  The file's lines are an array; one
higher-order expression walks it and yields hits, with neighbouring lines read
by ``slice`` only once the line itself has matched.  ``inline`` turns the hits into
rows.  The only exchange is the optional join of hits with per-repository facts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline import schemas
from assayline.functions.regex import matches
from assayline.functions.text import mask_history_snippet
from assayline.operators import rules as R
from assayline.operators.rules import GATES, Line, Rule, select_rules, trimmed_snippet

_FINDING_FIELDS = [f.name for f in schemas.FINDINGS.fields]


def finding_rows(df: DataFrame, **given: Column | str | None) -> DataFrame:
    """Fill the findings schema; ids are content hashes, so a rerun gives the same rows."""
    cols: dict[str, Column] = {}
    for f in schemas.FINDINGS.fields:
        value = given.get(f.name)
        if value is None:
            cols[f.name] = F.lit(None).cast(f.dataType)
        elif isinstance(value, Column):
            cols[f.name] = value.cast(f.dataType)
        else:
            cols[f.name] = F.lit(value).cast(f.dataType)
    if given.get("finding_id") is None:
        parts = ["repo_id", "rule", "file", "line", "package", "cve", "label"]
        cols["finding_id"] = F.sha2(
            F.concat_ws("|", *[F.coalesce(cols[p].cast("string"), F.lit("")) for p in parts]), 256
        )
    return df.select(*[cols[name].alias(name) for name in _FINDING_FIELDS])


def explode_lines(files: DataFrame) -> DataFrame:
    """``source_lines`` with 1-based numbers; empty lines stay."""
    return files.select(
        "repo_id", "path", F.posexplode(F.split("content", "\n", -1)).alias("_i", "line")
    ).select("repo_id", "path", (F.col("_i") + 1).alias("line_no"), "line")


def skip_metadata_lines(lines: DataFrame) -> DataFrame:
    """Drop lines that describe a rule (``bad: "..."``) instead of using the construct."""
    return lines.where(~matches(F.col("line"), R.METADATA_LINE))


def file_gate(files: DataFrame, detector: str) -> DataFrame:
    """Files a detector looks at; belongs before any use of ``content``."""
    return files.where(GATES[detector](F.col("path")))


def _mask(bits: list[Column]) -> Column:
    """Booleans packed into one BIGINT column.

    One column referenced many times is computed once per file; single boolean
    columns would be folded into the per-line expression by the optimizer.
    """
    parts = [F.when(b, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, b in enumerate(bits)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def _bit(mask: Column, i: int) -> Column:
    return mask.bitwiseAND(F.lit(1 << i).cast("bigint")) != 0


_COMPILED: dict[tuple[str, tuple[str, ...]], Column] = {}


def _hits(spark: SparkSession, rule_ids: tuple[str, ...]) -> Column:
    """All hits of a file as one array expression over ``_lines``, ``_low`` and ``_mask``.

    A rule's pattern is tried on a line only if the rule's bit is set for the file
    and the lower-cased line holds one of its literals; both are plain byte searches.

    Building it takes thousands of small calls into the JVM and depends on the rule
    selection only, so it is kept per application.
    """
    key = (spark.sparkContext.applicationId, rule_ids)
    if key in _COMPILED:
        return _COMPILED[key]
    chosen = [R.BY_ID[r] for r in rule_ids]
    mask, n = F.col("_mask"), len(chosen)

    def _hit(rule: Rule, i: int, ln: Line) -> Column:
        snippet = trimmed_snippet(ln.text)
        if rule.mask is not None:
            snippet = rule.mask(snippet)
        value = F.struct(
            F.lit(i).alias("k"),
            (ln.index + 1).alias("line"),
            snippet.alias("snippet"),
            (rule.severity(ln) if callable(rule.severity) else F.lit(rule.severity)).alias("severity"),
            (rule.confidence(ln) if callable(rule.confidence) else F.lit(rule.confidence)).alias("confidence"),
            (rule.label(ln) if rule.label else F.lit(None).cast("string")).alias("label"),
        )
        possible = _bit(mask, i)
        if rule.needles:
            low = F.get(F.col("_low"), ln.index)
            possible = possible & reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in rule.needles])
        return F.when(possible & rule.when(ln), value)

    def hits_of(line: Column, index: Column) -> Column:
        facts = {"rate_limited": _bit(mask, n), "timing_safe": _bit(mask, n + 1)}
        ln = Line(line, index, F.col("_lines"), facts)
        kept = F.filter(F.array(*[_hit(rule, i, ln) for i, rule in enumerate(chosen)]), lambda h: h.isNotNull())
        return F.when(~matches(line, R.METADATA_LINE), kept)

    per_line = F.filter(F.transform("_lines", hits_of), lambda hs: hs.isNotNull() & (F.size(hs) > 0))
    _COMPILED[key] = F.flatten(per_line)
    return _COMPILED[key]


def scan_files(
    files: DataFrame,
    detectors: list[str] | None = None,
    rules: list[str] | None = None,
    repo_facts: DataFrame | None = None,
) -> DataFrame:
    """Line rules over ``source_files``; ``repo_facts`` holds ``repo_id, has_auth``, one row per repository.

    Rules that depend on a fact are scanned as candidates, and their hits, not the
    files, meet the facts.  A repository without facts has no authentication.
    """
    chosen = select_rules(detectors, rules)

    text = F.col("_lc")

    def wanted(rule: Rule) -> Column:
        gate = GATES[rule.detector](F.col("path"))
        if not rule.needles:
            return gate
        return gate & reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in rule.needles])

    # Two extra bits hold whole-file facts that some rules need.
    content = F.col("content")
    rate_limited = F.lit(False)
    timing_safe = F.lit(False)
    if any(r.rule == "API-001" for r in chosen):
        rate_limited = matches(content, R.RATE_LIMIT)
    if any(r.rule == "AUTH-003" for r in chosen):
        timing_safe = matches(content, R.TIMING_SAFE)
    prepared = (
        files.select("repo_id", "path", "content", F.lower("content").alias("_lc"))
        .select(
            "repo_id",
            "path",
            _mask([wanted(r) for r in chosen] + [rate_limited, timing_safe]).alias("_mask"),
            F.split("content", "\n", -1).alias("_lines"),
            F.split("_lc", "\n", -1).alias("_low"),
        )
    )
    mask, n = F.col("_mask"), len(chosen)
    rule_bits = F.lit((1 << n) - 1).cast("bigint")

    hits = prepared.select(
        "repo_id",
        "path",
        F.inline(F.when(mask.bitwiseAND(rule_bits) != 0, _hits(files.sparkSession, tuple(r.rule for r in chosen)))),
    )

    needed = {i: r.auth for i, r in enumerate(chosen) if r.auth is not None}
    if repo_facts is None:
        hits = hits.where(~F.col("k").isin([i for i, auth in needed.items() if auth]))
    elif needed:
        depends = F.col("k").isin(*needed)
        facts = repo_facts.select(F.col("repo_id").alias("_repo"), F.coalesce("has_auth", F.lit(False)).alias("_auth"))
        hits = hits.join(facts, depends & (F.col("repo_id") == F.col("_repo")), "left")
        wants_auth = F.col("k").isin(*[i for i, auth in needed.items() if auth])
        hits = hits.where(~depends | (F.coalesce("_auth", F.lit(False)) == wants_auth))

    def by_rule(attribute: str) -> Column:
        return F.element_at(F.array(*[F.lit(getattr(r, attribute)) for r in chosen]), F.col("k") + 1)

    return finding_rows(
        hits,
        repo_id=F.col("repo_id"),
        detector=by_rule("detector"),
        rule=by_rule("rule"),
        domain=by_rule("domain"),
        category=by_rule("category"),
        title=by_rule("title"),
        severity=F.col("severity"),
        file=F.col("path"),
        line=F.col("line"),
        snippet=F.col("snippet"),
        confidence_level=F.col("confidence"),
        label=F.col("label"),
    )


def missing_headers(files: DataFrame) -> DataFrame:
    """Framework configuration files that never name one of five response headers (D5-004)."""
    configs = files.where(F.col("path").rlike(r"next\.config\.(js|ts|mjs)$"))
    headers = F.array(*[F.lit(h) for h in R.SECURITY_HEADERS])
    gaps = F.filter(headers, lambda h: ~F.contains(F.col("content"), h))
    return finding_rows(
        configs.withColumn("_gaps", gaps).where(F.size("_gaps") > 0),
        repo_id=F.col("repo_id"), detector="misconfig", rule="D5-004", domain="D5", severity="medium",
        title="Missing security headers in framework config", file=F.col("path"), confidence_level="high",
        category="Security Misconfiguration", label=F.array_join("_gaps", ", "),
    )


def express_without_helmet(files: DataFrame) -> DataFrame:
    """Files that create an Express app and never call helmet() (API-005)."""
    c = F.col("content")
    hit = file_gate(files, "api-hardening").where(
        F.contains(c, F.lit("express"))
        & matches(c, R.EXPRESS_IMPORT)
        & matches(c, R.EXPRESS_APP)
        & ~matches(c, R.HELMET)
    )
    return finding_rows(
        hit, repo_id=F.col("repo_id"), detector="api-hardening", rule="API-005", domain="D7", severity="medium",
        title="Express app initialised without helmet()", file=F.col("path"), confidence_level="high",
        category="API Hardening",
    )


# Environment files that must be ignored by version control.
ENV_FILES = [".env", ".env.local", ".env.production"]


def env_file_exposed(files: DataFrame) -> DataFrame:
    """Environment file at the root while the ignore file does not mention ``.env`` (D5-001).

    The ignore file is one row per repository, so its fact travels as an
    aggregate over the same (repo) grouping: one shuffle, no second scan join.
    """
    root = files.where(F.col("path").isin(*ENV_FILES, ".gitignore"))
    facts = root.groupBy("repo_id").agg(
        F.coalesce(
            F.bool_or((F.col("path") == ".gitignore") & F.contains("content", F.lit(".env"))), F.lit(False)
        ).alias("ignored"),
        *[F.bool_or(F.col("path") == name).alias(name.replace(".", "_")) for name in ENV_FILES],
    )
    present = F.filter(
        F.array(*[F.when(F.col(n.replace(".", "_")), F.lit(n)) for n in ENV_FILES]), lambda x: x.isNotNull()
    )
    rows = facts.where(~F.col("ignored")).select("repo_id", F.explode(present).alias("path"))
    return finding_rows(
        rows, repo_id=F.col("repo_id"), detector="misconfig", rule="D5-001", domain="D5", severity="critical",
        title=F.concat("path", F.lit(" may be committed to version control")), file=F.col("path"),
        confidence_level="high", category="Security Misconfiguration",
    )


def _added_lines(diffs: DataFrame, key: str) -> DataFrame:
    """``key`` and ``_added``: the added lines of a diff with number and current file.

    A diff is cut at its ``+++ b/`` headers and each header's section is walked once,
    so the file is carried forward inside the row: no window, no shuffle, and work
    linear in the diff.
    """
    heads = F.filter(
        F.transform(
            "_lines",
            lambda x, i: F.when(
                x.startswith("+++ b/"),
                F.struct(i.alias("at"), F.substring(x, F.lit(7), F.length(x)).alias("file")),
            ),
        ),
        lambda h: h.isNotNull(),
    )
    before_any = F.array(F.struct(F.lit(-1).alias("at"), F.lit("").alias("file")))
    base = diffs.select(key, F.split("diff", "\n", -1).alias("_lines"))
    base = base.withColumn("_heads", F.concat(before_any, heads))
    total = F.size("_lines")

    def section(h: Column, k: Column) -> Column:
        stop = F.coalesce(F.get("_heads", k + 1)["at"], total)
        return F.struct(
            h["file"].alias("file"),
            h["at"].alias("at"),
            F.slice("_lines", h["at"] + 2, stop - h["at"] - 1).alias("body"),
        )

    def added(s: Column) -> Column:
        rows = F.transform(
            s["body"],
            lambda x, j: F.when(
                x.startswith("+") & ~x.startswith("+++"),
                F.struct(s["file"].alias("file"), (s["at"] + j + 2).alias("line_no"), x.alias("raw")),
            ),
        )
        return F.filter(rows, lambda r: r.isNotNull())

    return base.select(key, F.flatten(F.transform(F.transform("_heads", section), added)).alias("_added"))


def diff_added_lines(diffs: DataFrame, key: str = "repo_id") -> DataFrame:
    """``(file, line_no, line)`` of added lines, file carried forward within the diff."""
    rows = _added_lines(diffs, key).select(key, F.inline("_added"))
    return rows.select(key, "file", "line_no", F.substring("raw", F.lit(2), F.length("raw")).alias("line"))


def history_secrets(diffs: DataFrame) -> DataFrame:
    """Key shapes in added diff lines (D8-002) over ``repo_id, diff``."""

    def labelled(r: Column) -> Column:
        labels = F.filter(
            F.array(*[F.when(matches(r["raw"], p), F.lit(name)) for name, p in R.HISTORY_SECRETS]),
            lambda s: s.isNotNull(),
        )
        return F.transform(
            labels,
            lambda s: F.struct(
                r["line_no"].alias("line"), s.alias("label"), mask_history_snippet(r["raw"]).alias("snippet"),
                F.when(r["file"] == "", "git-history").otherwise(r["file"]).alias("file"),
            ),
        )

    hits = _added_lines(diffs, "repo_id").select("repo_id", F.inline(F.flatten(F.transform("_added", labelled))))
    return finding_rows(
        hits, repo_id=F.col("repo_id"), detector="git-history", rule="D8-002", domain="D8", severity="critical",
        title=F.concat(F.lit("Secret in version history: "), F.col("label")), file=F.col("file"),
        line=F.col("line"), snippet=F.col("snippet"), confidence_level="certain", category="Cryptography",
        label=F.col("label"),
    )


def line_context(files: DataFrame, first: int, last: int) -> DataFrame:
    """``source_lines`` plus ``ctx``, the lines ``first..last`` around each, joined by newlines.

    For all lines of a table; rules use :meth:`Line.window`, which costs only on hits.
    The lines are grouped per file already, so no window function and no shuffle.
    """
    base = files.select("repo_id", "path", F.split("content", "\n", -1).alias("_lines"))
    rows = F.transform(
        "_lines",
        lambda x, i: F.struct(
            (i + 1).alias("line_no"), x.alias("line"), Line(x, i, F.col("_lines"), {}).window(first, last).alias("ctx")
        ),
    )
    return base.select("repo_id", "path", F.inline(rows))


def union_findings(parts: list[DataFrame]) -> DataFrame:
    """All findings of several detectors."""
    return reduce(lambda a, b: a.unionByName(b), parts)
