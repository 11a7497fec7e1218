"""Supply chain: advisories, registry facts, look-alike names, licences, agent servers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.functions.regex import matches
from assayline.functions.severity import advisory_severity
from assayline.functions.text import basename, is_vendored_path, license_class, parse_vendored_name
from assayline.operators.rules import CREDENTIAL_SHAPES
from assayline.operators.scan import finding_rows

_SUPPLY = "Dependency & Supply Chain"

# Popular names that look-alikes imitate, in order of preference.
POPULAR_PACKAGES = [
    "react", "react-dom", "next", "vue", "@angular/core", "svelte", "solid-js",
    "express", "fastify", "koa", "hapi", "nestjs", "hono", "@nestjs/core",
    "lodash", "underscore", "ramda", "immer",
    "axios", "node-fetch", "got", "superagent", "ky",
    "moment", "dayjs", "date-fns", "luxon",
    "typescript", "eslint", "prettier", "babel", "@babel/core",
    "vite", "webpack", "rollup", "esbuild", "parcel", "turbo",
    "vitest", "jest", "mocha", "chai", "playwright", "@playwright/test", "cypress",
    "chalk", "kleur", "picocolors", "ansi-colors",
    "commander", "yargs", "meow", "cac", "inquirer", "prompts", "ora",
    "chokidar", "gaze", "fs-extra", "glob", "fast-glob", "globby", "picomatch",
    "dotenv", "cross-env", "yaml", "toml", "ini",
    "zod", "yup", "joi", "ajv", "valibot", "superstruct",
    "prisma", "@prisma/client", "drizzle-orm", "sequelize", "typeorm", "mongoose", "mikro-orm", "kysely",
    "pg", "mysql2", "sqlite3", "better-sqlite3", "postgres", "@neondatabase/serverless",
    "redis", "ioredis",
    "socket.io", "ws", "engine.io",
    "graphql", "apollo-server", "@apollo/client", "urql", "@tanstack/react-query", "swr",
    "next-auth", "@auth/core", "@clerk/nextjs", "@clerk/clerk-react", "passport", "jsonwebtoken", "jose",
    "bcrypt", "bcryptjs", "argon2",
    "stripe", "@stripe/stripe-js",
    "@aws-sdk/client-s3", "@aws-sdk/client-dynamodb", "@aws-sdk/client-sts",
    "@sentry/nextjs", "@sentry/node", "posthog-node", "@vercel/analytics",
    "resend", "nodemailer", "@react-email/components",
    "cheerio", "puppeteer", "playwright-core", "jsdom",
    "sharp", "jimp",
    "openai", "@anthropic-ai/sdk", "@google/generative-ai", "ai",
    "esbuild-register", "tsx", "ts-node", "tsup", "swc",
    "@types/node", "@types/react", "@types/react-dom", "@types/express",
    "react-router", "react-router-dom", "@tanstack/react-router",
    "tailwindcss", "postcss", "autoprefixer",
    "@radix-ui/react-slot", "@radix-ui/react-dialog", "@shadcn/ui", "lucide-react",
    "framer-motion", "react-spring",
    "clsx", "classnames", "tailwind-merge",
    "uuid", "nanoid", "shortid",
    "crypto-js", "node-forge",
    "fast-json-stringify", "safe-json-stringify",
    "pino", "winston", "bunyan", "consola",
    "husky", "lint-staged", "@commitlint/cli",
    "changesets", "semantic-release", "release-it",
]
LOOKALIKE_DISTANCE = 2
REGISTRY_TTL_HOURS = 24


def vulnerable_dependencies(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """D6-001: distinct name@version per repository against the advisory table.

    The join key is (name, version).  A version used by a third of all
    repositories makes one hot key; AQE splits it, and the advisory side, being
    one row per advisory, is what gets broadcast when it is small enough.
    """
    pairs = dependencies.select("repo_id", "name", "version").distinct()
    hits = pairs.join(
        advisories.select("name", "version", "vuln_id", "raw_severity", "aliases"), ["name", "version"]
    )
    return finding_rows(
        hits, repo_id=F.col("repo_id"), detector="dependencies", rule="D6-001", domain="D6",
        severity=advisory_severity(F.col("raw_severity")),
        title=F.concat(F.lit("Vulnerable dependency: "), "name", F.lit("@"), "version"),
        file="package-lock.json", package=F.col("name"), cve=F.col("vuln_id"),
        refs=F.array("vuln_id"), confidence_level="certain", category=_SUPPLY, label=F.col("version"),
    )


def vendored_vulnerabilities(files: DataFrame, advisories: DataFrame) -> DataFrame:
    """D6-002: libraries checked in under a vendored path whose file name carries name and version.

    Each name@version of a repository is reported once, at its first file.
    """
    parsed = (
        files.where(is_vendored_path(F.col("path")))
        .select("repo_id", "path", parse_vendored_name(basename(F.col("path"))).alias("v"))
        .where(F.col("v").isNotNull())
    )
    once = parsed.groupBy("repo_id", F.col("v.name").alias("name"), F.col("v.version").alias("version")).agg(
        F.min("path").alias("path")
    )
    hits = once.join(
        advisories.select("name", "version", "vuln_id", "raw_severity", "aliases"), ["name", "version"]
    )
    return finding_rows(
        hits, repo_id=F.col("repo_id"), detector="vendored-cves", rule="D6-002", domain="D6",
        severity=advisory_severity(F.col("raw_severity")), context="production",
        title=F.concat(F.lit("Vendored library with known CVE: "), "name", F.lit("@"), "version"),
        file=F.col("path"), package=F.col("name"), cve=F.col("vuln_id"),
        refs=F.concat(F.array("vuln_id"), F.coalesce("aliases", F.array().cast("array<string>"))),
        confidence_level="certain", category=_SUPPLY, label=F.col("version"),
    )


def external_dependencies(dependencies: DataFrame, workspace_names: DataFrame) -> DataFrame:
    """Dependencies without the repository's own packages."""
    return dependencies.join(workspace_names.select("repo_id", "name"), ["repo_id", "name"], "left_anti")


def fresh(registry: DataFrame, now: Column, hours: int = REGISTRY_TTL_HOURS) -> DataFrame:
    """Registry facts younger than the limit; older ones count as unknown."""
    return registry.where(F.col("checked_at") > now - F.make_interval(hours=F.lit(hours)))


def missing_packages(
    dependencies: DataFrame, registry: DataFrame, now: Column, hours: int = REGISTRY_TTL_HOURS
) -> DataFrame:
    """AI-005: names a fresh check found absent.  A name without a fresh check is unknown, not missing."""
    gone = fresh(registry, now, hours).where(~F.col("exists")).select("name")
    hits = dependencies.select("repo_id", "name").distinct().join(gone, "name")
    return finding_rows(
        hits, repo_id=F.col("repo_id"), detector="slopsquat", rule="AI-005", domain="D6", severity="critical",
        title=F.concat(F.lit("Package does not exist in the registry: "), "name"), file="package.json",
        package=F.col("name"), confidence_level="certain", category=_SUPPLY,
    )


def nearest_popular(name: Column, popular: list[str] | None = None, limit: int = LOOKALIKE_DISTANCE) -> Column:
    """Array with the closest popular name as ``struct(distance, pos, top)``; empty when none or identical.

    The list is fixed and short, so it lives in the expression: one pass over the
    distinct names, no join.  Ties go to the earlier entry.  The length band is
    tested before the distance.
    """
    names = popular or POPULAR_PACKAGES
    lower = F.lower(name)
    rows = [{"pos": i, "top": p, "low": p.lower(), "n": len(p)} for i, p in enumerate(names)]
    # one foldable literal instead of hundreds of column objects
    entries = F.from_json(F.lit(json.dumps(rows)), "array<struct<pos:int,top:string,low:string,n:int>>")
    in_band = F.filter(entries, lambda e: F.abs(F.length(lower) - e["n"]) <= limit)
    scored = F.transform(
        in_band,
        lambda e: F.struct(
            F.levenshtein(lower, e["low"], limit).alias("distance"), e["pos"].alias("pos"), e["top"].alias("top")
        ),
    )
    closest = F.slice(F.array_sort(F.filter(scored, lambda s: s["distance"] >= 0)), 1, 1)
    return F.filter(closest, lambda s: s["distance"] > 0)


def lookalike_packages(
    dependencies: DataFrame, registry: DataFrame, now: Column, popular: list[str] | None = None,
    hours: int = REGISTRY_TTL_HOURS,
) -> DataFrame:
    """AI-006: existing packages within two edits of a popular name.

    Distances are computed once per distinct name, then joined back to repositories.
    """
    known = fresh(registry, now, hours).where("exists").select("name").distinct()
    # inline, not a filter: a filter on the name would be pushed below the distinct
    near = (
        dependencies.select("name").distinct().join(known, "name")
        .select("name", F.inline(nearest_popular(F.col("name"), popular)))
        .select("name", "top", "distance")
    )
    hits = dependencies.select("repo_id", "name").distinct().join(near, "name")
    return finding_rows(
        hits, repo_id=F.col("repo_id"), detector="slopsquat", rule="AI-006", domain="D6", severity="high",
        title=F.concat(F.lit("Possible look-alike: "), "name", F.lit(" is close to "), "top"), file="package.json",
        package=F.col("name"), confidence_level="medium", category=_SUPPLY, label=F.col("top"),
    )


def _segment(length: Column, i: int) -> tuple[Column, Column]:
    """Start (from 0) and width of the i-th third of a text."""
    start = F.floor(length * i / 3)
    return start, F.floor(length * (i + 1) / 3) - start


def lookalikes_by_key(names: DataFrame, popular: DataFrame) -> DataFrame:
    """``name, top, distance`` against a popular *table* of any size.

    Two edits leave at least one third of a text intact, moved by at most two places.
    So a popular name is keyed by its length and each of its thirds, a name by the
    pieces that could be such a third of a text at most two characters longer or
    shorter: some seventy keys, whatever its length.  The distance only confirms.
    ``popular`` has ``top, pos`` (position decides ties).
    """
    top = F.lower("top")
    thirds = [F.struct(F.length(top).alias("n"), F.lit(i).alias("i"), F.substring(top, (p := _segment(F.length(top), i))[0].cast("int") + 1, p[1].cast("int")).alias("s")) for i in range(3)]
    right = popular.select("top", "pos", F.explode(F.array(*thirds)).alias("_k"))
    name, pieces = F.lower("name"), []
    for more in range(-2, 3):
        length = F.length(name) + more
        for i in range(3):
            start, width = _segment(length, i)
            for move in range(-2, 3):
                at = (start + move).cast("int")
                piece = F.struct(length.alias("n"), F.lit(i).alias("i"), F.substring(name, at + 1, width.cast("int")).alias("s"))
                pieces.append(F.when((length > 0) & (at >= 0) & (at + width <= F.length(name)), piece))
    keys = F.array_distinct(F.filter(F.array(*pieces), lambda k: k.isNotNull()))
    left = names.select("name").distinct().select("name", F.explode(keys).alias("_k"))
    scored = (
        left.join(right, "_k").select("name", "top", "pos").distinct()
        .select("name", "top", "pos", F.levenshtein(F.lower("name"), F.lower("top"), 2).alias("distance"))
        .where(F.col("distance") >= 0)
    )
    best = scored.groupBy("name").agg(F.min(F.struct("distance", "pos", "top")).alias("b"))
    return best.where("b.distance > 0").select("name", F.col("b.top").alias("top"), F.col("b.distance").alias("distance"))


def package_verdict(
    requests: DataFrame, registry: DataFrame, advisories: DataFrame, latest: DataFrame,
    advisory_coverage: Column | None = None, popular: list[str] | None = None,
) -> DataFrame:
    """block / warn / safe per requested ``name, version``.

    Missing packages and critical or high advisories block; other advisories,
    look-alikes and incomplete evidence warn.  An unknown name never becomes safe.
    """
    covered = F.lit(True) if advisory_coverage is None else advisory_coverage
    version = F.when(F.col("version").isNull() | (F.col("version") == "latest"), F.col("latest")).otherwise(F.col("version"))
    newest = F.struct("checked_at", "exists") if "checked_at" in registry.columns else F.col("exists")
    resolved = (
        requests.select("name", "version").distinct()
        .join(registry.groupBy("name").agg(F.max_by("exists", newest).alias("exists")), "name", "left")
        .join(latest.groupBy("name").agg(F.max("version").alias("latest")), "name", "left")
        .withColumn("resolved", F.coalesce(version, F.lit("latest")))
    )
    per_version = advisories.groupBy("name", F.col("version").alias("resolved")).agg(
        F.count(F.lit(1)).alias("n_cves"),
        F.count_if(F.upper("raw_severity").isin("CRITICAL", "HIGH")).alias("n_severe"),
    )
    joined = resolved.join(per_version, ["name", "resolved"], "left").fillna(0, ["n_cves", "n_severe"])
    joined = joined.withColumn("_near", nearest_popular(F.col("name"), popular))
    unresolved = (F.col("version").isNull() | (F.col("version") == "latest")) & F.col("latest").isNull()
    incomplete = ~covered | unresolved
    near = F.get("_near", F.lit(0))
    verdict = (
        F.when(~F.col("exists"), "block")
        .when(F.col("exists").isNull(), "warn")
        .when(F.col("n_severe") > 0, "block")
        .when((F.col("n_cves") > 0) | incomplete | near.isNotNull(), "warn")
        .otherwise("safe")
    )
    coverage = F.when(~F.col("exists"), "complete").when(F.col("exists").isNull() | incomplete, "incomplete").otherwise(
        "complete"
    )
    return joined.select(
        "name", "version", verdict.alias("verdict"), coverage.alias("coverage"), "n_cves", near["top"].alias("lookalike_of")
    )


def latest_stable_version(versions: DataFrame) -> DataFrame:
    """Highest release per package in semantic-version order; prereleases do not count."""
    shape = r"^v?(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)(?:\+[0-9A-Za-z.-]+)?$"

    def part(i: int) -> Column:
        return F.regexp_extract("version", shape, i).cast("decimal(38,0)")

    stable = versions.where(F.col("version").rlike(shape))
    return stable.groupBy("name").agg(F.max_by("version", F.struct(part(1), part(2), part(3), "version")).alias("version"))


# --------------------------------------------------------------------------- licences
def license_inventory(packages: DataFrame, direct: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Entries per (name, scope, licence, source, class) with sorted versions and blocking facts.

    ``packages`` has ``name, version, license, source``; ``direct`` has ``name``;
    ``decisions`` repeats the four columns of reviewed packages.
    """
    base = packages.select(
        "name", "version", F.coalesce(F.nullif("license", F.lit("")), F.lit("UNKNOWN")).alias("license"),
        F.coalesce("source", F.lit("")).alias("source"),
    ).distinct()
    if decisions is not None:
        reviewed = decisions.select("name", "version", "license", "source", F.lit(True).alias("_ok")).distinct()
        base = base.join(reviewed, ["name", "version", "license", "source"], "left")
    else:
        base = base.withColumn("_ok", F.lit(None).cast("boolean"))
    scoped = base.join(direct.select("name", F.lit("direct").alias("scope")).distinct(), "name", "left")
    reviewed_col = F.coalesce("_ok", F.lit(False))
    cls = F.when(reviewed_col, "owner-reviewed").otherwise(license_class(F.col("license")))
    rows = scoped.select(
        "name", "version", F.coalesce("scope", F.lit("transitive")).alias("scope"), "license", "source",
        cls.alias("class"), (~reviewed_col & ((cls != "permissive") | (F.col("source") == ""))).alias("blocked"),
    )
    return rows.groupBy("name", "scope", "license", "source", "class").agg(
        F.array_sort(F.collect_set("version")).alias("versions"),
        F.count_if("blocked").alias("blockers"),
        F.when(F.max("blocked"), F.when(F.first("class") != "permissive", "license-review-required").otherwise(
            "source-missing")).alias("reason"),
    )


def license_inventory_gaps(locked: DataFrame, found: DataFrame) -> DataFrame:
    """Packages on one side only."""
    left = locked.select("name", "version").distinct().withColumn("_l", F.lit(True))
    right = found.select("name", "version").distinct().withColumn("_r", F.lit(True))
    return (
        left.join(right, ["name", "version"], "full_outer")
        .where(F.col("_l").isNull() | F.col("_r").isNull())
        .select("name", "version", F.when(F.col("_l").isNull(), "unexpected").otherwise("missing").alias("side"))
    )


# --------------------------------------------------------------------------- agent servers
# What marks a credential variable and a filesystem server.
CREDENTIAL_NAMES = ["API_KEY", "SECRET", "TOKEN", "PASSWORD", "AUTH", "PRIVATE_KEY"]
FILESYSTEM_SERVER = r"@?modelcontextprotocol/server-filesystem"
ENV_REFERENCE = r"^\$\{?[A-Z0-9_]+\}?$"


def env_credential_label(name: Column, value: Column) -> Column:
    """Named key shape, else ``credential-shaped`` for a long mixed value; references give NULL."""
    from assayline.functions.regex import js_trim

    named = [F.when(matches(value, p, i), F.lit(label)) for label, p, i in CREDENTIAL_SHAPES]
    shaped = (
        F.upper(name).rlike("|".join(CREDENTIAL_NAMES))
        & (F.length(value) >= 20)
        & value.rlike("[A-Za-z]")
        & value.rlike("[0-9]")
    )
    real = (F.length(value) > 0) & ~js_trim(value).rlike(ENV_REFERENCE)
    return F.when(real, F.coalesce(*named, F.when(shaped, F.lit("credential-shaped"))))


def agent_findings_of_servers(servers: DataFrame, home: str = "~") -> DataFrame:
    """AGENT-001..005 in one pass: each server yields an array of hits, then one ``inline``."""
    args = F.coalesce("args", F.array().cast("array<string>"))
    npx = F.col("command") == "npx"
    tools = F.col("allowed_tools")
    wildcard = (tools == "*") | F.array_contains(F.from_json(tools, "array<string>"), "*")
    package = F.get(F.filter(args, lambda a: ~a.startswith("-")), F.lit(0))
    unpinned = F.when(package.startswith("@"), F.size(F.split(package, "@")) < 3).otherwise(
        ~F.contains(package, F.lit("@"))
    )
    roots = F.filter(args, lambda a: ~a.startswith("-") & ~F.contains(a, F.lit("modelcontextprotocol")))
    overscoped = F.exists(args, lambda a: a.rlike(FILESYSTEM_SERVER)) & F.exists(
        roots, lambda r: r.isin("/", home, "~", "$HOME")
    )
    url = F.col("url")
    plain = url.startswith("http://") & ~url.startswith("http://localhost") & ~url.startswith("http://127.0.0.1")

    def hit(cond: Column, rule: str, severity: Column | str, confidence: str, label: str) -> Column:
        sev = severity if isinstance(severity, Column) else F.lit(severity)
        return F.when(
            cond,
            F.struct(
                F.lit(rule).alias("rule"), sev.alias("severity"), F.lit(confidence).alias("confidence"),
                F.lit(label).alias("label"), F.lit(None).cast("string").alias("variable"),
            ),
        )

    fixed = F.array(
        hit(F.coalesce(wildcard, F.lit(False)) | tools.isNull(), "AGENT-001",
            F.when(tools.isNull(), "medium").otherwise("high"), "certain", "tool list"),
        hit(npx & unpinned, "AGENT-003", "medium", "high", "unpinned package"),
        hit(npx & overscoped, "AGENT-004", "high", "certain", "filesystem root"),
        hit(plain, "AGENT-005", "high", "certain", "plaintext url"),
    )
    secrets = F.transform(
        F.filter(F.map_entries("env"), lambda e: env_credential_label(e["key"], e["value"]).isNotNull()),
        lambda e: F.struct(
            F.lit("AGENT-002").alias("rule"), F.lit("critical").alias("severity"), F.lit("high").alias("confidence"),
            env_credential_label(e["key"], e["value"]).alias("label"), e["key"].alias("variable"),
        ),
    )
    empty = F.filter(fixed, lambda h: F.lit(False))
    hits = F.concat(F.filter(fixed, lambda h: h.isNotNull()), F.coalesce(secrets, empty))
    rows = servers.select("repo_id", "path", "server", F.inline(hits))
    return finding_rows(
        rows, repo_id=F.col("repo_id"), detector="agent-surface", rule=F.col("rule"), domain="D11",
        severity=F.col("severity"), title=F.concat(F.lit("Agent server "), "server", F.lit(": "), "label"),
        file=F.col("path"), package=F.col("server"), confidence_level=F.col("confidence"), category="Agent Surface",
        label=F.concat_ws(":", "label", "variable"),
    )
