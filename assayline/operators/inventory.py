"""Surface inventory of source files and rewrite suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.functions.regex import matches, portable
from assayline.functions.text import package_from_specifier

# What the inventory looks for.
IMPORT_SHAPE = (
    r"(?:from\s*[\"'`]|import\s*[\"'`]|require\s*\(\s*[\"'`]|import\s*\(\s*[\"'`])([^\"'`\r\n]+)"
)
ROUTE_SHAPE = r"\.(get|post|put|patch|delete|head|options|use)\s*\(\s*[\"'`]([^\"'`\r\n]+)[\"'`]"
TOOL_SHAPE = r"\.(?:tool|registerTool|addTool)\s*\(\s*[\"'`]([^\"'`\r\n]+)[\"'`]"
SINK_SHAPES = [
    ("command-execution", r"\b(?:exec|execFile|spawn|fork)\s*\("),
    ("network-request", r"\b(?:fetch|axios(?:\.[A-Za-z]+)?|https?\.request)\s*\("),
    ("file-boundary", r"\b(?:readFile|writeFile|createReadStream|createWriteStream)\s*\("),
    ("dynamic-code", r"\b(?:eval|Function)\s*\(|\bnew\s+Function\s*\("),
    ("xss", r"(?:innerHTML\s*=|dangerouslySetInnerHTML\s*[:=])"),
]
FRAMEWORKS = [
    "@angular/core", "@nestjs/core", "astro", "express", "fastify", "hono", "koa", "next", "nuxt",
    "react", "remix", "svelte", "vue",
]
SOURCE_FILE = r"\.(?:cjs|js|jsx|mjs|ts|tsx)$"


def _safe(text: Column) -> Column:
    return (F.length(text) > 0) & ~text.rlike(r"[\x00-\x1f\x7f]")


def _lines_with(content: Column, pattern: str) -> Column:
    """Lines on which a match starts, found by marking match starts before splitting."""
    marked = F.regexp_replace(F.translate(content, "\x01", " "), portable(pattern), "\x01$0")
    numbers = F.transform(
        F.split(marked, "\n", -1), lambda x, i: F.when(F.contains(x, F.lit("\x01")), i + 1)
    )
    return F.filter(numbers, lambda n: n.isNotNull())


def surface_inventory(files: DataFrame) -> DataFrame:
    """``repo_id, path, kind, name, detail, line``: packages, routes, tools and candidate sinks.

    A route or tool whose name holds control characters is an ``unreadable`` item.
    """
    content = F.col("content")

    def item(kind: Column | str, name: Column, detail: Column | None = None, line: Column | None = None) -> Column:
        return F.struct(
            (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"),
            name.cast("string").alias("name"),
            (F.lit(None).cast("string") if detail is None else detail).alias("detail"),
            (F.lit(None).cast("int") if line is None else line.cast("int")).alias("line"),
        )

    def sinks(kind: str, pattern: str) -> Column:
        return F.transform(_lines_with(content, pattern), lambda n: item("sink", F.lit(kind), None, n))

    packages = F.array_distinct(
        F.transform(F.regexp_extract_all(content, F.lit(IMPORT_SHAPE), F.lit(1)), package_from_specifier)
    )
    packages = F.filter(packages, lambda p: p.isNotNull())
    routes = F.arrays_zip(
        F.regexp_extract_all(content, F.lit(ROUTE_SHAPE), F.lit(1)).alias("m"),
        F.regexp_extract_all(content, F.lit(ROUTE_SHAPE), F.lit(2)).alias("p"),
    )
    tools = F.regexp_extract_all(content, F.lit(TOOL_SHAPE), F.lit(1))
    rows = F.concat(
        F.transform(packages, lambda p: item("package", p)),
        F.transform(
            F.filter(packages, lambda p: p.isin(FRAMEWORKS)), lambda p: item("framework", p)
        ),
        F.transform(
            F.array_distinct(F.filter(routes, lambda r: _safe(r["p"]))),
            lambda r: item("route", r["p"], F.upper(r["m"])),
        ),
        F.transform(F.array_distinct(F.filter(tools, _safe)), lambda t: item("tool", t)),
        F.transform(F.filter(routes, lambda r: ~_safe(r["p"])), lambda r: item("unreadable", F.lit("route"))),
        F.transform(F.filter(tools, lambda t: ~_safe(t)), lambda t: item("unreadable", F.lit("tool"))),
        *[sinks(kind, p) for kind, p in SINK_SHAPES],
    )
    return files.where(F.col("path").rlike(SOURCE_FILE)).select("repo_id", "path", F.inline(rows))


# What the path tells about a file.
CONFIG_NAME = r"(?:^|/)(?:package\.json|tsconfig[^/]*|(?:[^/]*\.)?config\.[cm]?[jt]s)$"
TEST_PATH = r"(?:^|[./_-])(?:test|tests|spec|__tests__)(?:[./_-]|$)|\.(?:test|spec)\.[^./]+$"
DEPENDENCY_FIELDS = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]


def entry_point_kind(path: Column) -> Column:
    """config, test or source, by the path in lower case."""
    low = F.lower(path)
    return F.when(low.rlike(CONFIG_NAME), "config").when(low.rlike(TEST_PATH), "test").when(low.rlike(SOURCE_FILE), "source").otherwise("config")


def manifest_inventory(files: DataFrame) -> DataFrame:
    """``repo_id, path, kind, name, detail``: what the root manifests declare.

    kind is ``script`` (an entry point), ``package`` or ``framework`` (detail: the field), or ``unreadable``
    for a manifest that is no JSON object.  A name with control characters is left out.
    """
    raw = F.col("content")
    names = lambda field: F.array_distinct(F.map_keys(F.from_json(F.get_json_object(raw, f"$.{field}"), "map<string, string>")))
    item = lambda kind, name, detail=None: F.struct(F.lit(kind).alias("kind"), name.alias("name"), F.lit(detail).cast("string").alias("detail"))
    none = F.array().cast("array<struct<kind: string, name: string, detail: string>>")
    safe = lambda found: F.filter(F.coalesce(found, F.array().cast("array<string>")), _safe)

    def of_field(field: str) -> list[Column]:
        found = safe(names(field))
        return [F.transform(found, lambda n: item("package", n, field)), F.transform(F.filter(found, lambda n: n.isin(FRAMEWORKS)), lambda n: item("framework", n, field))]

    declared = [F.coalesce(x, none) for f in DEPENDENCY_FIELDS for x in of_field(f)]
    whole = F.get_json_object(raw, "$").startswith("{")
    rows = F.when(F.coalesce(whole, F.lit(False)), F.concat(F.transform(safe(names("scripts")), lambda n: item("script", n)), *declared)).otherwise(
        F.array(item("unreadable", F.lit("manifest")))
    )
    return files.where(F.col("path") == "package.json").select("repo_id", "path", F.inline(rows))


def entry_points(files: DataFrame) -> DataFrame:
    """``repo_id, path, kind, name``: every file by its kind (config, test, source), and every script of a root manifest."""
    own = files.select("repo_id", "path", entry_point_kind(F.col("path")).alias("kind"), F.lit(None).cast("string").alias("name"))
    scripts = manifest_inventory(files).where("kind = 'script'").select("repo_id", "path", "kind", "name")
    return own.unionByName(scripts).distinct()


def target_inventory(files: DataFrame) -> DataFrame:
    """:func:`surface_inventory` with what root manifests declare and the entry points, each as ``repo_id, path, kind, name, detail, line``.

    Entry points are of kind ``entry-point``, their own kind being the detail.
    """
    no_line = F.lit(None).cast("int").alias("line")
    manifest = manifest_inventory(files).where("kind <> 'script'").select("repo_id", "path", "kind", "name", "detail", no_line)
    points = entry_points(files).select("repo_id", "path", F.lit("entry-point").alias("kind"), "name", F.col("kind").alias("detail"), no_line)
    return surface_inventory(files).unionByName(manifest).unionByName(points)


def surface_counts(files: DataFrame, inventory: DataFrame) -> DataFrame:
    """Per repository: files and bytes inspected, items per kind, status.

    ``inventory`` may be that of :func:`surface_inventory` or :func:`target_inventory`.  The status is
    ``incomplete`` if a source file has no content or an item is unreadable.
    """
    source = files.where(F.col("path").rlike(SOURCE_FILE))
    sizes = source.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("files_inspected"), F.sum(F.octet_length("content").cast("bigint")).alias("bytes_inspected"),
        F.count_if(F.col("content").isNull()).alias("_empty"),
    )
    kinds = inventory.groupBy("repo_id").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("package", "framework", "route", "tool", "sink")],
        F.count_if(F.col("kind") == "unreadable").alias("_unreadable"),
    )
    counts = [f"n_{k}" for k in ("package", "framework", "route", "tool", "sink")]
    joined = sizes.join(kinds, "repo_id", "left").fillna(0, [*counts, "_unreadable"])
    status = F.when((F.col("_empty") == 0) & (F.col("_unreadable") == 0), "complete").otherwise("incomplete")
    return joined.withColumn("status", status).drop("_empty", "_unreadable")


# Rewrites of predictable secrets.
OTP_SHAPE = r"Math\.floor\s*\(\s*(\d+)\s*\+\s*Math\.random\s*\(\s*\)\s*\*\s*(\d+)\s*\)"
TOKEN_SHAPE = (
    r"Math\.random\s*\(\s*\)\s*\.\s*toString\s*\(\s*36\s*\)\s*\.\s*(slice|substring|substr)\s*\(\s*2\s*\)"
)
ANY_RANDOM = r"Math\.random\s*\(\s*\)"
CRYPTO_CALL = r"\bcrypto\.(randomInt|randomBytes)\b"
CRYPTO_IMPORT = [
    r"import\s+\*?\s*(?:crypto|\{[^}]*crypto[^}]*\})\s*from\s*['\"]node:crypto['\"]",
    r"require\s*\(\s*['\"]node:crypto['\"]\s*\)",
]
REVIEW_COMMENT = "/* AI-002: replace with crypto.randomInt / crypto.randomBytes */ Math.random()"


def suggest_fix(code: Column) -> Column:
    """Rewritten code, NULL when there is nothing to rewrite.

    The one rewrite that computes (``start + range``) splits the text at its
    matches and joins the pieces around the computed replacements, so it stays a
    column expression.
    """
    pieces = F.split(code, OTP_SHAPE, -1)
    starts = F.regexp_extract_all(code, F.lit(OTP_SHAPE), F.lit(1))
    ranges = F.regexp_extract_all(code, F.lit(OTP_SHAPE), F.lit(2))
    calls = F.zip_with(
        starts,
        ranges,
        lambda s, r: F.concat(
            F.lit("crypto.randomInt("), s.cast("decimal(38,0)").cast("string"), F.lit(", "),
            (s.cast("decimal(38,0)") + r.cast("decimal(38,0)")).cast("decimal(38,0)").cast("string"), F.lit(")"),
        ),
    )
    otp = F.array_join(F.zip_with(pieces, calls, lambda p, c: F.concat(p, F.coalesce(c, F.lit("")))), "")
    token = F.regexp_replace(
        F.when(matches(code, OTP_SHAPE), otp).otherwise(code), TOKEN_SHAPE, "crypto.randomBytes(32).toString('base64url')"
    )
    fixed = F.when(token == code, F.regexp_replace(code, ANY_RANDOM, REVIEW_COMMENT)).otherwise(token)
    needs_import = matches(fixed, CRYPTO_CALL) & ~fixed.rlike("|".join(CRYPTO_IMPORT))
    full = F.when(needs_import, F.concat(F.lit('import * as crypto from "node:crypto";\n'), fixed)).otherwise(fixed)
    return F.when(full != code, full)
