"""Where a finding was found: test files and other non-production places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.functions.regex import factored, matches
from assayline.functions.severity import DEFAULT_MIN_CONFIDENCE, resolved_confidence
from assayline.functions.text import globs_to_regex
from assayline.operators.spread import evaluate_once

# Path shapes that decide how a finding counts.
TEST_PATHS = [
    r"(?:^|/)__tests__/",
    r"\.(?:spec|test)\.[cm]?[jt]sx?$",
    r"(?:^|/)fixtures/",
    r"(?:^|/)mocks/",
    r"(?:^|/)__mocks__/",
    r"(?:^|/)test-utils\.[cm]?[jt]sx?$",
    r"(?:^|/)testdata/",
    r"(?:^|/)e2e/",
]
#: tag -> (case-insensitive shapes, case-sensitive shapes); the first matching tag wins
CONTEXT_TAGS: dict[str, tuple[list[str], list[str]]] = {
    "vendored-bundle": (
        [
            r"(^|/)public/(libraries|vendor|libs|lib|js/vendor)/",
            r"(^|/)vendor/",
            r"(^|/)third[_-]?party/",
            r"\.min\.(js|css)$",
            r"\.bundle\.(js|css)$",
            r"(^|/)public/(js|css|assets|dist|build|plugins|themes)/",
            r"(^|/)(?:binaries|bin)/[^/]+\.(?:cjs|mjs|js)$",
            r"(?:^|/)[a-z0-9][a-z0-9._-]*[-@]\d+(?:\.\d+){1,3}(?:[-.][a-z0-9]+)*(?:\.min|\.bundle)?\.(?:c?js|mjs)$",
        ],
        [
            r"\.yarn/(releases|plugins|sdks)/",
            r"(^|/)node_modules/",
            r"(^|/)\.pnp\.[a-z]+$",
        ],
    ),
    "data-content": (
        [
            r"(^|/)(?:public|src|content|static|assets|marketplace)/data/.*\.(?:json|jsonl|ndjson)$",
            r"(^|/)data/(?:catalogs?|content|manifests?|generated|dumps?|exports?|snapshots?|packs?)/"
            r".*\.(?:json|jsonl|ndjson)$",
            r"(?:^|/)(?:content|catalog|manifest|dump|export|snapshot|pack)-catalog\.(?:json|jsonl|ndjson)$",
            r"(?:^|/)skills?[-_]catalog\.(?:json|jsonl|ndjson)$",
        ],
        [],
    ),
    "generated": (
        [r"(^|/)generated/", r"\.generated\.[jt]sx?$", r"internal/types/generated/"],
        [r"(^|/)__generated__/", r"(^|/)_generated/"],
    ),
    "test-fixture": (
        [
            r"(^|/)test(s)?/",
            r"(^|/)testUtils?(\.|/)",
            r"(^|/)fixtures?/",
            r"(^|/)mocks?/",
            r"(^|/)mock[_-](?:api|server|data)/",
            r"(^|/)mockData/",
            r"(^|/)__fixtures__/",
            r"(^|/)benchmarks?/",
            r"(^|/)examples?/",
            r"(^|/)samples?/",
            r"(^|/)book/",
            r"(^|/)tutorials?/",
            r"(^|/)chapters?/",
            r"(^|/)lessons?/",
            r"(^|/)walkthroughs?/",
            r"(^|/)workshops?/",
        ],
        [
            r"(^|/)__tests__/",
            r"(^|/)spec/",
            r"(^|/)cypress/",
            r"(^|/)playwright/",
            r"(^|/)e2e[_-]tests?/",
            r"\.(test|spec)\.[jt]sx?$",
            r"[.-](?:e2e[.-]?(?:test|spec)|integration[.-](?:test|spec)|unit[.-](?:test|spec)|it)\.[jt]sx?$",
            r"\.e2e[.-]spec\.[jt]sx?$",
            r"(^|/)__mocks__/",
        ],
    ),
    "dev-fixture": (
        [
            r"\.env\.example$",
            r"\.env\.local$",
            r"\.env\.dev(elopment)?$",
            r"\.env\.test$",
            r"docker-compose.*\.ya?ml$",
            r"(^|/)docker/",
            r"(^|/)docker-compose/",
            r"(^|/)\.devcontainer/",
            r"(^|/)deploy(ment)?s?/",
            r"(^|/)helm/",
            r"(^|/)charts?/",
            r"(^|/)k8s/",
            r"(^|/)kubernetes/",
            r"(^|/)manifests?/",
            r"values(?:\.[a-z-]+)?\.ya?ml$",
            r"(^|/)terraform/",
            r"(^|/)ansible/",
        ],
        [r"(^|/)\.env(\.|$)", r"(^|/)Dockerfile(\.[^/]+)?$"],
    ),
    "ci-workflow": (
        [],
        [
            r"\.github/workflows/",
            r"\.gitlab-ci\.ya?ml$",
            r"(^|/)\.circleci/",
            r"(^|/)\.travis\.ya?ml$",
            r"(^|/)\.buildkite/",
            r"(^|/)\.woodpecker/",
            r"(^|/)\.depot/workflows/",
            r"(^|/)\.drone\.ya?ml$",
            r"(^|/)azure-pipelines",
        ],
    ),
    "build-config": (
        [
            r"webpack(DevServer)?\.config\.[jt]s$",
            r"webpack\.[^/]*\.(m|c)?[jt]sx?$",
            r"rspack\.config\.(m|c)?[jt]sx?$",
            r"vite\.config\.(m|c)?[jt]sx?$",
            r"rollup\.config\.(m|c)?[jt]sx?$",
            r"esbuild\.config\.(m|c)?[jt]sx?$",
            r"(^|/)build/config/",
            r"(^|/)config/webpack",
        ],
        [],
    ),
    "api-spec-example": (
        [
            r"openapi.*\.ya?ml$",
            r"swagger.*\.ya?ml$",
            r"\.openapi\.[a-z]+$",
            r"api/v\d+/.*\.(ya?ml|json)$",
            r"(^|/)apidocs?/",
        ],
        [],
    ),
    "docs": (
        [
            r"\.(md|mdx|rst|adoc)$",
            r"(^|/)docs?/",
            r"(^|/)CONTRIBUTING(\.[^/]+)?$",
            r"(^|/)README(\.[^/]+)?$",
            r"(^|/)CHANGELOG(\.[^/]+)?$",
        ],
        [],
    ),
}
TAG_EXEMPT_RULES = ["D6-002"]
TEST_NOTE = "Found in test file — likely intentional test fixture. Verify this is not a real credential."
TEST_KEY_NOTE = (
    "Private keys in test files are typically generated test fixtures for cryptographic unit tests. "
    "Confirm this key is not reused in any production environment."
)
PRIVATE_KEY_HINT = r"private key|begin .*private key"


def is_test_path(path: Column) -> Column:
    return F.coalesce(path.rlike(factored(TEST_PATHS)), F.lit(False))


def tag_pattern(tag: str) -> str:
    """One pattern per tag, common prefixes shared."""
    insensitive, sensitive = CONTEXT_TAGS[tag]
    parts = [f"(?i:{factored(insensitive)})"] if insensitive else []
    return "|".join(parts + ([factored(sensitive)] if sensitive else []))


def context_tag(path: Column) -> Column:
    """First of nine tags whose path shapes match; NULL in production code."""
    return F.coalesce(*[F.when(path.rlike(tag_pattern(t)), F.lit(t)) for t in CONTEXT_TAGS])


def min_confidence(findings: DataFrame, threshold: float = DEFAULT_MIN_CONFIDENCE) -> DataFrame:
    """Keep findings at or above the threshold; 0 keeps all."""
    return findings.where(
        resolved_confidence(F.col("confidence_level"), F.col("confidence_score")) >= threshold
    )


def classify_test_context(findings: DataFrame, strict: bool = False) -> DataFrame:
    """Set ``context``; outside strict mode findings in test files drop to info.

    ``note`` explains a test classification (private keys get their own wording).
    """
    test = is_test_path(F.col("file"))
    secret_key = (F.col("detector") == "secrets") & matches(
        F.concat_ws(" ", "title", F.coalesce("snippet", F.lit(""))), PRIVATE_KEY_HINT, True
    )
    kept = F.when(F.col("context").isin("placeholder", "enum"), F.col("context")).otherwise(
        F.coalesce("context", F.lit("production"))
    )
    out = evaluate_once(findings, findings.columns, _test=test)
    if not strict:
        out = out.withColumn("severity", F.when(F.col("_test"), "info").otherwise(F.col("severity")))
    return (
        out.withColumn("context", F.when(F.col("_test"), "test").otherwise(kept))
        .withColumn("note", F.when(F.col("_test"), F.when(secret_key, TEST_KEY_NOTE).otherwise(TEST_NOTE)))
        .drop("_test")
    )


def apply_context_tags(findings: DataFrame, strict: bool = False) -> DataFrame:
    """Stamp ``context_tag`` and ``original_severity``; outside strict mode drop to info."""
    tag = F.when(~F.coalesce(F.col("rule").isin(TAG_EXEMPT_RULES), F.lit(False)), context_tag(F.col("file")))
    tagged = evaluate_once(findings, findings.columns, _tag=tag)
    tagged = tagged.withColumn(
        "original_severity", F.when(F.col("_tag").isNotNull(), F.col("severity")).otherwise(F.col("original_severity"))
    ).withColumn("context_tag", F.coalesce("_tag", "context_tag"))
    if not strict:
        tagged = tagged.withColumn(
            "severity", F.when(F.col("_tag").isNotNull(), "info").otherwise(F.col("severity"))
        )
    return tagged.drop("_tag")


# Paths that are never read, and files read even when ignored.
ALWAYS_IGNORED = ["**/assayline-report*.html", "**/assayline-report*.json", "**/*.tgz"]
ALWAYS_READ = [
    ".env", ".env.local", ".env.production", ".env.development", "package.json", "package-lock.json",
    "pnpm-lock.yaml", "yarn.lock",
]
TEXT_EXTENSIONS = ["js", "jsx", "ts", "tsx", "mjs", "cjs", "json", "env", "yaml", "yml", "md"]


def ignore_lines(text: str) -> list[str]:
    """Globs of an ignore file: blank lines and ``#`` comments skipped."""
    lines = [line.strip() for line in text.split("\n")]
    return [line for line in lines if line and not line.startswith("#")]


def ignore_paths(files: DataFrame, globs: list[str]) -> DataFrame:
    """Drop files that match an ignore glob; always-read root files bypass the globs."""
    pattern = globs_to_regex([*globs, *ALWAYS_IGNORED])
    return files.where(F.col("path").isin(ALWAYS_READ) | ~F.col("path").rlike(pattern))
