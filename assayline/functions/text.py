"""Text functions: redaction, masking, names, URLs, paths, versions, licences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayline.functions.regex import group, js_trim, matches, portable

# --------------------------------------------------------------------------- redaction
# Secret shapes, in the order they are replaced (pattern, ignore case).
SECRET_SHAPES = [
    (r"(?:sk|pk)_(?:live|test)_[A-Za-z0-9]{12,}", False),
    (r"(?:token|secret|password|api[_-]?key)\s*[:=]\s*[^\s,;]+", True),
    (r"(?:export\s+)?[A-Z][A-Z0-9_]*(?:TOKEN|SECRET|PASSWORD|KEY)\s*=\s*[^\s]+", False),
    (r"Bearer\s+[A-Za-z0-9._-]{16,}", True),
    (r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b", False),
    (r"-----BEGIN(?: [A-Z0-9]+)* PRIVATE KEY-----[\s\S]*?-----END(?: [A-Z0-9]+)* PRIVATE KEY-----", False),
]
#: assignments keep their name when text is made synthetic
ASSIGNMENT = r"((?:secret|token|password|api[_-]?key)\s*)[:=]\s*[^\s,;]+"
SYNTHETIC_SHAPES = [0, 3, 4, 5]


def redact_text(text: Column, sensitive_paths: list[str] | None = None) -> Column:
    """Replace six secret shapes in order, then mask known paths, longest first."""
    out = reduce(
        lambda col, shape: F.regexp_replace(col, portable(*shape), "[REDACTED]"), SECRET_SHAPES, text
    )
    for path in sorted(sensitive_paths or [], key=len, reverse=True):
        out = F.replace(out, F.lit(path), F.lit("[REDACTED_PATH]"))
    return out


def synthesize_text(text: Column) -> Column:
    """Secrets replaced by a fixed marker, assignment names kept."""
    named = F.regexp_replace(text, portable(ASSIGNMENT, True), "$1=[synthetic-secret]")
    return reduce(
        lambda col, i: F.regexp_replace(col, portable(*SECRET_SHAPES[i]), "[synthetic-secret]"),
        SYNTHETIC_SHAPES,
        named,
    )


def mask_history_snippet(line: Column) -> Column:
    """The line with every long token blanked."""
    return F.regexp_replace(line, r"[A-Za-z0-9+/=_\-]{8,}", "****")


def mask_test_key(snippet: Column) -> Column:
    """Keep eight leading and four trailing characters of a test-mode key."""
    return F.regexp_replace(
        snippet, portable(r"\b((?:sk|pk|rk)_test_)(?=[A-Za-z0-9]{20,})[A-Za-z0-9]*([A-Za-z0-9]{4})"), "$1****$2"
    )


def truncate_utf8(text: Column, max_bytes: int) -> Column:
    """``struct(value, truncated)``: at most ``max_bytes`` bytes, whole characters only.

    Done on the binary form with plain expressions: the last three bytes tell how
    many bytes of an unfinished character to drop.  Three bytes of a four-byte
    character become one replacement character, which takes exactly their place.
    """
    raw = F.encode(text, "UTF-8")
    clip = F.substring(raw, 1, max_bytes)
    tail = F.lpad(F.hex(F.substring(clip, max(1, max_bytes - 2), 3)), 6, "0")
    cut = (
        F.when(tail.rlike("^....[C-F].$"), 1)
        .when(tail.rlike("^..[EF].[89AB].$"), 2)
        .when(tail.rlike("^F.[89AB].[89AB].$"), 3)
        .otherwise(0)
    )
    kept = F.decode(F.substring(clip, F.lit(1), F.lit(max_bytes) - cut), "UTF-8")
    clipped = F.concat(kept, F.when(cut == 3, F.lit("�")).otherwise(F.lit("")))
    over = F.octet_length(text) > max_bytes
    return F.struct(F.when(over, clipped).otherwise(text).alias("value"), over.alias("truncated"))


# --------------------------------------------------------------------------- package names
# A version inside a vendored file name and the three ways it is joined on.
VENDORED_VERSION = r"\d+(?:\.\d+){1,3}(?:[-.][a-z0-9]+)*"
VENDORED_NAME_SHAPES = [
    rf"^([a-z0-9][a-z0-9._-]*)@({VENDORED_VERSION})(?:\.min|\.bundle)?\.js$",
    rf"^([a-z0-9][a-z0-9._-]*)-({VENDORED_VERSION})(?:\.min|\.bundle)?\.js$",
    rf"^([a-z0-9][a-z0-9._-]*)\.({VENDORED_VERSION})(?:\.min|\.bundle)?\.js$",
]
VENDORED_DIRS = [
    r"(^|/)public/(libraries|vendor|libs|lib|js/vendor)/",
    r"(^|/)vendor/",
    r"(^|/)third[_-]?party/",
]
NPM_NAME = r"^(?:@[a-z0-9-][a-z0-9._-]*/)?[a-z0-9-][a-z0-9._-]*$"
BUILTIN_MODULES = [
    "assert", "buffer", "child_process", "cluster", "crypto", "events", "fs", "http", "https", "module",
    "net", "os", "path", "perf_hooks", "process", "querystring", "readline", "stream", "string_decoder",
    "timers", "tls", "tty", "url", "util", "v8", "vm", "worker_threads", "zlib",
]


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_vendored_path(path: Column) -> Column:
    return matches(path, "|".join(VENDORED_DIRS), True)


def parse_vendored_name(name: Column) -> Column:
    """``struct(name, version)`` of ``jquery-3.4.1.min.js`` and its kin, NULL when no shape fits."""
    clean = js_trim(name)
    pkg = F.coalesce(*[group(clean, p, 1, True) for p in VENDORED_NAME_SHAPES])
    ver = F.coalesce(*[group(clean, p, 2, True) for p in VENDORED_NAME_SHAPES])
    return F.when(pkg.isNotNull(), F.struct(F.lower(pkg).alias("name"), ver.alias("version")))


def valid_npm_name(name: Column) -> Column:
    return matches(name, NPM_NAME, True)


def package_from_specifier(specifier: Column) -> Column:
    """Package of an import specifier; relative, ``#`` and built-in modules give NULL."""
    parts = F.split(specifier, "/")
    name = F.when(specifier.startswith("@"), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(parts[0])
    own = (F.length(specifier) > 0) & ~specifier.rlike(r"^(?:\.|/|#|node:)")
    safe = (F.length(name) > 0) & (F.length(name) <= 512) & ~name.rlike(r"[\x00-\x1f\x7f]")
    return F.when(own & safe & ~name.isin(BUILTIN_MODULES), name)


# --------------------------------------------------------------------------- URLs and paths
_HOST = r"(?i)^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)"


def url_host(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, _HOST, 1))
    return F.regexp_replace(host, r"^\[|\]$", "")


# Hosts that always count as local.
LOCAL_HOSTS = ["localhost", "localhost.localdomain", "::1", "0.0.0.0", "169.254.169.254"]


def is_private_url(url: Column) -> Column:
    host = url_host(url)
    octets = F.transform(F.split(host, r"\."), lambda p: F.when(p.rlike("^[0-9]{1,3}$"), p.cast("int")))
    ipv4 = (F.size(octets) == 4) & F.forall(octets, lambda o: F.coalesce(o.between(0, 255), F.lit(False)))
    first, second = F.get(octets, F.lit(0)), F.get(octets, F.lit(1))
    private = (
        (first == 10)
        | ((first == 172) & second.between(16, 31))
        | ((first == 192) & (second == 168))
        | (first == 127)
    )
    return url.rlike("(?i)^https?://") & (host.isin(LOCAL_HOSTS) | F.coalesce(ipv4 & private, F.lit(False)))


def safe_https_url(url: Column) -> Column:
    """HTTPS with a host and no credentials, query or fragment."""
    return (
        F.length(url).between(1, 2048)
        & ~url.rlike(r"[\x00-\x1f\x7f]")
        & url.rlike(r"(?i)^https://[^/@?#\s]+(?:/[^?#]*)?$")
    )


def safe_relative_path(path: Column) -> Column:
    """Relative POSIX path without escapes, empty or dot segments, within size bounds."""
    short = F.octet_length(path) <= 255
    return (
        (F.length(path) > 0)
        & (F.octet_length(path) <= 4096)
        & ~path.rlike(r"[\x00-\x1f\x7f\\]|^/|^[A-Za-z]:|(?:^|/)\.{0,2}(?:/|\z)")
        # Only a long path can have a long segment.
        & F.when(short, True).otherwise(F.forall(F.split(path, "/"), lambda s: F.octet_length(s) <= 255))
    )


def parse_oci_reference(ref: Column) -> Column:
    """``struct(registry, repository, tag, digest)`` or NULL when the text is not a reference."""
    has_digest = F.contains(ref, F.lit("@"))
    base = F.substring_index(ref, "@", 1)
    digest = F.when(has_digest, F.substring_index(ref, "@", -1))
    first = F.substring_index(base, "/", 1)
    has_registry = (
        F.contains(base, F.lit("/"))
        & (F.length(first) > 0)
        & (F.contains(first, F.lit(".")) | F.contains(first, F.lit(":")) | (first == "localhost"))
    )
    registry = F.when(has_registry, first).otherwise("docker.io")
    rest = F.when(has_registry, F.substring(base, F.length(first) + 2, F.length(base))).otherwise(base)
    tagged = ~has_digest & rest.rlike(":[^/]*$")
    tag = F.when(tagged, F.regexp_extract(rest, ":([^/:]*)$", 1))
    repository = F.when(tagged, F.regexp_replace(rest, ":[^/:]*$", "")).otherwise(rest)
    ok = (
        (F.length(ref) <= 2048)
        & ~ref.rlike(r"\s|://")
        & (F.size(F.split(ref, "@")) <= 2)
        & (F.length(repository) > 0)
        & (has_digest | (F.length(tag) > 0))
    )
    return F.when(
        ok,
        F.struct(
            registry.alias("registry"), repository.alias("repository"), tag.alias("tag"), digest.alias("digest")
        ),
    )


# --------------------------------------------------------------------------- licences, versions
# Licence names by class.
PERMISSIVE_LICENSE = r"^(?:MIT|Apache-2\.0|BSD(?:-\d-Clause)?|ISC|0BSD|Unlicense|CC0-1\.0)$"
COPYLEFT_LICENSE = r"(?:GPL|AGPL|LGPL|MPL|EPL|CDDL|CPL|OSL)"


def license_class(license_name: Column) -> Column:
    return (
        F.when(matches(license_name, PERMISSIVE_LICENSE, True), "permissive")
        .when(matches(license_name, COPYLEFT_LICENSE, True), "copyleft")
        .otherwise("unknown")
    )


_VERSION = r"^(0|[1-9][0-9]{0,8})\.(0|[1-9][0-9]{0,8})\.(0|[1-9][0-9]{0,8})$"


def schema_compatibility(document: Column, reader: Column) -> Column:
    """exact / backward-compatible / upgrade-required / incompatible, or invalid."""
    def part(col: Column, i: int) -> Column:
        return F.regexp_extract(col, _VERSION, i).cast("bigint")

    ok = document.rlike(_VERSION) & reader.rlike(_VERSION)
    same_major = part(document, 1) == part(reader, 1)
    return (
        F.when(~F.coalesce(ok, F.lit(False)), "invalid")
        .when(document == reader, "exact")
        .when(same_major & (part(document, 2) <= part(reader, 2)), "backward-compatible")
        .when(same_major | (part(document, 1) > part(reader, 1)), "upgrade-required")
        .otherwise("incompatible")
    )


# --------------------------------------------------------------------------- probes
def probe_path_traversal(path: Column) -> Column:
    return F.array_contains(F.split(path, r"[\\/]+"), "..")


def probe_command_injection(text: Column) -> Column:
    return text.rlike(r"[;&|`$()<>\n\r]")


def probe_sql_injection(text: Column) -> Column:
    return matches(text, r"(?:['\"`]\s*(?:OR|AND)\s+['\"`]?\w+['\"`]?\s*=|--|/\*)", True)


def probe_unsafe_html(html: Column) -> Column:
    return matches(html, r"<script\b|\bon[a-z]+\s*=|javascript\s*:", True)


def probe_tool_not_allowed(tool: Column, allow_list: Column) -> Column:
    allowed = F.filter(F.transform(F.split(allow_list, ","), js_trim), lambda t: F.length(t) > 0)
    return ~F.array_contains(allowed, tool)


def globs_to_regex(globs: list[str]) -> str:
    """One alternation for a list of path globs (``**``, ``*``, ``?`` and literal text)."""
    import re as _re

    def one(glob: str) -> str:
        out, i = "", 0
        while i < len(glob):
            if glob.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif glob.startswith("**", i):
                out, i = out + ".*", i + 2
            elif glob[i] == "*":
                out, i = out + "[^/]*", i + 1
            elif glob[i] == "?":
                out, i = out + "[^/]", i + 1
            else:
                out, i = out + _re.sub(r"([.^$+{}()|\[\]\\])", r"\\\1", glob[i]), i + 1
        return out

    return "^(?:" + "|".join(one(g) for g in globs) + ")$"
