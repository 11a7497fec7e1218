"""Lockfiles, manifests, workspaces and agent configurations as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline import schemas


def _lock_name(path: Column) -> Column:
    """First ``node_modules/`` removed, then what follows the last one."""
    once = F.regexp_replace(path, r"^((?:(?!node_modules/).)*)node_modules/", "$1")
    return F.element_at(F.split(once, "node_modules/"), -1)


def flatten_lockfile(lockfiles: DataFrame, content: str = "content") -> DataFrame:
    """``repo_id, name, version`` of a JSON lockfile, both layouts; entries without version drop.

    The ``packages`` map wins when it is present, even if empty.
    """
    lock = F.from_json(content, schemas.LOCKFILE)
    parsed = lockfiles.select("repo_id", lock.alias("l"))
    new = F.transform(
        F.map_entries("l.packages"),
        lambda e: F.struct(_lock_name(e["key"]).alias("name"), e["value"]["version"].alias("version")),
    )
    old = F.transform(
        F.map_entries("l.dependencies"),
        lambda e: F.struct(e["key"].alias("name"), e["value"]["version"].alias("version")),
    )
    return (
        parsed.select("repo_id", F.inline(F.when(F.col("l.packages").isNotNull(), new).otherwise(old)))
        .where((F.length("version") > 0) & (F.length("name") > 0))
        .distinct()
    )


def manifest_dependencies(manifests: DataFrame, content: str = "content") -> DataFrame:
    """Distinct dependency names over the four dependency fields."""
    m = F.from_json(content, schemas.MANIFEST)
    fields = ["dependencies", "devDependencies", "optionalDependencies", "peerDependencies"]
    keys = F.array_distinct(
        F.flatten(F.array(*[F.coalesce(F.map_keys(F.col("m")[f]), F.array().cast("array<string>")) for f in fields]))
    )
    return manifests.select("repo_id", m.alias("m")).select("repo_id", F.explode(keys).alias("name")).distinct()


def union_distinct_dependencies(manifest: DataFrame, lock: DataFrame) -> DataFrame:
    """Names of manifest and lockfile together, well-formed ones only."""
    from assayline.functions.text import valid_npm_name

    return (
        manifest.select("repo_id", "name")
        .union(lock.select("repo_id", "name"))
        .where(valid_npm_name(F.col("name")))
        .distinct()
    )


def pnpm_lock_packages(locks: DataFrame, content: str = "content") -> DataFrame:
    """``repo_id, name, version, issue`` of the ``packages:`` section of a v9 lock.

    The section is cut out of the line array of the row, so nothing is shuffled
    until duplicates are counted.  ``issue`` names what makes a row unusable.
    """
    lines = F.split(content, r"\r?\n")
    start = F.array_position(lines, "packages:")
    stop = F.array_position(lines, "snapshots:")
    body = F.slice(lines, start.cast("int") + 1, F.greatest(stop.cast("int") - start.cast("int") - 1, F.lit(0)))
    keys = F.filter(
        F.transform(body, lambda x: F.regexp_extract(x, r"^  (\S.*):$", 1)), lambda k: k != ""
    )
    version_ok = F.col(content).rlike(r"(?m)^lockfileVersion:\s*['\"]?9\.0['\"]?\s*$")
    whole = (start > 0) & (stop > start)
    rows = locks.where(version_ok & whole).select("repo_id", F.explode(keys).alias("_k"))
    rows = rows.select("repo_id", F.regexp_replace("_k", r"^(['\"])(.*)\1$", "$2").alias("_id"))
    name = F.regexp_extract("_id", r"^(.+)@([^@]+)$", 1)
    version = F.regexp_extract("_id", r"^(.+)@([^@]+)$", 2)
    counted = rows.select("repo_id", "_id", name.alias("name"), version.alias("version")).groupBy(
        "repo_id", "_id", "name", "version"
    ).agg(F.count(F.lit(1)).alias("_n"))
    return counted.select(
        "repo_id", "name", "version",
        F.when(F.col("name") == "", F.concat(F.lit("unsupported id "), "_id"))
        .when(F.col("_n") > 1, "duplicate entry")
        .alias("issue"),
    )


def _glob_regex(glob: Column) -> Column:
    """A workspace glob as a regular expression over the manifest path."""
    slash = F.when(glob.endswith("/"), glob).otherwise(F.concat(glob, F.lit("/")))
    escaped = F.regexp_replace(slash, r"([.^$+{}()|\[\]\\])", r"\\$1")
    deep = F.replace(escaped, F.lit("**/"), F.lit("\x01"))
    star = F.replace(deep, F.lit("*"), F.lit("[^/]*"))
    return F.concat(F.replace(star, F.lit("\x01"), F.lit("(?:.*/)?")), F.lit(r"package\.json"))


def workspace_globs(root_files: DataFrame) -> DataFrame:
    """``repo_id, globs`` from root manifests and workspace files."""
    ws = F.get_json_object("content", "$.workspaces")
    from_manifest = F.coalesce(
        F.from_json(ws, "array<string>"),
        F.from_json(ws, "struct<packages:array<string>>")["packages"],
        F.array().cast("array<string>"),
    )
    section = F.regexp_extract("content", r"(?m)^packages:\s*\n((?:\s*-\s+[^\n]+\n?)+)", 1)
    from_yaml = F.regexp_extract_all(section, F.lit(r"(?m)^\s*-\s*['\"]?([^'\"\s]+)['\"]?"), F.lit(1))
    globs = F.when(F.col("path") == "package.json", from_manifest).when(
        F.col("path") == "pnpm-workspace.yaml", from_yaml
    )
    return (
        root_files.where(F.col("path").isin("package.json", "pnpm-workspace.yaml"))
        .select("repo_id", F.explode(globs).alias("glob"))
        .distinct()
    )


def workspace_package_names(files: DataFrame) -> DataFrame:
    """``repo_id, name`` of packages inside the repository's own workspaces.

    Globs are indexed by the folders that they name in full (``apps/*`` by ``apps/``): a
    manifest looks up the folders above it and only the globs found there run their
    pattern, so neither a repository with many globs nor one with many manifests is a
    single row.
    """
    glob = F.when(F.col("glob").endswith("/"), F.col("glob")).otherwise(F.concat("glob", F.lit("/")))
    globs = workspace_globs(files).select("repo_id", F.regexp_extract(glob, r"^(?:[^*/]+/)*", 0).alias("_above"), F.concat(F.lit("^"), _glob_regex(F.col("glob")), F.lit("$")).alias("_rx"))
    manifests = files.where(F.col("path").rlike(r"(?:^|/)package\.json$") & ~F.col("path").rlike("(?:^|/)node_modules/"))
    named = manifests.select("repo_id", "path", F.get_json_object("content", "$.name").alias("name")).where(F.length("name") > 0)
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))
    found = named.withColumn("_above", F.explode(above)).join(globs, ["repo_id", "_above"]).where(F.rlike("path", F.col("_rx")))
    return found.select("repo_id", "name").distinct()


def read_agent_configs(configs: DataFrame, content: str = "content") -> DataFrame:
    """One row per declared server: ``repo_id, path, server, command, args, env, url, allowed_tools``.

    ``allowed_tools`` keeps the JSON text when the value is a list, so both the
    string and the list form survive.
    """
    text = F.coalesce(
        F.get_json_object(content, "$.mcpServers"), F.get_json_object(content, "$['cline.mcpServers']")
    )
    servers = F.from_json(text, schemas.AGENT_SERVER)
    return (
        configs.select("repo_id", "path", F.explode(servers).alias("server", "e"))
        .select(
            "repo_id", "path", "server", F.col("e.command").alias("command"), F.col("e.args").alias("args"),
            F.col("e.env").alias("env"), F.col("e.url").alias("url"), F.col("e.allowedTools").alias("allowed_tools"),
        )
    )
