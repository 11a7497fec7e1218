"""Reading source trees."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.operators.context import ALWAYS_READ, TEXT_EXTENSIONS, ignore_paths
from assayline.session import checkpoint_dir

# Paths ignored unless a project says otherwise, and folders never walked.
DEFAULT_IGNORES = [
    "**/node_modules/**", "**/dist/**", "**/.next/**", "**/coverage/**", "**/build/**", "**/.git/**", "**/.turbo/**",
    "**/.vercel/**", "**/.pnpm-store/**", "**/.claude/**", "**/.clerk/**", "**/.cursor/**", "**/.playwright-mcp/**",
]
AGENT_CONFIGS = r"(?:^|/)(?:\.cursor/mcp\.json|\.claude/mcp\.json|\.codeium/windsurf/mcp_config\.json|\.vscode/settings\.json)$"
NEVER_ENTERED = ["node_modules", ".git"]
_WANTED = re.compile(
    r"\.(?:" + "|".join(TEXT_EXTENSIONS) + ")$|^(?:" + "|".join(re.escape(name) for name in ALWAYS_READ) + ")$"
)


_FOUND = "rel string, is_dir boolean"
_FILE = "repo_id string, path string, content string"
#: Bytes of content that a reading task holds at a time.
_FRAME_BYTES = 16 << 20


def _hidden(path: Column) -> Column:
    return path.rlike(r"(?:^|/)[._]")


def _uri(root: str) -> str:
    return root if "://" in root else "file://" + root


def list_files(spark: SparkSession, root: str, prune: list[str], repo_depth: int = 1) -> DataFrame:
    """``repo_id, path, rel`` of every file below ``root``, hidden ones too, without opening any.

    Folders are rows: each round lists the folders that the last one found, so one deep
    repository is spread over all tasks by folder.  Folders named in ``prune`` are not
    entered.  There are as many rounds as the tree has levels; each is written to the
    checkpoint folder.  The root must be readable from every executor, by a path or an
    object store's URI.
    """
    uri = _uri(root)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(uri)
        top = base.rstrip("/")
        for batch in batches:
            for rel in batch["rel"]:
                found = [
                    (info.path[len(top) + 1 :], info.type == pafs.FileType.Directory)
                    for info in fs.get_file_info(pafs.FileSelector(f"{top}/{rel}" if rel else top))
                    if info.type != pafs.FileType.Directory or info.base_name not in prune
                ]
                yield pd.DataFrame(found, columns=["rel", "is_dir"])

    checkpoint_dir(spark)
    folders = spark.createDataFrame([("",)], "rel string")
    levels = []
    while True:
        found = folders.repartition("rel").mapInPandas(walk, _FOUND).checkpoint()
        levels.append(found.where(~F.col("is_dir")).select("rel"))
        folders = found.where("is_dir").select("rel")
        if folders.isEmpty():
            break
    files = reduce(lambda x, y: x.union(y), levels)
    parts = F.split("rel", "/")
    repo = F.array_join(F.slice(parts, 1, repo_depth), "/") if repo_depth else F.lit("")
    path = F.array_join(F.slice(parts, F.lit(repo_depth + 1), F.size(parts)), "/")
    return files.where(F.size(parts) > repo_depth).select(repo.alias("repo_id"), path.alias("path"), "rel")


def read_files(listed: DataFrame, root: str) -> DataFrame:
    """``repo_id, path, content`` of listed files; undecodable bytes become replacement characters."""
    uri = _uri(root)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(uri)
        rows, size = [], 0
        for batch in batches:
            for repo, path, rel in zip(batch["repo_id"], batch["path"], batch["rel"], strict=True):
                with fs.open_input_stream(f"{base.rstrip('/')}/{rel}") as handle:
                    raw = handle.read()
                rows.append((repo, path, raw.decode("utf-8", "replace")))
                size += len(raw)
                if size >= _FRAME_BYTES:
                    yield pd.DataFrame(rows, columns=["repo_id", "path", "content"])
                    rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["repo_id", "path", "content"])

    return listed.select("repo_id", "path", "rel").repartition("rel").mapInPandas(read, _FILE)


def _folder_names(patterns: list[str]) -> list[str]:
    """Names from patterns of the form ``**/name/**``, whose folders need not be entered."""
    return [m[1] for p in patterns if (m := re.fullmatch(r"\*\*/([^*?/\[{]+)/\*\*", p))]


def scan_source_files(
    spark: SparkSession, root: str, ignore: list[str] | None = None, repo_depth: int = 1, include_hidden: bool = True
) -> DataFrame:
    """``source_files`` below ``root``: one folder level (``repo_depth``) names the repository.

    Text extensions and a few root files, dot files included.  The tree is listed
    first, paths are filtered, and only what is left is read.
    """
    patterns = [*DEFAULT_IGNORES, *(ignore or [])]
    listed = list_files(spark, root, [*NEVER_ENTERED, *_folder_names(patterns)], repo_depth)
    wanted = ignore_paths(listed.where(F.col("path").rlike(_WANTED.pattern)), patterns)
    return read_files(wanted if include_hidden else wanted.where(~_hidden(F.col("path"))), root)


def agent_config_files(repos: DataFrame, root: str, repo_depth: int = 1) -> DataFrame:
    """Agent configuration files of each repository; they are read even though scans ignore their folders."""
    found = list_files(repos.sparkSession, root, NEVER_ENTERED, repo_depth).where(F.col("path").rlike(AGENT_CONFIGS))
    return read_files(found.join(repos.select("repo_id").distinct(), "repo_id", "left_semi"), root)


def with_file_facts(files: DataFrame) -> DataFrame:
    """Add ``ext`` and ``n_lines``."""
    return files.withColumn("ext", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).withColumn(
        "n_lines", F.size(F.split("content", "\n", -1))
    )
