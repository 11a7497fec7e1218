"""Source trees as a Spark data source: ``spark.read.format("source_tree")`` and ``readStream``.

    register(spark)
    spark.read.format("source_tree").option("path", "/data/checkouts").load()       # repo_id, path, content
    CREATE TEMPORARY VIEW tree USING source_tree OPTIONS (path '/data/checkouts')    -- the same from SQL

Options: ``path`` (root: a path or an object store's URI that every executor can read),
``repo_depth`` (folder levels that name a repository, default 1), ``skip`` (names of
folders that are never entered, comma-separated, besides the library's own) and, for
streams, ``settle_ms`` (default 1000).

Partitions are planned: one for each folder directly below a repository, and one for a
repository's own files, so a large repository is many tasks.  Filters on ``repo_id`` and on the
start of ``path`` are taken over, so other folders are neither listed nor read.

A stream's offset is a time: a batch holds the files that changed after the last offset
and up to the new one, which lies ``settle_ms`` back, so that no file is still being
written at it.  Nothing is listed to find an offset, and a repeated batch reads the
same files again.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith,
)

from assayline.operators.context import ALWAYS_READ, TEXT_EXTENSIONS, ignore_paths
from assayline.sources.files import DEFAULT_IGNORES, NEVER_ENTERED, _folder_names

SCHEMA = "repo_id string, path string, content string"
#: Bytes of content that a reading task holds at a time, and threads that list folders while partitions are planned.
FRAME_BYTES, LISTERS = 16 << 20, 16
_WANTED = re.compile(r"\.(?:" + "|".join(TEXT_EXTENSIONS) + ")$|^(?:" + "|".join(re.escape(name) for name in ALWAYS_READ) + ")$")


@dataclass
class Folder(InputPartition):
    """The files of ``repo`` below ``folder`` ('': directly in the repository), all levels down or (``deep`` false) its own."""

    repo: str
    folder: str
    deep: bool

    def __post_init__(self) -> None:
        super().__init__((self.repo, self.folder))


@dataclass
class Changed(Folder):
    """A folder's files that changed in a span of time."""

    after: int = 0
    until: int = 0


class Tree:
    """What the readers share: options, pushed filters, planning and walking."""

    def __init__(self, options: dict[str, str]):
        root = options.get("path")
        if not root:
            raise ValueError("source_tree needs the option 'path'")
        self.uri = root if "://" in root else "file://" + root
        self.depth = int(options.get("repo_depth", "1"))
        own = [x for x in options.get("skip", "").split(",") if x]
        self.skip = {*NEVER_ENTERED, *_folder_names(DEFAULT_IGNORES), *own}
        self.repos: set[str] | None = None
        self.starts: list[str] = []

    def open(self) -> tuple[Any, str]:
        fs, base = pafs.FileSystem.from_uri(self.uri)
        return fs, base.rstrip("/")

    def listed(self, fs: Any, folder: str) -> list[Any]:
        return sorted(fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)), key=lambda i: i.base_name)

    def folders(self, fs: Any, folder: str) -> list[str]:
        return [i.base_name for i in self.listed(fs, folder) if i.type == pafs.FileType.Directory and i.base_name not in self.skip]

    def fits(self, path: str) -> bool:
        return all(path.startswith(s) for s in self.starts)

    def may_hold(self, folder: str) -> bool:
        """Whether files below ``folder`` can fit all pushed starts of a path."""
        return all(s.startswith(folder + "/") or (folder + "/").startswith(s) for s in self.starts)

    def take(self, f: Filter) -> bool:
        """Whether a filter is taken over whole."""
        if isinstance(f, (EqualTo, In)) and f.attribute == ("repo_id",):
            values = {f.value} if isinstance(f, EqualTo) else {*f.value}
            self.repos = values if self.repos is None else self.repos & values
            return True
        if isinstance(f, StringStartsWith) and f.attribute == ("path",):
            self.starts.append(f.value)
            return True
        if isinstance(f, EqualTo) and f.attribute == ("path",):
            self.starts.append(f.value)  # a longer path may start so, too: Spark tests it again
        return False

    def plan(self) -> list[Folder]:
        fs, top = self.open()
        if self.repos is not None:
            repos = sorted(r for r in self.repos if r is not None and r.count("/") == max(0, self.depth - 1) and ".." not in r.split("/"))
        else:
            repos = [""]
            for _ in range(self.depth):
                with ThreadPoolExecutor(LISTERS) as pool:
                    below = list(pool.map(lambda r: self.folders(fs, f"{top}/{r}".rstrip("/")), repos))
                repos = [f"{r}/{name}".lstrip("/") for r, names in zip(repos, below, strict=True) for name in names]

        def units(repo: str) -> list[Folder]:
            below = [f for f in self.folders(fs, f"{top}/{repo}".rstrip("/")) if self.may_hold(f)]
            own = [Folder(repo, "", False)] if all("/" not in s for s in self.starts) else []
            return [*own, *(Folder(repo, f, True) for f in below)]

        with ThreadPoolExecutor(LISTERS) as pool:
            return [u for us in pool.map(units, repos) for u in us]

    def walk(self, part: Folder, after: int | None = None, until: int | None = None) -> Iterator[pa.RecordBatch]:
        """The files of a partition, some megabytes at a time; with bounds, those changed after one time and up to another (nanoseconds)."""
        fs, top = self.open()
        base = f"{top}/{part.repo}".rstrip("/")
        rows: list[tuple[str, str]] = []
        size, todo = 0, [part.folder]

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part.repo] * len(rows), pa.string()), pa.array([p for p, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.string())], ["repo_id", "path", "content"])

        while todo:
            folder = todo.pop()
            for info in self.listed(fs, f"{base}/{folder}".rstrip("/")):
                path = f"{folder}/{info.base_name}".lstrip("/")
                if info.type == pafs.FileType.Directory:
                    if part.deep and info.base_name not in self.skip and self.may_hold(path):
                        todo.append(path)
                    continue
                if info.type != pafs.FileType.File or not _WANTED.search(path) or not self.fits(path):
                    continue
                if after is not None and not after < info.mtime_ns <= until:
                    continue
                with fs.open_input_stream(f"{base}/{path}") as handle:
                    content = handle.read().decode("utf-8", "replace")
                rows.append((path, content))
                size += len(content)
                if size >= FRAME_BYTES:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.tree = Tree(options)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return [f for f in filters if not self.tree.take(f)]

    def partitions(self) -> list[Folder]:
        return self.tree.plan()

    def read(self, partition: Folder | None) -> Iterator[pa.RecordBatch]:
        return self.tree.walk(partition) if partition else iter(())  # Spark reads a source without partitions once


class TreeStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.tree, self.settle = Tree(options), int(options.get("settle_ms", "1000")) * 1_000_000

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() - self.settle}

    def partitions(self, start: dict, end: dict) -> list[tuple]:
        return [Changed(f.repo, f.folder, f.deep, start["until"], end["until"]) for f in self.tree.plan()]

    def read(self, partition: Changed | None) -> Iterator[pa.RecordBatch]:
        return self.tree.walk(partition, partition.after, partition.until) if partition else iter(())

    def commit(self, end: dict) -> None:
        return None


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> TreeReader:
        return TreeReader(dict(self.options))

    def streamReader(self, schema: Any) -> TreeStreamReader:
        return TreeStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format ``source_tree`` known to a session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)


def read_tree(spark: SparkSession, root: str, ignore: list[str] | None = None, repo_depth: int = 1) -> DataFrame:
    """``source_files`` below ``root`` through the data source, without ignored paths; filters reach its planning."""
    register(spark)
    patterns = ignore or []
    reader = spark.read.format("source_tree").option("path", root).option("repo_depth", repo_depth).option("skip", ",".join(_folder_names(patterns)))
    return ignore_paths(reader.load(), [*DEFAULT_IGNORES, *patterns])


def watch_tree(spark: SparkSession, root: str, ignore: list[str] | None = None, repo_depth: int = 1, settle_ms: int = 1000) -> DataFrame:
    """New and changed source files as a stream, for :func:`assayline.streaming.flows.watch_scan`."""
    register(spark)
    patterns = ignore or []
    reader = spark.readStream.format("source_tree").option("path", root).option("repo_depth", repo_depth).option("skip", ",".join(_folder_names(patterns))).option("settle_ms", settle_ms)
    return ignore_paths(reader.load(), [*DEFAULT_IGNORES, *patterns])
