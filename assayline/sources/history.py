"""Commit logs as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HEADER = r"^<<([0-9a-f]{7,40})\s+(\d+)>>$"


def parse_commit_log(logs: DataFrame, content: str = "log") -> DataFrame:
    """``repo_id, pos, sha, ts, files`` from ``<<sha seconds>>`` headers and numstat rows.

    ``files`` is an array of ``(path, lines_added)``; ``-`` (binary) counts as 0 and
    malformed rows are ignored.  A log is cut at its headers inside the row, so
    the work is linear and nothing is shuffled.
    """
    base = logs.select("repo_id", F.split(content, "\n", -1).alias("_l"))
    heads = F.filter(
        F.transform("_l", lambda x, i: F.when(x.rlike(_HEADER), F.struct(i.alias("at"), x.alias("raw")))),
        lambda h: h.isNotNull(),
    )
    base = base.withColumn("_h", heads)

    def stat(x: Column) -> Column:
        parts = F.split(x, "\t")
        added = F.coalesce(parts[0].try_cast("bigint"), F.lit(0).cast("bigint"))
        return F.when(
            (F.size(parts) >= 3) & (F.length(F.trim(x)) > 0),
            F.struct(F.get(parts, F.lit(2)).alias("path"), added.alias("lines_added")),
        )

    def section(h: Column, k: Column) -> Column:
        stop = F.coalesce(F.get("_h", k + 1)["at"], F.size("_l"))
        body = F.slice("_l", h["at"] + 2, stop - h["at"] - 1)
        return F.struct(
            k.alias("pos"),
            F.regexp_extract(h["raw"], _HEADER, 1).alias("sha"),
            F.timestamp_seconds(F.regexp_extract(h["raw"], _HEADER, 2).cast("bigint")).alias("ts"),
            F.filter(F.transform(body, stat), lambda s: s.isNotNull()).alias("files"),
        )

    return base.select("repo_id", F.inline(F.transform("_h", section)))


def commits_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("repo_id", "sha", "ts", "pos")


def commit_files_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("repo_id", "sha", F.inline("files")).where(F.length("path") > 0)
