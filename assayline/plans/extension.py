"""Extension points.

Everything pluggable takes and returns DataFrames, so a plug-in is planned,
shuffled and recovered by Spark like the built-in parts.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Detector(Protocol):
    """Turns files into findings (``schemas.FINDINGS``)."""

    id: str

    def run(self, files: DataFrame, repo_facts: DataFrame | None) -> DataFrame: ...


class FileSignalSource(Protocol):
    """Per-file provenance signals (``schemas.SIGNALS``)."""

    id: str

    def detect(self, files: DataFrame) -> DataFrame: ...


class RepoSignalSource(Protocol):
    """Per-repository prior: ``repo_id, prior``."""

    id: str

    def detect(self, files: DataFrame) -> DataFrame: ...


class Normalizer(Protocol):
    """Turns documents (``doc_id, subject_id, raw``) into observations (``schemas.OBSERVATIONS``)."""

    id: str

    def normalize(self, documents: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Lookups:
    """Facts the reference fetches per package, here tables.  Missing tables mean *unknown*."""

    advisories: DataFrame | None = None
    registry: DataFrame | None = None
    now: Column | None = None

    def at(self) -> Column:
        return F.current_timestamp() if self.now is None else self.now
