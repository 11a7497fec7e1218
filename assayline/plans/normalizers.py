"""Formats that plug in from SQL: ``normalize(document, format)``, a table function whose columns follow the format.

    register_normalizers(spark, CYCLONEDX_COMPONENTS, my_format)
    SELECT d.doc_id, n.* FROM docs d, LATERAL normalize(d.raw, 'my-format') n

A format is a name, the columns it gives, and a function from a parsed JSON document to
rows; nested lists and maps of any shape become rows there, one document at a time.  The
format is a constant, so its columns are known when the query is analysed.  A document
that is null, no JSON, or not of the format's shape gives no rows.  Built-in formats stay
columns (``sources/evidence.py``); this is for those that the library does not know.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from assayline.operators.spread import dealt

FUNCTION = "normalize"


@dataclass(frozen=True)
class Format:
    """``rows`` gives tuples in the order of ``columns`` (DDL); ValueError, KeyError, TypeError and AttributeError in it mean *not of this shape*."""

    name: str
    columns: str
    rows: Callable[[Any], Iterator[tuple]]


def _text(value: Any) -> str | None:
    if value is None or isinstance(value, str):
        return value
    raise ValueError(value)


def _cyclonedx_components(doc: Any) -> Iterator[tuple]:
    if doc["bomFormat"] != "CycloneDX":
        raise ValueError("not CycloneDX")
    for c in doc.get("components") or []:
        if c.get("type") is None or (c.get("name") is None and c.get("bom-ref") is None):
            raise ValueError("malformed component")
        hashes = c.get("hashes")
        if any(h.get("alg") is None or h.get("content") is None for h in hashes or []):
            raise ValueError("malformed hash")
        yield _text(c["type"]), _text(c.get("name")), _text(c.get("version")), _text(c.get("bom-ref")), None if hashes is None else [(h["alg"], h["content"]) for h in hashes]


def _detect_secrets(doc: Any) -> Iterator[tuple]:
    if not isinstance(doc["plugins_used"], list) or not isinstance(doc["version"], str):
        raise ValueError("not detect-secrets")
    for path, found in doc["results"].items():
        for x in found:
            yield _text(path), _text(x["type"]), x.get("line_number"), _text(x.get("hashed_secret")), bool(x.get("is_verified", False))


#: The twin of ``sources.evidence.cyclonedx_components``.
CYCLONEDX_COMPONENTS = Format(
    "cyclonedx-components", "type string, name string, version string, bom_ref string, hashes array<struct<alg: string, content: string>>", _cyclonedx_components
)
#: Baselines of a secret scanner: a map from path to a list of findings.
DETECT_SECRETS = Format("detect-secrets", "path string, type string, line bigint, hashed_secret string, verified boolean", _detect_secrets)
BUILT_IN = (CYCLONEDX_COMPONENTS, DETECT_SECRETS)


def normalizer(formats: tuple[Format, ...]) -> type:
    """The table function over some formats."""
    known = {f.name: f for f in formats}
    if len(known) < len(formats):
        raise ValueError("two formats have one name")
    columns = {f.name: StructType.fromDDL(f.columns) for f in formats}

    class Normalize:
        @staticmethod
        def analyze(document: AnalyzeArgument, format: AnalyzeArgument) -> AnalyzeResult:
            if not format.isConstantExpression or format.value not in known:
                raise ValueError(f"format must be one of {sorted(known)}, as a constant")
            if document.dataType.simpleString() not in ("string", "void"):
                raise ValueError("document must be a string")
            return AnalyzeResult(schema=columns[format.value])

        def eval(self, document: str | None, format: str) -> Iterator[tuple]:
            try:
                # All rows before the first is given: a document that breaks off half-way gives none.
                yield from list(known[format].rows(json.loads(document))) if document is not None else []
            except (ValueError, KeyError, TypeError, AttributeError, RecursionError):
                return

    return Normalize


def register_normalizers(spark: SparkSession, *formats: Format, name: str = FUNCTION) -> None:
    """Make ``name(document, format)`` a table function of the session, for the built-in formats and ``formats``."""
    spark.udtf.register(name, F.udtf(normalizer((*BUILT_IN, *formats)), useArrow=False))  # type: ignore[call-overload]


def normalized(docs: DataFrame, format: Format, raw: str = "raw", keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the format's columns for every row that its documents give: the lateral join as a DataFrame.

    Rows go over as pickled tuples: with ``useArrow`` each document would become a pandas frame of its own.
    """
    table = F.udtf(normalizer((format,)), useArrow=False)  # type: ignore[call-overload]
    names = StructType.fromDDL(format.columns).names
    kept = docs.select(*keep, F.col(raw).alias("_raw"))
    # A table function runs where its documents lie: those of one row group would be one task.
    kept = dealt(kept, *[f.name for f in kept.schema if "map<" not in f.dataType.simpleString()])
    out = kept.lateralJoin(table(F.col("_raw").outer(), F.lit(format.name)))
    return out.select(*[c for c in kept.columns if c != "_raw"], *names)
