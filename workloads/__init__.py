"""Queries that bind the library to the driver's tables, each with its SQL twin.

One module per stage.  A query is a function ``(spark, sf_dir) -> DataFrame``
registered under a descriptive name; its oracle is DuckDB SQL over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def load_all() -> None:
    """Import every workload module once so that the registry is complete."""
    import importlib
    import pkgutil

    for info in pkgutil.iter_modules(__path__):
        if info.name not in ("bindings",):
            importlib.import_module(f"{__name__}.{info.name}")
