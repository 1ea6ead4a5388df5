"""Named queries over a driver directory, each paired with an independent DuckDB oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLES[name] -> SQL``. Modules below register
themselves on import; :func:`load_all` imports every one.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

_MODULES = (
    "loading",
    "strategy",
    "quality",
    "last_contact",
    "promise_funnel",
    "bucket_summary",
    "ab_test",
    "feature_mart",
    "evaluation",
    "economics",
    "modelling",
    "scalars",
)


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` (with its oracle SQL when SQL can express it)."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


def load_all() -> None:
    """Import every module above; a missing one is an error."""
    for mod in _MODULES:
        importlib.import_module(f"arrears.catalog.{mod}")
