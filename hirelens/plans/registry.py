"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def _utc(fn: Builder) -> Builder:
    """Driver timestamps are TIMESTAMP_NTZ holding UTC wall time; every age /
    retention computation reads them as UTC, so the session zone is pinned."""
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)
    return run


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = _utc(fn)
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module so its registrations run."""
    import importlib

    for mod in MODULES:
        importlib.import_module(f"{__package__}.{mod}")


MODULES = ["q_search", "q_facets", "q_merge", "q_trends", "q_sources", "q_lookup", "q_geo", "q_text", "q_chunks", "q_stream", "q_run"]
