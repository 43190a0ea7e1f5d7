"""Registry of the named queries (``q_*``) and their DuckDB oracles.

A query is a function ``(spark, sf_dir) -> DataFrame``.  Its oracle is an
ANSI SQL text for DuckDB over the same parquet tables: the derived views it
reads are inlined as CTEs, followed by ``oracle`` (the query proper).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import oracle_with

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    fn: QueryFn
    views: tuple[str, ...]
    oracle: str | None
    ops: str  # SURVEY operator ids covered

    def oracle_sql(self) -> str | None:
        if self.oracle is None:
            return None
        body = self.oracle.strip()
        return (oracle_with(*self.views) + body) if self.views else body


REGISTRY: dict[str, Query] = {}


def query(name: str, *, ops: str, views: tuple[str, ...] = (), oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, tuple(views), oracle, ops)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # importing the modules registers their queries
    from . import (  # noqa: F401
        q_reports, q_scoring, q_joins, q_text, q_patch, q_dialog, q_rollout,
        q_misc, q_stream, q_sinks, q_sources,
    )
    return REGISTRY
