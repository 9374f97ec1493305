"""Every operator as a query over the test tables, with the SQL an independent engine answers it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tableproof.fixtures import oracle_text

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use fixture texts with table names in braces."""

    def add(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = oracle_text(sql)
        return build

    return add


def load_all() -> None:
    from tableproof.registry import (  # noqa: F401
        catalogs,
        chains,
        comparisons,
        fingerprints,
        flows,
        names,
        replays,
        retentions,
        streams,
        workflows,
    )
