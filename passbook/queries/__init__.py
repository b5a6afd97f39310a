"""Registered queries: each operator over whole tables, with its SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from passbook.sources.star import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``{view}`` names in ``sql`` get their definitions in front."""

    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_views(sql)
        return run

    return add


def load() -> None:
    """Import the modules that register queries."""
    from passbook.queries import (  # noqa: F401
        classify,
        curate,
        files,
        ingest,
        lookups,
        rules,
        search,
        text,
    )
