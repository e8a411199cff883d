"""Registered queries over the driver's tables, each next to the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query under ``name``; without ``sql`` it is tested against brute force instead."""

    def add(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def load_all() -> None:
    """Import every module that registers queries."""
    from dairyframe.plans import (  # noqa: F401
        alignment,
        characteristics,
        comparison,
        feeds,
        files,
        fits,
        herds,
        joins,
        media,
        models,
        sequences,
        standard,
        yields,
    )
