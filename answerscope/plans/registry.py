"""Where the registered queries and their oracle SQL are collected."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a (spark, sf_dir) -> DataFrame function, with its SQL twin if there is one."""

    def add(fn: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r6(col):
    """Rounded for comparison across engines, without negative zero."""
    from pyspark.sql import functions as F

    return F.round(col, 6) + F.lit(0.0)
