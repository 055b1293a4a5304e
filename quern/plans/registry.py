"""Collects queries and their SQL restatements."""

from __future__ import annotations

from collections.abc import Callable
from textwrap import dedent

from pyspark.sql import DataFrame, SparkSession

from quern.session import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, directory: fn(Tables(spark, directory))
        if sql is not None:
            SQL[name] = dedent(sql).strip()
        return fn

    return register


def u_sql(seed: int, purpose: str, *keys: str) -> str:
    """SQL text of :func:`quern.functions.draws.uniform`."""
    return f"((('0x' || substr({d_sql(seed, purpose, *keys)}, 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"


def d_sql(seed: int, purpose: str, *keys: str) -> str:
    parts = ", ".join(f"({k})::VARCHAR" for k in keys)
    return f"sha256(concat_ws('|', '{seed}', '{purpose}', {parts}))"
