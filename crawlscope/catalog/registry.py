"""Named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crawlscope.catalog.fixtures import duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(spark, sf_dir)`; `sql` may name tables and projections in braces."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = duck(sql)
        return fn

    return add
