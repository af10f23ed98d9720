"""Name -> (Spark query, SQL twin)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workload.feeds import Feeds, feeds
from workload.sqlkit import build

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the feeds under ``name``; ``sql`` is its twin."""

    def add(fn: Callable[[Feeds], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(feeds(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = build(sql)
        return fn

    return add
