"""The table of queries and their SQL, and how a query is put into it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isobath.sources.views import block_table, duck, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

Tables = Callable[[str], DataFrame]


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable:
    """Register a function of a table reader as a query, with the SQL that gives its rows over the named views."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: block_table(spark, sf_dir) if t == "pixel_blocks" else table(spark, sf_dir, t))
        if sql:
            SQL[name] = duck(sql, *views)
        return f

    return add


def r6(x: Column, name: str) -> Column:
    return F.round(x, 6).alias(name)
