"""Registry of the whole-table queries and, where SQL can say it, their equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL twin if there is one."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def stamp(col: str | Column) -> Column:
    """Timestamps leave a query as text, so that both engines print them alike."""
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def day_text(col: str | Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd")
