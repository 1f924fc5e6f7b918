"""Register of queries and of the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def r6(value) -> Column:
    """Six decimals, so that the order of summation does not show."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value, 6)


def day(value) -> Column:
    return F.date_format(value, "yyyy-MM-dd")


def stamp(value) -> Column:
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def joined(items, pair: tuple[str, str] | None = None) -> Column:
    """A list as text."""
    if pair is None:
        return F.array_join(F.transform(items, lambda x: x.cast("string")), ",")
    a, b = pair
    return F.array_join(
        F.transform(items, lambda x: F.concat(x[a], F.lit("="), x[b].cast("string"))), ";"
    )
