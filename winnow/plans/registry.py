"""Named queries over the driver tables, each next to the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    operators: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, operators: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``operators`` lists inventory ids."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, tuple(operators.split()), fn, sql)
        return fn

    return wrap
