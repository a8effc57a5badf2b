"""Named queries over the given tables, each with the survey rows it covers and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    rows: tuple[str, ...]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(rows: str, sql: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its own name."""

    def add(fn):
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = Query(key, fn, tuple(rows.split()), sql)
        return fn

    return add
