"""One operator = one Spark query + (when SQL can express it) one DuckDB
oracle.  Query modules register themselves here."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    fn: QueryFn
    sql: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        from tracefold.plans.fmt import sql_r6
        REGISTRY[name] = Query(name, fn, sql_r6(sql) if sql else None)
        return fn
    return deco
