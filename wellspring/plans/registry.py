"""Query registry: name, Spark callable, SQL text, inventory ids covered."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from wellspring.plans.fixtures import Fixtures
from wellspring.plans.sql_views import compose


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[Fixtures], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None):
    """Register ``fn(fixtures) -> DataFrame`` under its own name."""

    def register(fn):
        QUERIES[fn.__name__] = Query(fn.__name__, tuple(covers.split()), fn, compose(sql) if sql else None)
        return fn

    return register


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(q: Query):
        return lambda spark, sf_dir: q.build(Fixtures(spark, sf_dir))

    return {name: bind(q) for name, q in QUERIES.items()}


def sql_texts() -> dict[str, str]:
    return {name: q.sql for name, q in QUERIES.items() if q.sql}
