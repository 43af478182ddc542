"""Name to query and name to SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cairn.plans.fixtures import Inputs, oracle


@dataclass(frozen=True)
class Query:
    build: Callable[[Inputs], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, uses: list[str] | None = None):
    """Register a query; `uses` names the projections its SQL reads."""

    def add(build: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(build, oracle(sql, uses or []) if sql else None)
        return build

    return add


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: (lambda spark, sf_dir, q=q: q.build(Inputs(spark, sf_dir))) for n, q in QUERIES.items()}


def duckdb_sql() -> dict[str, str]:
    return {n: q.sql for n, q in QUERIES.items() if q.sql}
