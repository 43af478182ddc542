"""Every registered query; importing the modules registers them."""

from __future__ import annotations

from cairn.plans import classification, governance, lineage, maintenance, search, sources, streams  # noqa: F401
from cairn.plans.registry import QUERIES, duckdb_sql, spark_queries

__all__ = ["QUERIES", "duckdb_sql", "spark_queries"]
