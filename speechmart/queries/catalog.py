"""All registered queries over the test tables, each with its SQL twin where it has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from speechmart.queries import align_queries, curation_queries, source_queries, stream_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]
_PARTS = (text_queries, align_queries, curation_queries, stream_queries, source_queries)


def queries() -> dict[str, Query]:
    """Name to query."""
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
