"""Queries of the library's own operators with their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinelake.plans import audit_queries, pose_queries, stream_queries, table_queries

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return pose_queries.QUERIES | table_queries.QUERIES | audit_queries.QUERIES | stream_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return pose_queries.ORACLE | table_queries.ORACLE | audit_queries.ORACLE | stream_queries.ORACLE
