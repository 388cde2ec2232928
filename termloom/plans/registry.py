"""Registered queries with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from termloom.plans import format_queries, index_queries, retrieval_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (*index_queries.QUERIES, *format_queries.QUERIES, *retrieval_queries.QUERIES)}


def oracle_sql() -> dict[str, str]:
    return {**index_queries.ORACLES, **format_queries.ORACLES, **retrieval_queries.ORACLES}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["dirichlet_topk"](spark, sf_dir)
