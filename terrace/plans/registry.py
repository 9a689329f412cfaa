"""The registered queries of the retrieval and analytics engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrace.plans import index_queries, more_queries, page_queries, routing_queries, rule_queries, vector_queries  # noqa: F401  register their queries
from terrace.plans import queries as registered

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions to cited context: hybrid candidates, penalties, parents, reranking and staged selection."""
    return registered.cited_context(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(registered.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registered.ORACLES)
