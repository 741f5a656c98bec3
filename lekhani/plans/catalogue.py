"""All queries by name, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lekhani.plans import corpus, enrichment, evaluation, markup, reports, retrieval

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (retrieval, evaluation, corpus, enrichment, markup, reports)


def entry(spark: SparkSession, directory: str) -> DataFrame:
    """The flagship query: the fused ranking of the documents for each question."""
    return retrieval.QUERIES["r08_rrf_top10"](spark, directory)


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
