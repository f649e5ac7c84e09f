"""All queries of the library but those of the subpackage llm, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factlattice import queries_documents, queries_sources  # noqa: F401  (they register their queries)
from factlattice.queries import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["query_fields_gte"](spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
