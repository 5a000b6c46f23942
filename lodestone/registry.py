"""All queries of the engine by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans.queries import QUERIES, SQL, hit_enrichment

__all__ = ["QUERIES", "SQL", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of five queries with their documents."""
    return hit_enrichment(spark, sf_dir)
