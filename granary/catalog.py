"""All queries of the library and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.plans import base, card_plans, model_plans, profile_plans, retrieval_plans, source_plans, stream_plans, text_plans, vote_plans  # noqa: F401  each registers its queries

QUERIES = base.QUERIES
ORACLE = base.ORACLE


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card-aware retrieval: scores, source diversity and redundancy in one plan."""
    return retrieval_plans.card_aware(spark, sf_dir)
