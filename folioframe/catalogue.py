"""The registered queries: name -> callable(spark, sf_dir), and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import document_queries, fold_queries, geometry_queries, layout_queries, operator_queries, pdf_feature_queries, pdf_queries, scoring_queries, vision_queries  # noqa: F401  they register
from .registry import ORACLES, QUERIES  # noqa: F401


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring_queries.scoring_rollup(spark, sf_dir)
