"""All registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import evaluation_queries, graph_queries, item_queries, text_queries, tool_queries

_MODULES = (graph_queries, text_queries, evaluation_queries, item_queries, tool_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_queries.bm25_topk(spark, sf_dir)
