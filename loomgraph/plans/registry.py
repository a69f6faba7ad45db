"""All queries outside the llm subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.plans import consolidation, general, graph, graph_sql, service

FLAGSHIP = "recall_batch_rank"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**general.QUERIES, **graph.QUERIES, **consolidation.QUERIES, **service.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**general.ORACLE, **graph_sql.ORACLE, **consolidation.ORACLE, **service.ORACLE}
