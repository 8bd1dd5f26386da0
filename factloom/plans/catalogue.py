"""The engine's queries over the driver's tables, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import q_aggregates, q_graph, q_harvest, q_impact, q_incremental, q_joins, q_lookup, q_models, q_ranking, q_search, q_sources, q_text, registry  # noqa: F401
from .facts import Facts


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_search.bm25_files(Facts(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return registry.queries()


def oracle_sql() -> dict[str, str]:
    return registry.oracle_sql()
