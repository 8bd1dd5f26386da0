"""Where the query modules put their entries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .facts import Facts, oracle

ENTRIES: dict[str, tuple[Callable[[Facts], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of Facts under a name, with its DuckDB SQL."""

    def put(f: Callable[[Facts], DataFrame]) -> Callable[[Facts], DataFrame]:
        assert name not in ENTRIES, name
        ENTRIES[name] = f, sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: (lambda spark, sf_dir, f=f: f(Facts(spark, sf_dir))) for k, (f, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: oracle(sql) for k, (_, sql) in ENTRIES.items() if sql}
