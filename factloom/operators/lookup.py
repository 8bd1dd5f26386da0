"""Point and batch look-ups, equality scans and pages over the fact tables.

Every limited scan has a total order, so that a limit means the same rows on
any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Key lists of up to so many keys go into the predicate, which the scan evaluates; longer ones are joined.
IN_LIST = 1000


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    """Rows with one key; the predicate reaches the scan."""
    return df.where(F.col(key) == value)


def by_keys(df: DataFrame, key: str, values: list | DataFrame) -> DataFrame:
    """Rows with any of the keys; missing keys give no row."""
    if isinstance(values, DataFrame):
        return df.join(values.select(key).distinct(), key, "left_semi")
    if len(values) <= IN_LIST:
        return df.where(F.col(key).isin(list(values)))
    keys = df.sparkSession.createDataFrame([(v,) for v in values], f"{key} {dict(df.dtypes)[key]}")
    return df.join(keys.distinct(), key, "left_semi")


def scan(df: DataFrame, order: list, limit: int | None = None, offset: int = 0, **equals) -> DataFrame:
    """Rows that equal the given columns (None is null), in order, after offset, up to limit."""
    for k, v in equals.items():
        df = df.where(F.col(k).eqNullSafe(F.lit(v)))
    df = df.orderBy(*order)
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def indexed_files(files: DataFrame, language: str | None = None, prefix: str | None = None) -> DataFrame:
    if language is not None:
        files = files.where(F.col("language_family") == language)
    return files if prefix is None else files.where(F.col("path").startswith(prefix))


def freshness(files: DataFrame) -> DataFrame:
    """Adds state: unindexed files were never indexed, clean ones have a content hash, others are uncertain."""
    state = F.when(F.col("indexed_at").isNull(), "unindexed").when(F.col("content_hash").isNotNull(), "clean").otherwise("uncertain")
    return files.withColumn("state", state)


def mutation_gate(files: DataFrame) -> DataFrame:
    """How many files may be changed, need a decision or are blocked."""
    gate = F.when(F.col("state") == "clean", "allowed").when(F.col("state") == "uncertain", "needs_decision").otherwise("blocked")
    return files.groupBy(gate.alias("gate")).agg(F.count("*").alias("files"))


def entry_points(defs: DataFrame, files: DataFrame, kinds: list[str], names: list[str], basename: Column) -> DataFrame:
    """Definitions of the kinds with a telling name, or in a main file; each once."""
    named = defs.where(F.col("kind").isin(kinds) & F.col("name").isin(names))
    mains = files.where(basename).select(F.col("id").alias("file_id"))
    return named.unionByName(defs.where(F.col("kind").isin(kinds)).join(mains, "file_id", "left_semi").select(defs.columns)).dropDuplicates(["def_uid"])
