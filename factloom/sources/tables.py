"""Table files: schema alignment, JSON lines, snapshots of health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def aligned(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """df with just the schema's columns, in order and cast; missing ones are null."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def json_lines(spark: SparkSession, paths: str | list[str], schema: T.StructType | str) -> DataFrame:
    """Rows of JSON-lines files with repo, the name of each file's folder."""
    return spark.read.schema(schema).json(paths).withColumn("repo", F.regexp_extract("_metadata.file_path", "([^/]+)/[^/]+$", 1))


def append_snapshot(df: DataFrame, folder: str) -> None:
    df.write.mode("append").json(folder)


def last_snapshots(spark: SparkSession, folder: str, schema: str, n: int, order: str = "epoch") -> DataFrame:
    return spark.read.schema(schema).json(folder).orderBy(F.col(order).desc()).limit(n)
