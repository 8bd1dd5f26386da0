"""Files as tables: a recursive scan of a folder and safe decoding."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import matches_glob

#: Folders that a walk leaves out.
PRUNED = (".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv", ".tox", "dist", "build", "target", ".mypy_cache")


def walk(spark: SparkSession, root: str, ignore: tuple[str, ...] = PRUNED, rules: list[str] | None = None) -> DataFrame:
    """path, size, content of every file below root, without ignored folders.

    rules are lines of an ignore file, read against the path below root: blank
    lines and comments say nothing, a folder's rule holds for all below it, and a
    later rule that begins with an exclamation mark takes files back.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    kept = ~F.col("path").rlike("/(" + "|".join(x.replace(".", r"\.") for x in ignore) + ")/")
    below = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").split("/")[-1]) + "/", "")
    dropped = F.lit(False)
    for line in rules or []:
        rule = line.strip()
        if rule and not rule.startswith("#"):
            pattern = rule.lstrip("!").rstrip("/")
            hit = matches_glob(below, pattern) | matches_glob(below, f"{pattern}/**")
            dropped = F.when(hit, F.lit(not rule.startswith("!"))).otherwise(dropped)
    return found.where(kept & ~dropped).select("path", F.col("length").alias("size"), "content")


def safe_text(raw: DataFrame, column: str = "content") -> DataFrame:
    """Adds text: content decoded as UTF-8; binary (with NUL) or undecodable content gives the empty text."""
    binary = F.contains(F.col(column).cast("string"), F.lit("\0"))
    text = F.try_validate_utf8(F.col(column).cast("string"))
    return raw.withColumn("text", F.when(binary, "").otherwise(F.coalesce(text, F.lit(""))))


def content_hash(column: str = "content") -> Column:
    return F.sha2(F.col(column).cast("binary"), 256)
