"""Chunkers of prose, key/value files and paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST, MOST = 30, 2000
#: What begins a chunk, and the group that names it.
HEADING = (r"^#{1,6}\s+(.+)", "preamble")
KEY = (r"^([a-zA-Z_][\w.-]*)\s*[:=]", "header")


def _cut(lines: DataFrame, key: str, begins: Column, name: Column) -> DataFrame:
    """Chunks of (key, i, line): a running count of beginnings numbers them within a document."""
    so_far = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    chunk = lines.withColumn("_chunk", F.sum(begins.cast("int")).over(so_far)).groupBy(key, "_chunk").agg(
        F.min("i").alias("start_line"), F.max("i").alias("end_line"), F.min_by(name, "i").alias("chunk_key"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("_text"),
    )
    text = F.regexp_replace("_text", r"^\s+|\s+$", "")
    chunk = chunk.withColumn("_text", text).where(F.length("_text") >= LEAST)
    return chunk.select(key, "chunk_key", F.substring("_text", 1, MOST).alias("chunk_text"), F.col("start_line").cast("long"), F.col("end_line").cast("long"))


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    # the outer form: for the inner one the optimiser splits each text twice
    found = docs.where(F.col(text).isNotNull()).select(key, F.posexplode_outer(F.split(text, "\n")).alias("_p", "line"))
    return found.select(key, (F.col("_p") + 1).alias("i"), "line")


def by_pattern(docs: DataFrame, key: str, pattern: str, first: str, text: str = "text") -> DataFrame:
    """Chunks that begin at lines with the pattern, named by its group; what stands before is named first."""
    lines = _lines(docs, key, text)
    hit = F.col("line").rlike(pattern)
    name = F.when(hit, F.trim(F.regexp_extract("line", pattern, 1))).otherwise(first)
    return _cut(lines, key, hit, name)


def markdown(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    return by_pattern(docs, key, *HEADING, text)


def key_value(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    return by_pattern(docs, key, *KEY, text)


def paragraphs(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Chunks between double blank lines, numbered in order."""
    lines = _lines(docs, key, text)
    order = Window.partitionBy(key).orderBy("i")
    blank = F.trim("line") == ""
    lines = lines.withColumn("_blank", blank).withColumn("_both", F.col("_blank") & F.coalesce(F.lag("_blank").over(order), F.lit(False)))
    lines = lines.withColumn("_begin", F.coalesce(F.lag("_both").over(order), F.lit(False)) & ~F.col("_both"))
    chunks = _cut(lines, key, F.col("_begin"), F.lit("para"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("start_line")) - 1
    return chunks.withColumn("chunk_key", F.concat(F.lit("para_"), number.cast("string")))
