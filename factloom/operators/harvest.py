"""Routing of files to contexts, and harvesters that turn task fields into candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import SOURCES, priority


def route_files(files: DataFrame, contexts: DataFrame) -> DataFrame:
    """path, context_id: the deepest root of a context that holds the file, lower tier first; the empty root takes the rest.

    Each folder above a file is a key, so this is an equality join.
    """
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    above = files.select("path", F.explode(folders).alias("root_path"))
    met = above.join(contexts, "root_path")
    return met.groupBy("path").agg(F.min_by("context_id", F.struct("tier", -F.length("root_path"), F.col("context_id"))).alias("context_id"))


def explicit(seeds: DataFrame, mentioned: DataFrame, symbols: DataFrame, defs: DataFrame, files: DataFrame) -> DataFrame:
    """def_uid, source: definitions given as seeds (def_uid), in mentioned files (path), or named as symbols (name), by the best source."""
    known = defs.select("def_uid")
    a = known.join(seeds.select("def_uid").distinct(), "def_uid", "left_semi").withColumn("source", F.lit("agent_seed"))
    at = files.join(mentioned.select("path").distinct(), "path", "left_semi").select(F.col("id").alias("file_id"))
    b = defs.join(at, "file_id", "left_semi").select("def_uid").withColumn("source", F.lit("path_mention"))
    c = defs.join(symbols.select("name").distinct(), "name", "left_semi").select("def_uid").withColumn("source", F.lit("task_extracted"))
    every = a.unionByName(b).unionByName(c)
    return every.groupBy("def_uid").agg(F.min_by("source", priority(F.col("source"), SOURCES)).alias("source"))


def with_scaffolds(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """candidates with their stored scaffold, else one of kind and name."""
    return candidates.join(stored.select("def_uid", "scaffold"), "def_uid", "left").withColumn("scaffold", F.coalesce("scaffold", F.concat_ws(" ", "kind", "name")))
