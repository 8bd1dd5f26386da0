"""Structural diff, rename pairing, file reconciliation, worktree remerge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def reconcile(known: DataFrame, found: DataFrame) -> DataFrame:
    """path, change: added, modified, removed or unchanged, by content hash."""
    a, b = known.select("path", F.col("content_hash").alias("_a"), F.lit(True).alias("_ka")), found.select("path", F.col("content_hash").alias("_b"), F.lit(True).alias("_kb"))
    change = F.when(F.col("_ka").isNull(), "added").when(F.col("_kb").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("modified")
    return a.join(b, "path", "full_outer").select("path", change.alias("change"))


def last_of(snapshot: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last of duplicates of a key."""
    rest = [c for c in snapshot.columns if c not in keys]
    return snapshot.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def structural_diff(base: DataFrame, target: DataFrame, hunks: DataFrame | None = None) -> DataFrame:
    """Changes between two snapshots (path, kind, lexical_path, name, signature_hash, display_name, start_line, end_line).

    Identity is path, kind and lexical path. Without hunks an unchanged
    signature counts as a changed body; with them (path, hunks) only if lines
    overlap. Removed and added symbols of one kind and signature pair as
    renames, in the order of their places.
    """
    keys = ["path", "kind", "lexical_path"]
    order = ["start_line", "end_line", "signature_hash"]
    rest = ["name", "signature_hash", "display_name", "start_line", "end_line"]
    a = last_of(base.select(*keys, *rest), keys, order)
    b = last_of(target.select(*keys, *rest), keys, order)
    a = a.select(*keys, F.struct(*rest).alias("old"))
    b = b.select(*keys, F.struct(*rest).alias("new"))
    met = a.join(b, keys, "full_outer")
    removed, added = met.where("new IS NULL"), met.where("old IS NULL")
    place = lambda side: F.row_number().over(Window.partitionBy("path", "kind", f"{side}.signature_hash").orderBy(f"{side}.start_line", "lexical_path"))
    gone = removed.select("path", "kind", F.col("lexical_path").alias("old_path"), "old", F.col("old.signature_hash").alias("_s"), place("old").alias("_p"))
    come = added.select("path", "kind", "lexical_path", "new", F.col("new.signature_hash").alias("_s"), place("new").alias("_p"))
    pairs = gone.join(come, ["path", "kind", "_s", "_p"], "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("renamed")
    moved = pairs.select("path", "kind", F.coalesce("lexical_path", "old_path").alias("lexical_path"), change.alias("change"), F.when(F.col("new").isNotNull(), F.col("old_path")).alias("old_path"), "old", "new", F.lit(None).cast("long").alias("lines_changed"))
    both = met.where("old IS NOT NULL AND new IS NOT NULL")
    if hunks is None:
        both = both.withColumn("lines_changed", F.lit(None).cast("long")).withColumn("_touched", F.lit(True))
    else:
        both = both.join(hunks, "path", "left").withColumn("lines_changed", text.overlap(F.col("new.start_line"), F.col("new.end_line"), F.col("hunks")))
        both = both.withColumn("_touched", F.col("lines_changed").isNotNull())
    changed = ~F.col("old.signature_hash").eqNullSafe(F.col("new.signature_hash"))
    kept = both.where(changed | F.col("_touched")).select(*keys, F.when(changed, "signature_changed").otherwise("body_changed").alias("change"), F.lit(None).cast("string").alias("old_path"), "old", "new", F.col("lines_changed").cast("long"))
    every = moved.unionByName(kept.select(*moved.columns))
    return every.withColumn("tags", text.delta_tags(F.col("change"), F.col("old.display_name"), F.col("new.display_name"), F.col("lines_changed")))


def summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change").agg(F.count("*").alias("n"))


def nested(changes: DataFrame) -> DataFrame:
    """class path, methods changed below it."""
    parent = F.regexp_extract("lexical_path", r"^(.*)\.[^.]+$", 1)
    return changes.where(parent != "").groupBy("path", parent.alias("parent")).agg(F.count("*").alias("methods"))


def enrich(changes: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """changes with references and risk."""
    joined = changes.join(counts, key, "left").withColumn("refs", F.coalesce("refs", F.lit(0)))
    return joined.withColumn("risk", text.behaviour_risk(F.col("change"), F.col("refs")))


def remerge(source: DataFrame, target: DataFrame) -> DataFrame:
    """path, action: keep what is alike, clone what the source has anew or other, prune what it lacks."""
    change = reconcile(target, source)
    return change.select("path", F.when(F.col("change") == "unchanged", "keep").when(F.col("change") == "removed", "prune").otherwise("clone").alias("action"))


def internal_variables(snapshot: DataFrame) -> DataFrame:
    """Variables that begin within a function or method of their file."""
    from .joins import contained

    variables = snapshot.where("kind = 'variable'").select("def_uid", "file_id", F.col("start_line").alias("_line"))
    functions = snapshot.where("kind IN ('function', 'method')").select("file_id", "start_line", "end_line")
    return contained(variables, "_line", functions, ["file_id"]).select("def_uid").distinct()
