"""Counts, summaries, coverage and lint aggregates, islands, anchor groups, candidate features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths


def zero_filled(keys: DataFrame, counts: DataFrame, key: str, columns: list[str]) -> DataFrame:
    joined = keys.join(counts, key, "left")
    return joined.select(*keys.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in columns])


def caller_counts(defs: DataFrame, refs: DataFrame) -> DataFrame:
    """def_uid, hub_score: distinct files that refer to each definition, 0 without any."""
    n = refs.where(F.col("target_def_uid").isNotNull()).groupBy(F.col("target_def_uid").alias("def_uid")).agg(F.countDistinct("file_id").alias("hub_score"))
    return zero_filled(defs.select("def_uid"), n, "def_uid", ["hub_score"])


def test_counts(defs: DataFrame, coverage: DataFrame) -> DataFrame:
    n = coverage.where(~F.col("stale")).groupBy(F.col("target_def_uid").alias("def_uid")).agg(F.countDistinct("test_id").alias("test_count"))
    return zero_filled(defs.select("def_uid"), n, "def_uid", ["test_count"])


def language_distribution(files: DataFrame) -> DataFrame:
    n = files.groupBy("language_family").agg(F.count("*").alias("files"))
    share = F.round(100.0 * F.col("files") / F.sum("files").over(Window.partitionBy(F.lit(1))), 1)  # one row a language
    return n.withColumn("pct", share)


def dependency_counts(imports: DataFrame, limit: int = 100) -> DataFrame:
    n = imports.groupBy("source_literal").agg(F.count("*").alias("uses"))
    return n.orderBy(F.col("uses").desc(), "source_literal").limit(limit)


def directory_tree(files: DataFrame, depth: int = 3) -> DataFrame:
    """folder, depth, files: files below each folder, down to depth."""
    parts = F.split(F.regexp_replace("path", "/[^/]*$", ""), "/")
    n = F.least(F.size(parts), F.lit(depth))
    folders = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("folder"), i.alias("depth")))
    return files.where(F.contains("path", F.lit("/"))).select(F.explode(folders).alias("x")).groupBy("x.folder", "x.depth").agg(F.count("*").alias("files"))


def coverage_summary(coverage: DataFrame, include_stale: bool = True) -> DataFrame:
    facts = coverage if include_stale else coverage.where(~F.col("stale"))
    return facts.agg(
        F.countDistinct("target_def_uid").alias("covered_defs"), F.round(F.avg("line_rate"), 6).alias("avg_line_rate"), F.sum(F.col("stale").cast("long")).alias("stale_facts"),
        F.countDistinct("test_id").alias("tests"),
    )


def lint_summary(lint: DataFrame) -> DataFrame:
    clean = F.sum(F.col("clean").cast("long"))
    files = F.countDistinct("file_path")
    return lint.agg(
        files.alias("files_checked"), F.sum("error_count").alias("errors"), F.sum("warning_count").alias("warnings"), clean.alias("clean_rows"),
        F.round(F.when(files > 0, clean / files).otherwise(0.0), 6).alias("clean_rate"),
    )


def upsert(rows: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """One row a key, with the greatest value of newest."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), newest).alias("_r")).select(*keys, "_r.*")


def fresh_lint(lint: DataFrame, changed: DataFrame, epoch: int) -> DataFrame:
    """Whether every changed file has a row of the epoch, and the sums if so (else null)."""
    now = lint.where(F.col("epoch") == epoch).groupBy("file_path").agg(F.sum("error_count").alias("e"), F.sum("warning_count").alias("w"))
    joined = changed.select("file_path").distinct().join(now, "file_path", "left")
    valid = F.coalesce(F.bool_and(F.col("e").isNotNull()), F.lit(False))
    return joined.agg(valid.alias("valid"), F.when(valid, F.sum("e")).alias("errors"), F.when(valid, F.sum("w")).alias("warnings"))


def fresh_tests(coverage: DataFrame, changed: DataFrame) -> DataFrame:
    """Rate and tests of the changed definitions; null if any fact is stale or there is none."""
    facts = coverage.join(changed.select(F.col("def_uid").alias("target_def_uid")).distinct(), "target_def_uid", "left_semi")
    valid = F.coalesce(~F.bool_or("stale"), F.lit(False))
    return facts.agg(valid.alias("valid"), F.when(valid, F.round(F.avg("line_rate"), 6)).alias("avg_line_rate"), F.when(valid, F.countDistinct("test_id")).alias("tests"))


def merge_lines(lines: DataFrame, key: tuple[str, ...] = ("path", "line")) -> DataFrame:
    """Reports merged by the most hits."""
    return lines.groupBy(*key).agg(F.max("hits").alias("hits"))


def coverage_rates(lines: DataFrame, by: str = "path") -> DataFrame:
    found, hit = F.count("*"), F.sum((F.col("hits") > 0).cast("long"))
    return lines.groupBy(by).agg(found.alias("lines_found"), hit.alias("lines_hit"), F.round(F.when(found > 0, hit / found).otherwise(0.0), 6).alias("line_rate"))


def islands(lines: DataFrame, key: str = "path", line: str = "line") -> DataFrame:
    """Runs of consecutive lines: key, first, last, n."""
    distinct = lines.select(key, line).distinct()
    run = F.col(line) - F.row_number().over(Window.partitionBy(key).orderBy(line))
    return distinct.withColumn("_run", run).groupBy(key, "_run").agg(F.min(line).alias("first"), F.max(line).alias("last"), F.count("*").alias("n")).drop("_run")


def tolerant_islands(lines: DataFrame, missed: Column, key: str = "path", line: str = "line", gap: int = 2) -> DataFrame:
    """Runs of missed lines; up to gap lines that the report doesn't have may lie between two, a covered line may not."""
    distinct = lines.groupBy(key, line).agg(F.max(missed).alias("_m"))
    order = Window.partitionBy(key).orderBy(line)
    begin = ~F.coalesce(F.lag("_m").over(order), F.lit(False)) | (F.col(line) - F.lag(line).over(order) - 1 > gap)
    marked = distinct.withColumn("_run", F.sum((F.col("_m") & begin).cast("long")).over(order)).where("_m")
    return marked.groupBy(key, "_run").agg(F.min(line).alias("first"), F.max(line).alias("last"), F.count("*").alias("n")).drop("_run")


def anchor_groups(refs: DataFrame, exemplars: int = 10) -> DataFrame:
    """Unresolved references by (unit, token): count and the first exemplars by position.

    Only each group's first rows are collected, found with a ranking window.
    """
    open_ = refs.where(F.col("target_def_uid").isNull())
    n = open_.groupBy("unit_id", "token_text").agg(F.count("*").alias("total_count"))
    place = F.row_number().over(Window.partitionBy("unit_id", "token_text").orderBy("file_id", "start_line", "ref_id"))
    first = open_.withColumn("_p", place).where(F.col("_p") <= exemplars).groupBy("unit_id", "token_text").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_p", "ref_id"))), lambda x: x["ref_id"]).alias("exemplar_ids")
    )
    return n.join(first, ["unit_id", "token_text"])


def surface_hashes(entries: DataFrame) -> DataFrame:
    """unit_id, entries, surface_hash of the sorted names and uids of a unit."""
    row = F.concat_ws("=", "exported_name", "def_uid")
    return entries.groupBy("unit_id").agg(F.count("*").alias("entries"), F.sha2(F.array_join(F.array_sort(F.collect_list(row)), ";"), 256).alias("surface_hash"))


def thunk_modes(imports: DataFrame) -> DataFrame:
    """Mode of each (source unit, module): wildcard only, alias map, or explicit names."""
    wild = F.col("import_kind") == "wildcard"
    g = imports.groupBy("unit_id", "source_literal").agg(
        F.bool_and(wild).alias("_all"), F.bool_or(F.col("alias").isNotNull()).alias("_any"), F.countDistinct(F.when(~wild, F.col("imported_name"))).alias("names")
    )
    return g.select("unit_id", "source_literal", F.when(F.col("_all"), "wildcard").when(F.col("_any"), "alias_map").otherwise("explicit").alias("mode"), "names")


def entropy(df: DataFrame, group: str, category: str) -> DataFrame:
    """Natural-log entropy of the categories of each group."""
    n = df.groupBy(group, category).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(group))
    return n.withColumn("_p", p).groupBy(group).agg(F.round(-F.sum(F.col("_p") * F.log("_p")), 6).alias("entropy"), F.count("*").alias("categories"))


def gate_features(df: DataFrame, group: str, value: str, path: str) -> DataFrame:
    """Order statistics (index form), deviation, entropy of paths and depth-2 clusters of a group's candidates.

    Order statistics come from a ranking window, not from collected lists.
    """
    w = Window.partitionBy(group)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(F.col(value).desc(), path))).withColumn("_n", F.count("*").over(w))

    def at(p: float) -> Column:
        return F.max(F.when(F.col("_r") == F.floor(F.col("_n") * p).cast("int") + 1, F.col(value)))

    cluster = F.array_join(F.slice(F.split(path, "/"), 1, 2), "/")
    stats = ranked.groupBy(group).agg(
        F.max("_n").alias("candidates"), F.max(value).alias("top"), at(0.25).alias("p25"), at(0.5).alias("p50"), at(0.75).alias("p75"),
        F.round(F.stddev_pop(value), 6).alias("std"), F.countDistinct(cluster).alias("clusters"),
    )
    return stats.join(entropy(df, group, path).select(group, "entropy"), group)


def cutoff_features(df: DataFrame, group: str, score: str, tie: str) -> DataFrame:
    """Largest gap and its place, variance and share of the top ten of a ranked list."""
    order = Window.partitionBy(group).orderBy(F.col(score).desc(), tie)
    ranked = df.withColumn("_r", F.row_number().over(order)).withColumn("_gap", F.col(score) - F.lead(score).over(order))
    return ranked.groupBy(group).agg(
        F.round(F.max("_gap"), 6).alias("max_gap"), F.min_by("_r", F.struct(-F.coalesce("_gap", F.lit(float("-inf"))), F.col("_r"))).cast("long").alias("gap_at"), F.round(F.var_pop(score), 6).alias("variance"),
        F.round(F.sum(F.when(F.col("_r") <= 10, F.col(score))) / F.sum(score), 6).alias("top10_mass"),
    )


def file_features(df: DataFrame, keys: list[str]) -> DataFrame:
    """Candidate columns by file: max, sum, mean, any, count; the same for training and serving."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("defs"), F.max("score").alias("max_score"), F.round(F.sum("score"), 4).alias("sum_score"), F.round(F.avg("score"), 6).alias("mean_score"),
        F.max("hub_score").alias("max_hub"), F.bool_or("is_test").alias("any_test"), F.sum(F.col("from_term").cast("long")).alias("term_hits"),
    )


def nearest_rank(df: DataFrame, group: str, value: str, share: float = 0.95) -> DataFrame:
    """Mean, and the value at place ceil(share * n) in ascending order."""
    w = Window.partitionBy(group)
    r = df.withColumn("_r", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count("*").over(w))
    return r.groupBy(group).agg(F.round(F.avg(value), 4).alias("mean"), F.max(F.when(F.col("_r") == F.greatest(F.lit(1), F.ceil(F.col("_n") * share)), F.col(value))).alias("p95"))


def folder_of(path: Column, depth: int = 2) -> Column:
    return F.array_join(F.slice(F.split(path, "/"), 1, depth), "/")


def domains(changes: DataFrame, imports: DataFrame, files: DataFrame, depth: int = 2) -> DataFrame:
    """Imports between the folders of changed files: from_domain, to_domain, edges."""
    changed = changes.select("path").distinct()
    edges = imports.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").where(F.col("resolved_path").isNotNull())
    edges = edges.join(changed, "path", "left_semi").join(changed.withColumnRenamed("path", "resolved_path"), "resolved_path", "left_semi")
    a, b = folder_of(F.col("path"), depth), folder_of(F.col("resolved_path"), depth)
    return edges.where(a != b).groupBy(a.alias("from_domain"), b.alias("to_domain")).agg(F.count("*").alias("edges"))


def partition_targets(targets: DataFrame, low: float = 1.0) -> DataFrame:
    """Adds batched: cheap targets of a runner and workspace go in one batch if there are two or more."""
    cheap = F.col("estimated_cost") <= low
    n = F.sum(cheap.cast("int")).over(Window.partitionBy("runner", "workspace"))
    return targets.withColumn("batched", cheap & (n >= 2))


def code_class(path: Column) -> Column:
    return paths.artifact(path)
