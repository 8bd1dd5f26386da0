"""Queries of section 2.4: aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..operators import aggregates as agg
from ..operators import resolve
from .registry import query


@query("o120_hub_score", "SELECT def_uid, count(DISTINCT r.file_id) AS hub_score FROM defs LEFT JOIN refs r ON r.target_def_uid = def_uid GROUP BY 1")
def _(f):
    return agg.caller_counts(f.defs, f.refs)


@query("o121_test_count", "SELECT def_uid, count(DISTINCT CASE WHEN NOT stale THEN test_id END) AS test_count FROM defs LEFT JOIN coverage ON target_def_uid = def_uid GROUP BY 1")
def _(f):
    return agg.test_counts(f.defs, f.coverage)


@query("o122_files_by_language", "SELECT language_family, count(*) AS n FROM files GROUP BY 1")
def _(f):
    return f.files.groupBy("language_family").agg(F.count("*").alias("n"))


@query("o123_language_distribution", "SELECT language_family, count(*) AS files, round(100.0 * count(*) / (SELECT count(*) FROM files), 1) AS pct FROM files GROUP BY 1")
def _(f):
    return agg.language_distribution(f.files)


@query("o124_dependency_counts", "SELECT source_literal, count(*) AS uses FROM imports GROUP BY 1 ORDER BY uses DESC, source_literal LIMIT 100")
def _(f):
    return agg.dependency_counts(f.imports)


@query("o125_directory_tree", """
    SELECT split_part(path, '/', 1) AS folder, 1 AS depth, count(*) AS files FROM files GROUP BY 1
    UNION ALL SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), 2, count(*) FROM files GROUP BY 1""")
def _(f):
    return agg.directory_tree(f.files)


@query("o126_coverage_summary", """
    SELECT count(DISTINCT target_def_uid) AS covered_defs, round(avg(line_rate), 6) AS avg_line_rate, CAST(count(*) FILTER (stale) AS BIGINT) AS stale_facts, count(DISTINCT test_id) AS tests FROM coverage""")
def _(f):
    return agg.coverage_summary(f.coverage)


@query("o127_health_snapshot", """
    SELECT (SELECT count(DISTINCT target_def_uid) FROM coverage WHERE NOT stale) AS covered_defs, (SELECT round(avg(line_rate), 6) FROM coverage WHERE NOT stale) AS avg_line_rate,
           (SELECT CAST(sum(error_count) AS BIGINT) FROM lint) AS errors, (SELECT CAST(sum(warning_count) AS BIGINT) FROM lint) AS warnings""")
def _(f):
    a = agg.coverage_summary(f.coverage, include_stale=False).select("covered_defs", "avg_line_rate")
    return a.crossJoin(agg.lint_summary(f.lint).select("errors", "warnings"))  # one row each


@query("o128_lint_summary", """
    SELECT count(DISTINCT file_path) AS files_checked, CAST(sum(error_count) AS BIGINT) AS errors, CAST(sum(warning_count) AS BIGINT) AS warnings,
           CAST(count(*) FILTER (clean) AS BIGINT) AS clean_rows, round(count(*) FILTER (clean) / count(DISTINCT file_path), 6) AS clean_rate FROM lint""")
def _(f):
    return agg.lint_summary(f.lint)


@query("o129_file_lint_status", """
    SELECT file_path, tool_id, error_count, warning_count, epoch FROM (
        SELECT file_path, tool_id, sum(error_count)::BIGINT AS error_count, sum(warning_count)::BIGINT AS warning_count, epoch,
               row_number() OVER (PARTITION BY file_path, tool_id ORDER BY epoch DESC) AS p FROM lint GROUP BY file_path, tool_id, epoch) WHERE p = 1""")
def _(f):
    g = f.lint.groupBy("file_path", "tool_id", "epoch").agg(F.sum("error_count").alias("error_count"), F.sum("warning_count").alias("warning_count"))
    return agg.upsert(g, ["file_path", "tool_id"], "epoch").select("file_path", "tool_id", "error_count", "warning_count", "epoch")


CHANGED = "SELECT path AS file_path FROM files WHERE id IN (1, 2, 4)"


@query("o130_fresh_lint", f"""
    WITH c AS ({CHANGED}), l AS (SELECT file_path, sum(error_count) AS e, sum(warning_count) AS w FROM lint WHERE epoch = 1 GROUP BY 1),
         j AS (SELECT c.file_path, e, w FROM c LEFT JOIN l USING (file_path))
    SELECT bool_and(e IS NOT NULL) AS valid, CASE WHEN bool_and(e IS NOT NULL) THEN CAST(sum(e) AS BIGINT) END AS errors,
           CASE WHEN bool_and(e IS NOT NULL) THEN CAST(sum(w) AS BIGINT) END AS warnings FROM j""")
def _(f):
    return agg.fresh_lint(f.lint, f.files.where("id IN (1, 2, 4)").select(F.col("path").alias("file_path")), 1)


@query("o131_fresh_tests", """
    WITH j AS (SELECT * FROM coverage WHERE target_def_uid IN ('d1', 'd2', 'd3'))
    SELECT coalesce(NOT bool_or(stale), false) AS valid, CASE WHEN NOT bool_or(stale) THEN round(avg(line_rate), 6) END AS avg_line_rate,
           CASE WHEN NOT bool_or(stale) THEN count(DISTINCT test_id) END AS tests FROM j""")
def _(f):
    return agg.fresh_tests(f.coverage, f.defs.where("def_uid IN ('d1', 'd2', 'd3')").select("def_uid"))


LINES = "SELECT 'p' || CAST(l_partkey AS STRING) AS path, l_linenumber + 10 * (l_suppkey % 6) AS line, CAST(l_quantity AS BIGINT) % 3 AS hits FROM lineitem"


def line_cov(f):
    x = f.lineitem
    return x.select(F.concat(F.lit("p"), x.l_partkey.cast("string")).alias("path"), (x.l_linenumber + 10 * (x.l_suppkey % 6)).alias("line"), (x.l_quantity.cast("long") % 3).alias("hits"))


@query("o132_coverage_merge", f"SELECT path, line, max(hits) AS hits FROM ({LINES}) GROUP BY 1, 2")
def _(f):
    return agg.merge_lines(line_cov(f))


@query("o133_coverage_rates", f"""
    SELECT path, count(*) AS lines_found, CAST(count(*) FILTER (hits > 0) AS BIGINT) AS lines_hit, round(count(*) FILTER (hits > 0) / count(*), 6) AS line_rate
    FROM (SELECT path, line, max(hits) AS hits FROM ({LINES}) GROUP BY 1, 2) GROUP BY 1""")
def _(f):
    return agg.coverage_rates(agg.merge_lines(line_cov(f)))


@query("o134_coverage_report", f"""
    SELECT CAST(count(*) AS BIGINT) AS lines_found, CAST(count(*) FILTER (hits > 0) AS BIGINT) AS lines_hit, printf('%.1f%%', 100.0 * count(*) FILTER (hits > 0) / count(*)) AS shown
    FROM (SELECT path, line, max(hits) AS hits FROM ({LINES}) GROUP BY 1, 2)""")
def _(f):
    n, hit = F.count("*"), F.sum((F.col("hits") > 0).cast("long"))
    return agg.merge_lines(line_cov(f)).agg(n.alias("lines_found"), hit.alias("lines_hit"), F.format_string("%.1f%%", 100.0 * hit / n).alias("shown"))


@query("o135_line_islands", f"""
    WITH d AS (SELECT DISTINCT path, line FROM ({LINES}) WHERE hits > 0), r AS (SELECT *, line - row_number() OVER (PARTITION BY path ORDER BY line) AS run FROM d)
    SELECT path, min(line) AS first, max(line) AS last, count(*) AS n FROM r GROUP BY path, run""")
def _(f):
    return agg.islands(line_cov(f).where("hits > 0"))


@query("o135_tolerant_islands", f"""
    WITH d AS (SELECT path, line, bool_or(hits = 0) AS m FROM ({LINES}) GROUP BY 1, 2),
         g AS (SELECT *, lag(m) OVER w AS pm, lag(line) OVER w AS pl FROM d WINDOW w AS (PARTITION BY path ORDER BY line)),
         b AS (SELECT *, CASE WHEN m AND (NOT coalesce(pm, false) OR line - pl - 1 > 2) THEN 1 ELSE 0 END AS b FROM g),
         r AS (SELECT *, sum(b) OVER (PARTITION BY path ORDER BY line) AS run FROM b)
    SELECT path, min(line) AS first, max(line) AS last, count(*) AS n FROM r WHERE m GROUP BY path, run""")
def _(f):
    return agg.tolerant_islands(line_cov(f), F.col("hits") == 0)


@query("o136_anchor_groups", """
    WITH o AS (SELECT *, row_number() OVER (PARTITION BY unit_id, token_text ORDER BY file_id, start_line, ref_id) AS p FROM refs WHERE target_def_uid IS NULL)
    SELECT unit_id, token_text, count(*) AS total_count, array_to_string(list(ref_id ORDER BY p) FILTER (p <= 10), ',') AS exemplars FROM o GROUP BY 1, 2""")
def _(f):
    return agg.anchor_groups(f.refs).select("unit_id", "token_text", "total_count", F.array_join(F.transform("exemplar_ids", lambda x: x.cast("string")), ",").alias("exemplars"))


@query("o137_surface_hash", """
    WITH e AS (SELECT unit_id, name, min(def_uid) AS def_uid FROM defs WHERE kind IN ('class', 'function') GROUP BY 1, 2)
    SELECT unit_id, count(*) AS entries, sha256(string_agg(name || '=' || def_uid, ';' ORDER BY name || '=' || def_uid)) AS surface_hash FROM e GROUP BY 1""")
def _(f):
    return agg.surface_hashes(resolve.export_entries(f.defs))


@query("o138_thunk_mode", """
    SELECT unit_id, source_literal, CASE WHEN bool_and(import_kind = 'wildcard') THEN 'wildcard' WHEN bool_or(alias IS NOT NULL) THEN 'alias_map' ELSE 'explicit' END AS mode,
           count(DISTINCT CASE WHEN import_kind <> 'wildcard' THEN imported_name END) AS names FROM imports GROUP BY 1, 2""")
def _(f):
    return agg.thunk_modes(f.imports)


FILE_CANDIDATES = "SELECT file_id, CAST(end_line - start_line AS DOUBLE) AS score, kind, def_uid, namespace FROM defs"


@query("o141_file_features_train", """
    WITH h AS (SELECT target_def_uid, count(DISTINCT file_id) AS hub FROM refs GROUP BY 1),
         c AS (SELECT d.unit_id, f.path, CAST(end_line - start_line AS DOUBLE) AS score, coalesce(hub, 0) AS hub_score, starts_with(f.path, 'tests/') AS is_test, contains(name, 'ring') AS from_term
               FROM defs d JOIN files f ON f.id = d.file_id LEFT JOIN h ON h.target_def_uid = d.def_uid)
    SELECT unit_id, path, count(*) AS defs, max(score) AS max_score, round(sum(score), 4) AS sum_score, round(avg(score), 6) AS mean_score, max(hub_score) AS max_hub,
           bool_or(is_test) AS any_test, CAST(count(*) FILTER (from_term) AS BIGINT) AS term_hits FROM c GROUP BY 1, 2""")
def _(f):
    hub = agg.caller_counts(f.defs, f.refs)
    c = f.defs.join(hub, "def_uid").join(f.files.select(F.col("id").alias("file_id"), "path"), "file_id")
    c = c.select("unit_id", "path", (F.col("end_line") - F.col("start_line")).cast("double").alias("score"), "hub_score", paths.is_test(F.col("path")).alias("is_test"), F.contains("name", F.lit("ring")).alias("from_term"))
    return agg.file_features(c, ["unit_id", "path"])


@query("o143_def_features", """
    SELECT def_uid, CAST(kind = 'class' AS INTEGER) AS is_class, CAST(kind = 'function' AS INTEGER) AS is_function, CAST(kind = 'method' AS INTEGER) AS is_method,
           end_line - start_line + 1 AS span, CAST(docstring IS NOT NULL AS INTEGER) AS has_doc, CAST(len(string_split(qualified_name, '.')) AS BIGINT) AS depth FROM defs""")
def _(f):
    kinds = [(F.col("kind") == k).cast("int").alias(f"is_{k}") for k in ("class", "function", "method")]
    return f.defs.select("def_uid", *kinds, (F.col("end_line") - F.col("start_line") + 1).alias("span"), F.col("docstring").isNotNull().cast("int").alias("has_doc"), F.size(F.split("qualified_name", r"\.")).cast("long").alias("depth"))


@query("o144_gate_features", """
    WITH r AS (SELECT source, n_chars, 'a/' || lang || '/' || CAST(doc_id % 7 AS STRING) AS path, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, 'a/' || lang || '/' || CAST(doc_id % 7 AS STRING)) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents),
         p AS (SELECT source, path, count(*) / sum(count(*)) OVER (PARTITION BY source) AS p FROM r GROUP BY 1, 2), e AS (SELECT source, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY 1)
    SELECT r.source, max(n) AS candidates, max(n_chars) AS top, max(CASE WHEN r = CAST(floor(n * 0.25) AS BIGINT) + 1 THEN n_chars END) AS p25, max(CASE WHEN r = CAST(floor(n * 0.5) AS BIGINT) + 1 THEN n_chars END) AS p50,
           max(CASE WHEN r = CAST(floor(n * 0.75) AS BIGINT) + 1 THEN n_chars END) AS p75, round(stddev_pop(n_chars), 6) AS std, count(DISTINCT 'a/' || split_part(path, '/', 2)) AS clusters, max(entropy) AS entropy
    FROM r JOIN e USING (source) GROUP BY 1""")
def _(f):
    path = F.concat(F.lit("a/"), "lang", F.lit("/"), (F.col("doc_id") % 7).cast("string"))
    return agg.gate_features(f.documents.select("source", "n_chars", path.alias("path")), "source", "n_chars", "path")


@query("o145_cutoff_features", """
    WITH r AS (SELECT unit_id, def_uid, CAST(end_line - start_line AS DOUBLE) AS s FROM defs),
         g AS (SELECT *, row_number() OVER w AS r, s - lead(s) OVER w AS gap FROM r WINDOW w AS (PARTITION BY unit_id ORDER BY s DESC, def_uid)),
         b AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY gap DESC NULLS LAST, r) AS best FROM g)
    SELECT unit_id, round(max(gap), 6) AS max_gap, max(CASE WHEN best = 1 THEN r END) AS gap_at, round(var_pop(s), 6) AS variance, round(sum(CASE WHEN r <= 10 THEN s END) / sum(s), 6) AS top10_mass
    FROM b GROUP BY 1""")
def _(f):
    d = f.defs.select("unit_id", "def_uid", (F.col("end_line") - F.col("start_line")).cast("double").alias("s"))
    return agg.cutoff_features(d, "unit_id", "s", "def_uid")


@query("o146_repo_features", "SELECT w.worktree_id, count(DISTINCT w.id) AS files, count(d.def_uid) AS defs FROM files w LEFT JOIN defs d ON d.file_id = w.id GROUP BY 1")
def _(f):
    defs = f.defs.groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("n"))
    return f.files.join(defs, "id", "left").groupBy("worktree_id").agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("defs"))


@query("o147_metric_averages", """
    WITH r AS (SELECT lang, CAST(n_chars AS DOUBLE) AS v, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT lang, round(avg(v), 4) AS mean, max(CASE WHEN r = greatest(1, CAST(ceil(n * 0.95) AS BIGINT)) THEN v END) AS p95 FROM r GROUP BY 1""")
def _(f):
    return agg.nearest_rank(f.documents.select("lang", F.col("n_chars").cast("double").alias("v")), "lang", "v")


@query("o148_gate_accuracy", """
    SELECT quality AS expected, CAST(n_chars > 1500 AS INTEGER) AS predicted, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2""")
def _(f):
    j = f.labels.join(f.documents.select("doc_id", "n_chars"), "doc_id")
    return j.groupBy(F.col("quality").alias("expected"), (F.col("n_chars") > 1500).cast("int").alias("predicted")).agg(F.count("*").alias("n"))


@query("o150_domain_edges", """
    WITH c AS (SELECT DISTINCT path FROM files WHERE id % 3 = 0), e AS (SELECT f.path, i.resolved_path FROM imports i JOIN files f ON f.id = i.file_id WHERE i.resolved_path IS NOT NULL)
    SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS from_domain, split_part(resolved_path, '/', 1) || '/' || split_part(resolved_path, '/', 2) AS to_domain, count(*) AS edges
    FROM e WHERE path IN (SELECT path FROM c) AND resolved_path IN (SELECT path FROM c)
      AND split_part(path, '/', 1) || '/' || split_part(path, '/', 2) <> split_part(resolved_path, '/', 1) || '/' || split_part(resolved_path, '/', 2) GROUP BY 1, 2""")
def _(f):
    return agg.domains(f.files.where("id % 3 = 0"), f.imports, f.files)


@query("o151_target_partition", """
    WITH t AS (SELECT s_suppkey AS target_id, CAST(s_nationkey % 5 AS BIGINT) AS runner, CAST(s_suppkey % 4 AS BIGINT) AS workspace, CASE WHEN s_acctbal > 3000 THEN 2.0 ELSE 0.5 END AS estimated_cost FROM supplier)
    SELECT target_id, estimated_cost <= 1.0 AND sum(CASE WHEN estimated_cost <= 1.0 THEN 1 ELSE 0 END) OVER (PARTITION BY runner, workspace) >= 2 AS batched FROM t""")
def _(f):
    t = f.supplier.select(F.col("s_suppkey").alias("target_id"), (F.col("s_nationkey") % 5).alias("runner"), (F.col("s_suppkey") % 4).alias("workspace"), F.when(F.col("s_acctbal") > 3000, 2.0).otherwise(0.5).alias("estimated_cost"))
    return agg.partition_targets(t).select("target_id", "batched")
