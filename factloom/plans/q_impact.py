"""Queries of section 2.3 and 2.10: affected tests, blast radius, harvesting, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, impact, joins
from .registry import query

FRESH = "SELECT DISTINCT target_def_uid AS def_uid, test_id FROM coverage WHERE NOT stale"
EDGES = "SELECT DISTINCT f.path AS src, i.resolved_path AS dst FROM imports i JOIN files f ON f.id = i.file_id WHERE i.resolved_path IS NOT NULL AND f.path <> i.resolved_path"


def changed_files(f):
    return f.files.where("id IN (1, 2, 3, 5)").select("path")


@query("o067_reverse_imports", """
    WITH m AS (SELECT declared_module AS module FROM files WHERE id IN (1, 2, 3, 5)), u AS (SELECT f.path, i.source_literal AS s FROM imports i JOIN files f ON f.id = i.file_id)
    SELECT DISTINCT path, module, CASE WHEN s = module THEN 'exact' WHEN starts_with(module, s || '.') THEN 'parent' ELSE 'child' END AS match
    FROM u JOIN m ON s = module OR starts_with(module, s || '.') OR starts_with(s, module || '.')""")
def _(f):
    return impact.direct_importers(changed_files(f), f.imports, f.files)


@query("o068_transitive_importers", f"""
    WITH RECURSIVE e AS ({EDGES}), r AS (SELECT path, 0 AS hop FROM files WHERE id IN (1, 2, 3, 5)
        UNION SELECT e.src, hop + 1 FROM r JOIN e ON e.dst = r.path WHERE hop < 5 AND (hop = 0 OR NOT starts_with(r.path, 'tests/')))
    SELECT path, min(hop) AS hop FROM r GROUP BY 1 HAVING min(hop) > 0""")
def _(f):
    from ..operators import graph

    return impact.transitive_importers(changed_files(f), graph.file_edges(f.files, f.imports), checkpoint=graph.cut)


@query("o069_same_folder_tests", """
    WITH c AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS d FROM files WHERE id IN (7, 14, 21, 28)), t AS (SELECT path AS test, regexp_replace(path, '/[^/]*$', '') AS d FROM files WHERE starts_with(path, 'tests/'))
    SELECT path, test FROM c JOIN t USING (d)""")
def _(f):
    return impact.same_folder_tests(f.files.where("id IN (7, 14, 21, 28)"), f.files)


@query("o070_imported_sources", """
    SELECT DISTINCT f.path AS test, source_literal AS module FROM imports JOIN files f ON f.id = file_id WHERE starts_with(f.path, 'tests/') AND source_literal IN (SELECT declared_module FROM files)""")
def _(f):
    return impact.imported_sources(f.files, f.imports)


@query("o071_uncovered_modules", """
    SELECT DISTINCT declared_module AS module FROM files WHERE NOT starts_with(path, 'tests/')
      AND declared_module NOT IN (SELECT source_literal FROM imports JOIN files f ON f.id = file_id WHERE starts_with(f.path, 'tests/'))""")
def _(f):
    return impact.uncovered_modules(f.files, f.imports)


def changed_defs(f):
    return f.defs.where("def_uid IN ('d3', 'd8')").select("def_uid")


@query("o077_direct_coverage", f"SELECT def_uid, test_id FROM ({FRESH}) WHERE def_uid IN ('d3', 'd8')")
def _(f):
    return impact.covering_tests(changed_defs(f), f.coverage)


@query("o080_blast_radius", f"""
    WITH fr AS ({FRESH}), c AS (SELECT def_uid FROM defs WHERE def_uid IN ('d3', 'd8')),
         a AS (SELECT DISTINCT test_id, 0 AS layer, 1.0 AS confidence FROM fr WHERE def_uid IN (SELECT def_uid FROM c)),
         k AS (SELECT DISTINCT d.def_uid FROM refs r JOIN defs d ON d.file_id = r.file_id AND r.start_line BETWEEN d.start_line AND d.end_line WHERE r.target_def_uid IN (SELECT def_uid FROM c) AND d.def_uid NOT IN (SELECT def_uid FROM c)),
         b AS (SELECT DISTINCT test_id FROM fr WHERE def_uid IN (SELECT def_uid FROM k) ORDER BY test_id LIMIT 50),
         s AS (SELECT def_uid FROM defs WHERE file_id IN (SELECT file_id FROM defs WHERE def_uid IN (SELECT def_uid FROM c)) AND def_uid NOT IN (SELECT def_uid FROM c)),
         g AS (SELECT DISTINCT test_id FROM fr WHERE def_uid IN (SELECT def_uid FROM s) ORDER BY test_id LIMIT 30),
         u AS (SELECT * FROM a UNION ALL SELECT test_id, 1, 0.7 FROM b UNION ALL SELECT test_id, 2, 0.4 FROM g)
    SELECT test_id, min(layer) AS layer, CAST(max(confidence) AS DOUBLE) AS confidence FROM u GROUP BY 1""")
def _(f):
    return impact.blast_radius(changed_defs(f), f.defs, f.refs, f.coverage)


@query("o078_caller_coverage", f"""
    WITH k AS (SELECT DISTINCT d.def_uid FROM refs r JOIN defs d ON d.file_id = r.file_id AND r.start_line BETWEEN d.start_line AND d.end_line WHERE r.target_def_uid = 'd3' AND d.def_uid <> 'd3')
    SELECT DISTINCT test_id FROM ({FRESH}) WHERE def_uid IN (SELECT def_uid FROM k) ORDER BY test_id LIMIT 50""")
def _(f):
    found = impact.blast_radius(f.defs.where("def_uid = 'd3'"), f.defs, f.refs, f.coverage.where("target_def_uid <> 'd3'"), 50, 0)
    return found.where("layer = 1").select("test_id")


@query("o079_sibling_coverage", f"""
    SELECT DISTINCT test_id FROM ({FRESH}) WHERE def_uid IN (SELECT def_uid FROM defs WHERE file_id = (SELECT file_id FROM defs WHERE def_uid = 'd3') AND def_uid <> 'd3') ORDER BY test_id LIMIT 30""")
def _(f):
    found = impact.blast_radius(f.defs.where("def_uid = 'd3'"), f.defs, f.refs.limit(0), f.coverage.where("target_def_uid <> 'd3'"), 0, 30)
    return found.where("layer = 2").select("test_id")


@query("o081_uncovered_defs", "SELECT def_uid FROM defs WHERE kind NOT IN ('variable', 'interface') AND def_uid NOT IN (SELECT target_def_uid FROM coverage WHERE covered_lines > 45) ORDER BY def_uid LIMIT 200")
def _(f):
    return impact.uncovered_defs(f.defs, f.coverage.where("covered_lines > 45"), ["variable", "interface"]).select("def_uid")


@query("o083_covered_by_test_files", "SELECT DISTINCT target_def_uid AS def_uid, split_part(test_id, '::', 1) AS path FROM coverage WHERE split_part(test_id, '::', 1) IN (SELECT path FROM files WHERE id < 300)")
def _(f):
    return impact.covered_by_test_files(f.coverage, f.files.where("id < 300"))


@query("o084_test_files_of_defs", "SELECT DISTINCT split_part(test_id, '::', 1) AS path FROM coverage WHERE target_def_uid IN ('d1', 'd2', 'd3')")
def _(f):
    return f.coverage.where("target_def_uid IN ('d1', 'd2', 'd3')").select(joins.test_file(F.col("test_id")).alias("path")).distinct()


@query("o111_enrich_candidates", """
    SELECT d.def_uid, f.path, (SELECT count(DISTINCT r.file_id) FROM refs r WHERE r.target_def_uid = d.def_uid) AS hub_score, (SELECT count(DISTINCT test_id) FROM coverage c WHERE c.target_def_uid = d.def_uid AND NOT stale) AS test_count,
           d.def_uid IN (SELECT handler_def_uid FROM endpoints) AS is_endpoint FROM defs d JOIN files f ON f.id = d.file_id""")
def _(f):
    e = f.endpoints.select(F.col("handler_def_uid").alias("def_uid"), F.lit(True).alias("_e")).distinct()
    d = f.defs.join(f.files.select(F.col("id").alias("file_id"), "path"), "file_id").join(aggregates.caller_counts(f.defs, f.refs), "def_uid")
    d = d.join(aggregates.test_counts(f.defs, f.coverage), "def_uid").join(e, "def_uid", "left")
    return d.select("def_uid", "path", "hub_score", "test_count", F.coalesce("_e", F.lit(False)).alias("is_endpoint"))


@query("o112_graph_harvest", """
    WITH s(seed, seed_rank) AS (VALUES ('d3', 0), ('d8', 1)),
         e AS (SELECT DISTINCT d.def_uid AS src, r.target_def_uid AS dst FROM refs r JOIN defs d ON d.file_id = r.file_id AND r.start_line BETWEEN d.start_line AND d.end_line WHERE r.target_def_uid IS NOT NULL AND d.def_uid <> r.target_def_uid),
         u AS (SELECT src AS seed, dst AS def_uid, 0 AS k FROM e UNION ALL SELECT dst, src, 1 FROM e UNION ALL SELECT a.def_uid, b.def_uid, 2 FROM defs a JOIN defs b USING (file_id)
               UNION ALL SELECT a.implementor_def_uid, b.implementor_def_uid, 3 FROM impls a JOIN impls b USING (interface_name) UNION ALL SELECT source_def_uid, target_def_uid, 4 FROM xrefs),
         b AS (SELECT def_uid, k, seed_rank, row_number() OVER (PARTITION BY def_uid ORDER BY seed_rank, k) AS p FROM u JOIN s USING (seed) WHERE seed <> def_uid)
    SELECT def_uid, ['callee', 'caller', 'sibling', 'implementor', 'doc_xref'][k + 1] AS edge, seed_rank FROM b WHERE p = 1 AND def_uid IN (SELECT def_uid FROM defs)""")
def _(f):
    seeds = f.spark.createDataFrame([("d3", 0), ("d8", 1)], "def_uid string, seed_rank int")
    return impact.graph_harvest(seeds, f.defs, f.refs, f.impls, f.xrefs)


@query("o113_import_harvest", """
    WITH s AS (SELECT path FROM files WHERE id IN (1, 2, 3, 5)), e AS (SELECT f.path AS src, i.resolved_path AS dst FROM imports i JOIN files f ON f.id = i.file_id WHERE i.resolved_path IS NOT NULL),
         u AS (SELECT dst AS path, 2 AS d FROM e WHERE src IN (SELECT path FROM s) UNION ALL SELECT src, 1 FROM e WHERE dst IN (SELECT path FROM s)
               UNION ALL SELECT f.path, 0 FROM files f JOIN s ON ends_with(s.path, '.py') AND f.path IN ('tests/' || split_part(s.path, '/', 2) || '/test_' || split_part(s.path, '/', 3), 'tests/test_' || split_part(s.path, '/', 3)))
    SELECT path, ['test_pair', 'reverse', 'forward'][min(d) + 1] AS direction FROM u WHERE path NOT IN (SELECT path FROM s) GROUP BY 1""")
def _(f):
    return impact.import_harvest(changed_files(f), f.imports, f.files)


@query("o114_coverage_expansion", """
    WITH t AS (SELECT DISTINCT test_id FROM coverage WHERE target_def_uid IN ('d3', 'd8')) SELECT DISTINCT target_def_uid AS def_uid FROM coverage WHERE test_id IN (SELECT test_id FROM t) AND target_def_uid NOT IN ('d3', 'd8')
      AND target_def_uid IN (SELECT def_uid FROM defs)""")
def _(f):
    return impact.coverage_expansion(changed_defs(f), f.coverage, f.defs)


@query("o115_ground_truth_expansion", """
    WITH t AS (SELECT DISTINCT split_part(test_id, '::', 1) AS p FROM coverage WHERE target_def_uid IN ('d3', 'd8')) SELECT DISTINCT d.file_id, d.kind, d.name, d.start_line FROM coverage c JOIN defs d ON d.def_uid = c.target_def_uid WHERE split_part(test_id, '::', 1) IN (SELECT p FROM t)""")
def _(f):
    files = f.coverage.where("target_def_uid IN ('d3', 'd8')").select(joins.test_file(F.col("test_id")).alias("path"))
    found = impact.covered_by_test_files(f.coverage, files).select("def_uid").distinct()
    return f.defs.join(found, "def_uid").select("file_id", "kind", "name", "start_line").distinct()


@query("o163_graph_seeds", """
    WITH c AS (SELECT def_uid, p.p_size % 5 AS term_match_count, p.p_size % 7 = 0 AS explicit, p.p_size % 3 AS axes FROM defs JOIN part p ON def_uid = 'd' || CAST(p_partkey AS STRING)),
         k AS (SELECT def_uid, row_number() OVER (ORDER BY term_match_count DESC, def_uid) - 1 AS seed_rank FROM c WHERE explicit OR axes >= 2)
    SELECT def_uid, seed_rank FROM k WHERE seed_rank < 10""")
def _(f):
    c = f.part.select(F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("def_uid"), (F.col("p_size") % 5).alias("term_match_count"), (F.col("p_size") % 7 == 0).alias("explicit"), (F.col("p_size") % 3).alias("axes"))
    return impact.seeds_of(c)


DEBT = """
    WITH c AS (SELECT path FROM files WHERE id % 7 <> 0 AND ends_with(path, '.py')), known AS (SELECT path FROM files UNION ALL SELECT 'tests/' || split_part(path, '/', 2) || '/test_' || split_part(path, '/', 3) FROM files WHERE id % 3 = 0 AND id % 7 <> 0),
         p AS (SELECT path, unnest(list_distinct(['tests/' || split_part(path, '/', 2) || '/test_' || split_part(path, '/', 3), 'tests/test_' || split_part(path, '/', 3), 'src/' || split_part(path, '/', 2) || '/test_' || split_part(path, '/', 3)])) AS pair FROM c)
    SELECT path, pair FROM p WHERE pair IN (SELECT path FROM known)"""


def debt(f):
    """The changed sources with tests that exist: of every third source, as the facts have a test for none."""
    parts = F.split("path", "/")
    tests = f.files.where("id % 3 = 0 AND id % 7 <> 0").select(F.concat(F.lit("tests/"), parts[1], F.lit("/test_"), parts[2]).alias("path"))
    changed = f.files.where("id % 7 <> 0 AND endswith(path, '.py')").select("path")
    return impact.test_debt(changed, f.files.select("path").unionByName(tests))


@query("o238_governance_gates", f"""
    SELECT 'coverage_floor' AS rule, round(100 * avg(line_rate), 4) AS actual, round(100 * avg(line_rate), 4) < 80.0 AS violated FROM coverage WHERE NOT stale
    UNION ALL SELECT 'lint_clean', CAST(sum(error_count) AS DOUBLE), sum(error_count) > 0 FROM lint UNION ALL SELECT 'test_debt', CAST(count(*) AS DOUBLE), count(*) > 0 FROM ({DEBT})""")
def _(f):
    return impact.gates(f.coverage, f.lint, debt(f), 80.0, 0)


@query("o239_test_debt", DEBT)
def _(f):
    return debt(f)


@query("o240_integrity", """
    SELECT 'defs_without_file' AS check_name, count(*) AS n FROM defs WHERE file_id NOT IN (SELECT id FROM files) UNION ALL
    SELECT 'coverage_without_def', count(*) FROM coverage WHERE target_def_uid NOT IN (SELECT def_uid FROM defs WHERE kind <> 'class') UNION ALL
    SELECT 'imports_unresolved', count(*) FROM imports WHERE resolved_path IS NULL OR resolved_path NOT IN (SELECT path FROM files)""")
def _(f):
    def row(name, df):
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check_name"), "n")

    a = f.defs.join(f.files.select(F.col("id").alias("file_id")), "file_id", "left_anti")
    b = f.coverage.join(f.defs.where("kind <> 'class'").select(F.col("def_uid").alias("target_def_uid")), "target_def_uid", "left_anti")
    c = f.imports.join(f.files.select(F.col("path").alias("resolved_path")), "resolved_path", "left_anti")
    return row("defs_without_file", a).unionByName(row("coverage_without_def", b)).unionByName(row("imports_unresolved", c))


@query("o247_index_facts", "SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM defs) AS defs, (SELECT count(*) FROM refs) AS refs, (SELECT count(*) FROM imports) AS imports")
def _(f):
    parts = [getattr(f, t).agg(F.count("*").alias(t)) for t in ("files", "defs", "refs", "imports")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out
