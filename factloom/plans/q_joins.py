"""Queries of section 2.3: joins and resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..operators import aggregates, joins, resolve
from .registry import query

EDGES = """SELECT DISTINCT d.def_uid AS src, r.target_def_uid AS dst FROM refs r JOIN defs d ON d.file_id = r.file_id AND r.start_line BETWEEN d.start_line AND d.end_line
        WHERE r.target_def_uid IS NOT NULL AND d.def_uid <> r.target_def_uid"""


@query("o064_callees", f"WITH e AS ({EDGES}) SELECT src, dst FROM e WHERE dst IN (SELECT def_uid FROM defs) AND src IN (SELECT def_uid FROM defs WHERE kind = 'class')")
def _(f):
    return joins.callees(f.defs, f.refs, f.defs.where("kind = 'class'"))


@query("o065_containment_edges", EDGES)
def _(f):
    return joins.enclosing_refs(f.refs, f.defs)


@query("o066_file_graph", "SELECT DISTINCT f.path AS src, i.resolved_path AS dst FROM imports i JOIN files f ON f.id = i.file_id WHERE i.resolved_path IS NOT NULL AND f.path <> i.resolved_path")
def _(f):
    from ..operators import graph

    return graph.file_edges(f.files, f.imports)


@query("o072_co_implementors", """
    SELECT DISTINCT a.implementor_def_uid AS def_uid, b.implementor_def_uid AS other FROM impls a JOIN impls b USING (interface_name)
    WHERE a.implementor_def_uid IN (SELECT def_uid FROM defs WHERE file_id < 40) AND a.implementor_def_uid <> b.implementor_def_uid""")
def _(f):
    return joins.co_implementors(f.impls, f.defs.where("file_id < 40"))


@query("o073_hierarchy", "SELECT DISTINCT implementor_def_uid, interface_name FROM impls WHERE interface_name = 'J7'")
def _(f):
    return joins.implementors(f.impls, ["J7"])


@query("o073_super_and_sub_types", """
    WITH i AS (SELECT DISTINCT * FROM (SELECT implementor_def_uid, interface_name FROM impls UNION ALL SELECT d.def_uid, e.name FROM defs d JOIN defs e ON e.def_uid = 'd' || CAST(CAST(substr(d.def_uid, 2) AS BIGINT) + 1 AS STRING) WHERE e.kind = 'interface'))
    SELECT implementor_def_uid AS def_uid, 'interface' AS relation, interface_name AS other FROM i UNION ALL
    SELECT DISTINCT implementor_def_uid, 'super', def_uid FROM i JOIN defs ON name = interface_name WHERE def_uid <> implementor_def_uid UNION ALL
    SELECT DISTINCT def_uid, 'sub', implementor_def_uid FROM i JOIN defs ON name = interface_name WHERE def_uid <> implementor_def_uid""")
def _(f):
    """Of every definition; the facts' interfaces bear no definition's name, so each definition also implements the next if that is an interface."""
    after = F.concat(F.lit("d"), (F.expr("substring(def_uid, 2)").cast("long") + 1).cast("string"))
    named = f.defs.where("kind = 'interface'").select(F.col("def_uid").alias("_u"), F.col("name").alias("interface_name"))
    more = f.defs.select(F.col("def_uid").alias("implementor_def_uid"), after.alias("_u")).join(named, "_u").select("implementor_def_uid", "interface_name")
    return joins.hierarchy(f.impls.select("implementor_def_uid", "interface_name").unionByName(more), f.defs, f.defs)


@query("o074_doc_xrefs", "SELECT id, source_def_uid, target_def_uid, confidence FROM xrefs WHERE source_def_uid = 'd5' OR target_def_uid = 'd5'")
def _(f):
    return joins.cross_references_of(f.xrefs, ["d5"])


@query("o075_first_endpoint", "SELECT handler_def_uid, http_method, url_pattern FROM (SELECT *, row_number() OVER (PARTITION BY handler_def_uid ORDER BY id) AS p FROM endpoints) WHERE p = 1")
def _(f):
    return joins.first_per(f.endpoints, "handler_def_uid", ["id"]).select("handler_def_uid", "http_method", "url_pattern")


@query("o076_url_links", """
    WITH e AS (SELECT id, kind, '/' || trim(url_pattern, '/') || '/' AS u FROM endpoints)
    SELECT DISTINCT s.id AS server, c.id AS client FROM e s JOIN e c ON s.kind = 'server' AND c.kind = 'client' AND (contains(s.u, c.u) OR contains(c.u, s.u))""")
def _(f):
    return joins.url_links(f.endpoints)


@query("o082_covering_tests", """
    SELECT d.def_uid, c.test_id FROM defs d LEFT JOIN (SELECT DISTINCT target_def_uid, test_id FROM coverage WHERE NOT stale) c ON c.target_def_uid = d.def_uid WHERE d.file_id < 100""")
def _(f):
    from ..operators import impact

    return impact.covering_tests(f.defs.where("file_id < 100"), f.coverage)


REPORT = "SELECT f.path, CAST(l_linenumber * 40 + l_suppkey % 40 AS BIGINT) AS line, CAST(l_quantity AS BIGINT) % 3 AS hits FROM lineitem JOIN files f ON f.id = l_orderkey % (SELECT nf FROM fact_count)"


@query("o085_coverage_ingestion", f"""
    WITH r AS (SELECT path, line, max(hits) AS hits FROM ({REPORT}) GROUP BY 1, 2), d AS (SELECT d.def_uid, f.path, d.start_line, d.end_line FROM defs d JOIN files f ON f.id = d.file_id)
    SELECT d.def_uid, CAST(count(*) FILTER (hits > 0) AS BIGINT) AS covered_lines, count(*) AS total_lines, round(count(*) FILTER (hits > 0) / count(*), 6) AS line_rate
    FROM r JOIN d ON d.path = r.path AND r.line BETWEEN d.start_line AND d.end_line GROUP BY 1""")
def _(f):
    nf = f.customer.count()
    files = f.files.select(F.col("id").alias("file_id"), "path")
    lines = f.lineitem.select((F.col("l_orderkey") % nf).alias("file_id"), (F.col("l_linenumber") * 40 + F.col("l_suppkey") % 40).cast("long").alias("line"), (F.col("l_quantity").cast("long") % 3).alias("hits")).join(files, "file_id")
    return joins.coverage_by_intervals(aggregates.merge_lines(lines), f.defs.join(files, "file_id").select("def_uid", "path", "start_line", "end_line"))


@query("o086_missing_vectors", "SELECT d.def_uid, d.file_id FROM defs d LEFT JOIN (SELECT 'd' || CAST(vec_id AS STRING) AS u FROM embeddings) e ON e.u = d.def_uid WHERE e.u IS NULL")
def _(f):
    return joins.without(f.defs, f.embeddings.select(F.concat(F.lit("d"), F.col("vec_id").cast("string")).alias("def_uid")), "def_uid").select("def_uid", "file_id")


@query("o087_dangling_refs", "SELECT file_id, count(*) AS refs FROM refs WHERE target_def_uid IS NOT NULL AND target_def_uid NOT IN (SELECT def_uid FROM defs WHERE file_id >= 50) GROUP BY 1")
def _(f):
    return joins.dangling(f.refs, f.defs.where("file_id >= 50")).groupBy("file_id").agg(F.count("*").alias("refs"))


@query("o088_cross_worktree_staleness", """
    SELECT DISTINCT f.id FROM files f JOIN refs r ON r.file_id = f.id WHERE f.worktree_id <> 1 AND r.target_def_uid IS NOT NULL AND r.target_def_uid NOT IN (SELECT def_uid FROM defs WHERE file_id >= 50)""")
def _(f):
    bad = joins.dangling(f.refs, f.defs.where("file_id >= 50")).select(F.col("file_id").alias("id"))
    return f.files.where("worktree_id <> 1").join(bad, "id", "left_semi").select("id")


@query("o089_orphan_sweep", "SELECT test_id, target_def_uid, count(*) AS n FROM coverage WHERE target_def_uid IN (SELECT def_uid FROM defs WHERE kind <> 'variable') GROUP BY 1, 2")
def _(f):
    kept = f.coverage.join(f.defs.where("kind <> 'variable'").select(F.col("def_uid").alias("target_def_uid")), "target_def_uid", "left_semi")
    return kept.groupBy("test_id", "target_def_uid").agg(F.count("*").alias("n"))


@query("o090_as_of_snapshot", """
    SELECT file_path, lexical_path, epoch_id, signature_hash FROM (SELECT *, row_number() OVER (PARTITION BY file_path, lexical_path ORDER BY epoch_id DESC, record_id DESC) AS p FROM snapshots WHERE epoch_id <= 6) WHERE p = 1""")
def _(f):
    return joins.as_of(f.snapshots, ["file_path", "lexical_path"], "epoch_id", 6, "record_id").select("file_path", "lexical_path", "epoch_id", "signature_hash")


@query("o090_as_of_join", """
    WITH c AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click'), v AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2)
    SELECT c.user_id, c.event_id, v.value FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.ts >= v.ts""")
def _(f):
    left = f.events.where("event_type = 'click'").select("user_id", "ts", "event_id")
    right = f.events.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return joins.as_of_join(left, right, ["user_id"], "ts", ["value"]).select("user_id", "event_id", "value")


@query("o091_hunk_overlap", """
    WITH h AS (SELECT file_id, CAST(start_line * 3 AS BIGINT) AS hs, CAST(start_line * 3 + 8 AS BIGINT) AS he FROM imports)
    SELECT DISTINCT d.def_uid, d.kind, d.name FROM defs d JOIN h ON h.file_id = d.file_id AND d.start_line <= he AND d.end_line >= hs""")
def _(f):
    hunks = f.imports.select("file_id", (F.col("start_line") * 3).alias("other_start"), (F.col("start_line") * 3 + 8).alias("other_end"))
    spans = f.defs.select("def_uid", "kind", "name", "file_id", F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    return joins.overlapping(spans, hunks, ["file_id"]).select("def_uid", "kind", "name").distinct()


@query("o092_hash_reuse", "SELECT a.id, min(b.id) AS donor FROM files a JOIN files b ON a.content_hash = b.content_hash AND a.worktree_id <> b.worktree_id GROUP BY 1")
def _(f):
    return joins.reuse_by_hash(f.files)


NAMED = "SELECT r.ref_id, r.file_id, d.name, d2.namespace FROM refs r JOIN defs d ON d.def_uid = r.target_def_uid JOIN defs d2 ON d2.def_uid = 'd' || CAST(r.ref_id % 150 AS STRING)"


def named_refs(f):
    """The references with a name and a namespace, as NAMED."""
    d = f.defs.select(F.col("def_uid").alias("target_def_uid"), "name")
    d2 = F.broadcast(f.defs.where(F.col("def_uid").isin([f"d{i}" for i in range(-149, 150)])).select(F.col("def_uid").alias("_u"), "namespace"))  # 150 rows
    r = f.refs.join(d, "target_def_uid").withColumn("_u", F.concat(F.lit("d"), (F.col("ref_id") % 150).cast("string")))
    return r.join(d2, "_u").select("ref_id", "file_id", "name", "namespace")


@query("o093_namespace_using", f"SELECT r.ref_id, min(d.def_uid) AS def_uid FROM ({NAMED}) r JOIN defs d ON d.name = r.name AND d.namespace = r.namespace GROUP BY 1")
def _(f):
    return namespace_using(f, named_refs(f))


def namespace_using(f, named):
    met = named.join(resolve.least(f.defs, "name", "namespace"), ["name", "namespace"])
    return met.groupBy("ref_id").agg(F.min("def_uid").alias("def_uid"))


@query("o094_star_imports", f"""
    SELECT r.ref_id, min(d.def_uid) AS def_uid FROM ({NAMED}) r JOIN imports i ON i.file_id = r.file_id AND i.import_kind = 'wildcard'
    JOIN files m ON m.declared_module = i.source_literal JOIN defs d ON d.file_id = m.id AND d.name = r.name AND d.lexical_path = d.name GROUP BY 1""")
def _(f):
    return resolve.by_star_import(named_refs(f), f.imports, f.defs, f.files)


@query("o095_parent_namespace", f"""
    SELECT r.ref_id, min(d.def_uid) AS def_uid FROM ({NAMED}) r JOIN defs d ON d.name = r.name AND (d.namespace = r.namespace OR starts_with(r.namespace, d.namespace || '.')) GROUP BY 1""")
def _(f):
    return resolve.by_namespace(named_refs(f), f.defs)


MODULES = "SELECT DISTINCT declared_module, CAST(1 + id % 4 AS BIGINT) AS unit_id FROM files"


@query("o097_import_chain", f"""
    WITH x AS (SELECT unit_id, name, min(def_uid) AS def_uid FROM defs WHERE kind IN ('class', 'function') GROUP BY 1, 2), m AS ({MODULES}),
         i AS (SELECT m.file_id, coalesce(m.alias, m.imported_name) AS name, m.source_literal, d.name AS real FROM imports m JOIN defs d ON d.def_uid = 'd' || CAST(m.start_line AS STRING)),
         r AS (SELECT ref_id, file_id, 'name' || CAST(ref_id % 30 AS STRING) AS name FROM refs)
    SELECT r.ref_id, min(x.def_uid) AS def_uid FROM r JOIN i ON i.file_id = r.file_id AND i.name = r.name JOIN m ON m.declared_module = i.source_literal JOIN x ON x.unit_id = m.unit_id AND x.name = i.real GROUP BY 1""")
def _(f):
    real = f.defs.select(F.col("def_uid").alias("_u"), F.col("name").alias("_real"))
    i = f.imports.withColumn("_u", F.concat(F.lit("d"), F.col("start_line").cast("string"))).join(real, "_u")
    i = i.withColumn("alias", F.coalesce("alias", "imported_name")).withColumn("imported_name", F.col("_real"))
    refs = f.refs.select("ref_id", "file_id", F.concat(F.lit("name"), (F.col("ref_id") % 30).cast("string")).alias("name"))
    modules = f.files.select("declared_module", (1 + F.col("id") % 4).alias("unit_id")).distinct()
    return resolve.by_import_chain(refs, i, resolve.export_entries(f.defs), modules)


@query("o244_resolution_cascade", f"""
    WITH r AS ({NAMED}), a AS (SELECT r.ref_id, min(d.def_uid) AS u FROM r JOIN defs d ON d.name = r.name AND d.namespace = r.namespace GROUP BY 1),
         b AS (SELECT r.ref_id, min(d.def_uid) AS u FROM r JOIN defs d ON d.name = r.name AND starts_with(r.namespace, d.namespace || '.') GROUP BY 1)
    SELECT CASE WHEN a.u IS NOT NULL THEN 'namespace' WHEN b.u IS NOT NULL THEN 'parent' ELSE 'none' END AS resolved_by, count(*) AS n FROM r LEFT JOIN a USING (ref_id) LEFT JOIN b USING (ref_id) GROUP BY 1""")
def _(f):
    return resolution_cascade(f, named_refs(f))


def resolution_cascade(f, r):
    same = r.join(resolve.least(f.defs, "name", "namespace"), ["name", "namespace"]).select("ref_id", "def_uid")
    out = resolve.cascade(r.withColumn("target_def_uid", F.lit(None).cast("string")), [("namespace", same), ("parent", resolve.by_namespace(r, f.defs))])
    return out.groupBy(F.coalesce("resolved_by", F.lit("none")).alias("resolved_by")).agg(F.count("*").alias("n"))


@query("o098_scope_walk", """
    WITH RECURSIVE s AS (SELECT CAST(p_partkey AS BIGINT) AS scope_id, CASE WHEN p_partkey = 0 THEN NULL ELSE CAST(floor(p_partkey / 2) AS BIGINT) END AS parent FROM part),
         a AS (SELECT scope_id, scope_id AS ancestor, 0 AS depth FROM s UNION ALL SELECT a.scope_id, s.parent, depth + 1 FROM a JOIN s ON s.scope_id = a.ancestor WHERE s.parent IS NOT NULL),
         b AS (SELECT p_partkey AS bind_id, CAST(p_partkey % 60 AS BIGINT) AS scope_id, p_brand AS name FROM part), u AS (SELECT p_partkey AS use_id, CAST(p_partkey AS BIGINT) AS scope_id, p_brand AS name FROM part),
         m AS (SELECT use_id, bind_id, row_number() OVER (PARTITION BY use_id ORDER BY depth, bind_id) AS p FROM u JOIN a ON a.scope_id = u.scope_id JOIN b ON b.scope_id = a.ancestor AND b.name = u.name)
    SELECT use_id, bind_id FROM m WHERE p = 1""")
def _(f):
    k = F.col("p_partkey")
    scopes = f.part.select(k.alias("scope_id"), F.when(k > 0, F.floor(k / 2)).alias("parent_scope_id"))
    binds = f.part.select(k.alias("bind_id"), (k % 60).alias("scope_id"), F.col("p_brand").alias("name"))
    uses = f.part.select(k.alias("use_id"), k.alias("scope_id"), F.col("p_brand").alias("name"))
    return resolve.innermost_bind(uses, binds, resolve.scope_ancestors(scopes))


@query("o099_export_map", "SELECT f.path, count(DISTINCT d.name) AS names FROM files f JOIN defs d ON d.file_id = f.id WHERE d.kind IN ('class', 'function') GROUP BY 1")
def _(f):
    d = f.defs.where(F.col("kind").isin(resolve.EXPORTED)).join(f.files.select(F.col("id").alias("file_id"), "path"), "file_id")
    return d.groupBy("path").agg(F.countDistinct("name").alias("names"))


@query("o100_module_resolution", """
    WITH c AS (SELECT import_uid, source_literal AS m, 0 AS p FROM imports UNION ALL SELECT import_uid, split_part(source_literal, '.', 1), 1 FROM imports),
         k AS (SELECT import_uid, path, row_number() OVER (PARTITION BY import_uid ORDER BY p, path) AS r FROM c JOIN files ON declared_module = m)
    SELECT import_uid, path AS resolved_path FROM k WHERE r = 1""")
def _(f):
    return resolve.resolve_modules(f.imports, f.files)


@query("o101_import_paths", """
    SELECT i.import_uid, min(f.path) AS path FROM imports i JOIN files f ON f.path = 'src/' || replace(i.source_literal, '.', '/') || '.py' GROUP BY 1""")
def _(f):
    asked = f.imports.select("import_uid", F.explode(resolve.import_candidates(F.col("source_literal"), F.lit("src/pkg0/m0.py"))).alias("path"))
    return asked.join(f.files.select("path"), "path").groupBy("import_uid").agg(F.min("path").alias("path"))


IMPORTS = """
    SELECT 'p' || id AS import_uid, 'python_from' AS import_kind, '.m' || id AS source_literal, path AS importer_path FROM files UNION ALL
    SELECT 'j' || id, 'js_import', '../pkg' || (id % 20) || '/m' || id || '.js', 'src/app/main.ts' FROM files UNION ALL
    SELECT 'c' || id, 'c_include', 'pkg' || (id % 20) || '/m' || id || '.md', 'tests/a.c' FROM files UNION ALL
    SELECT 'l' || id, 'lua_require', 'pkg' || (id % 20) || '.m' || id, 'a.lua' FROM files UNION ALL
    SELECT 'd' || id, 'java_import', declared_module || CASE WHEN id % 2 = 0 THEN '' ELSE '.M' || id END, path FROM files"""


@query("o101_import_kinds", f"""
    WITH known AS (SELECT path, declared_module, id FROM files UNION ALL SELECT 'src/pkg' || (id % 20) || '/m' || id || '.ts', 'none', id FROM files UNION ALL SELECT 'lib/pkg' || (id % 20) || '/m' || id || '/init.lua', 'none', id FROM files WHERE id % 3 = 0),
         i AS ({IMPORTS}), n AS (SELECT *, CAST(substr(import_uid, 2) AS BIGINT) AS k FROM i),
         x AS (SELECT import_uid, split_part(importer_path, '/', 1) || '/' || split_part(importer_path, '/', 2) || '/m' || k || '.py' AS path FROM n WHERE import_kind = 'python_from' UNION ALL
               SELECT import_uid, 'src/pkg' || (k % 20) || '/m' || k || '.ts' FROM n WHERE import_kind = 'js_import' UNION ALL SELECT import_uid, 'src/' || source_literal FROM n WHERE import_kind = 'c_include' UNION ALL
               SELECT import_uid, 'lib/pkg' || (k % 20) || '/m' || k || '/init.lua' FROM n WHERE import_kind = 'lua_require' UNION ALL
               SELECT import_uid, importer_path FROM n WHERE import_kind = 'java_import' AND (k % 2 = 0 OR NOT starts_with(importer_path, 'tests/')))
    SELECT x.import_uid, x.path FROM x WHERE x.path IN (SELECT path FROM known)""")
def _(f):
    k, folder = F.col("id").cast("string"), F.concat(F.lit("pkg"), (F.col("id") % 20).cast("string"))
    name = F.concat(folder, F.lit("/m"), k)

    def kind(mark, kind, literal, importer):
        return f.files.select(F.concat(F.lit(mark), k).alias("import_uid"), F.lit(kind).alias("import_kind"), literal.alias("source_literal"), importer.alias("importer_path"))

    every = kind("p", "python_from", F.concat(F.lit(".m"), k), F.col("path")).unionByName(kind("j", "js_import", F.concat(F.lit("../"), name, F.lit(".js")), F.lit("src/app/main.ts")))
    every = every.unionByName(kind("c", "c_include", F.concat(name, F.lit(".md")), F.lit("tests/a.c"))).unionByName(kind("l", "lua_require", F.translate(name, "/", "."), F.lit("a.lua")))
    every = every.unionByName(kind("d", "java_import", F.concat("declared_module", F.when(F.col("id") % 2 == 0, "").otherwise(F.concat(F.lit(".M"), k))), F.col("path")))
    more = f.files.select(F.concat(F.lit("src/"), name, F.lit(".ts")).alias("path"), F.lit("none").alias("declared_module"))
    lua = f.files.where("id % 3 = 0").select(F.concat(F.lit("lib/"), name, F.lit("/init.lua")).alias("path"), F.lit("none").alias("declared_module"))
    return resolve.import_paths(every, f.files.select("path", "declared_module").unionByName(more).unionByName(lua))


@query("o096_wildcard_imports", """
    WITH r AS (SELECT ref_id, file_id, d.name, kind FROM refs JOIN (SELECT def_uid AS target_def_uid, name, kind FROM defs) d USING (target_def_uid)),
         c AS (SELECT def_uid, file_id, upper(substr(name, 1, 1)) || substr(name, 2) AS name FROM defs), u AS (SELECT ref_id, file_id, upper(substr(name, 1, 1)) || substr(name, 2) AS name FROM r),
         g AS (SELECT split_part(path, '/', 2) AS package, max(id) AS source FROM files WHERE ends_with(path, '.go') AND starts_with(path, 'src/') GROUP BY 1)
    SELECT 'go' AS language, ref_id, min(def_uid) AS def_uid FROM u JOIN g ON package = 'pkg' || (u.file_id % 20) JOIN c ON c.file_id = source AND c.name = u.name GROUP BY 2
    UNION ALL SELECT 'rust', ref_id, min(def_uid) FROM r JOIN defs d ON d.file_id = r.file_id AND d.name = r.name GROUP BY 2
    UNION ALL SELECT 'java', ref_id, min(def_uid) FROM r JOIN (SELECT file_id AS f, min(namespace) AS ns FROM defs GROUP BY 1) n ON n.f = r.file_id JOIN defs d ON d.namespace = ns AND d.name = r.name WHERE d.kind IN ('class', 'interface') GROUP BY 2""")
def _(f):
    refs = f.refs.join(f.defs.select(F.col("def_uid").alias("target_def_uid"), "name"), "target_def_uid").select("ref_id", "file_id", "name")
    upper = F.concat(F.upper(F.substring("name", 1, 1)), F.expr("substring(name, 2)")).alias("name")
    folder, star = F.concat(F.lit("pkg"), (F.col("id") % 20).cast("string")), F.lit("*").alias("imported_name")
    go = f.files.select(F.col("id").alias("file_id"), F.concat(F.lit("example.org/x/src/"), folder).alias("source_literal"), star, F.lit("go_import").alias("import_kind"))
    found = resolve.by_go_dot(refs.select("ref_id", "file_id", upper), go, f.defs.select("def_uid", "file_id", upper), f.files)
    rust = f.files.select(F.col("id").alias("file_id"), F.concat(F.lit("crate::m"), F.col("id").cast("string")).alias("source_literal"), star, F.lit("rust_use").alias("import_kind"))
    sources = f.files.select("id", F.concat(F.lit("src/m"), F.col("id").cast("string"), F.lit("/mod.rs")).alias("path"))
    globs = resolve.by_rust_glob(refs, rust, f.defs, sources)
    java = f.defs.groupBy("file_id").agg(F.min("namespace").alias("source_literal")).select("file_id", "source_literal", star, F.lit("java_import").alias("import_kind"))
    stars = resolve.by_java_star(refs, java, f.defs, ["class", "interface"])
    parts = [x.select(F.lit(n).alias("language"), "ref_id", "def_uid") for n, x in (("go", found), ("rust", globs), ("java", stars))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("o102_late_resolution", """
    WITH o AS (SELECT import_uid, source_literal FROM imports WHERE resolved_path IS NULL)
    SELECT import_uid, min(f.path) AS resolved_path FROM o JOIN files f ON f.declared_module = source_literal GROUP BY 1""")
def _(f):
    return resolve.resolve_modules(f.imports.where("resolved_path IS NULL"), f.files)


@query("o104_member_trace", """
    WITH m AS (SELECT DISTINCT p_brand AS base_type, p_type AS member_name, 'Brand#' || CAST(p_size % 25 + 1 AS STRING) AS member_type FROM part),
         u AS (SELECT base_type, member_name, min(member_type) AS member_type FROM m GROUP BY 1, 2),
         s AS (SELECT p_partkey AS id, p_brand AS type, p_type AS c1, CASE WHEN p_size % 2 = 0 THEN 'ECONOMY' ELSE 'nosuch' END AS c2 FROM part)
    SELECT s.id, coalesce(b.member_type, a.member_type, s.type) AS type, CASE WHEN b.member_type IS NOT NULL THEN 2 WHEN a.member_type IS NOT NULL THEN 1 ELSE 0 END AS steps
    FROM s LEFT JOIN u a ON a.base_type = s.type AND a.member_name = s.c1 LEFT JOIN u b ON b.base_type = a.member_type AND b.member_name = s.c2""")
def _(f):
    member = F.concat(F.lit("Brand#"), (F.col("p_size") % 25 + 1).cast("string"))
    members = f.part.select(F.col("p_brand").alias("base_type"), F.col("p_type").alias("member_name"), member.alias("member_type")).groupBy("base_type", "member_name").agg(F.min("member_type").alias("member_type"))
    starts = f.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("type"), F.array("p_type", F.when(F.col("p_size") % 2 == 0, "ECONOMY").otherwise("nosuch")).alias("chain"))
    return resolve.trace_members(starts, members).select("id", "type", "steps")


@query("o105_self_type", """
    WITH c AS (SELECT * FROM defs WHERE kind = 'class'), m AS (SELECT r.ref_id AS id, c.def_uid, row_number() OVER (PARTITION BY r.ref_id ORDER BY c.end_line - c.start_line, c.def_uid) AS p
        FROM refs r JOIN c ON c.file_id = r.file_id AND r.start_line BETWEEN c.start_line AND c.end_line)
    SELECT id, def_uid AS class_uid FROM m WHERE p = 1""")
def _(f):
    receivers = f.refs.select(F.col("ref_id").alias("id"), "file_id", F.col("start_line").alias("line"))
    return resolve.self_types(receivers, f.defs.where("kind = 'class'").select("def_uid", "file_id", "start_line", "end_line"))


@query("o106_shape_match", """
    WITH m AS (SELECT DISTINCT p_brand AS t, p_name AS n, p_size % 2 = 0 AS meth FROM part), s AS (SELECT p_brand AS shape_id, unnest(list_slice(list_sort(list(DISTINCT p_name)), 1, 4)) AS n FROM part GROUP BY 1),
         k AS (SELECT shape_id, count(*) AS c FROM s GROUP BY 1),
         j AS (SELECT s.shape_id, m.t, count(DISTINCT s.n) / max(c) AS share, count(DISTINCT CASE WHEN meth THEN s.n END) / max(c) AS meth FROM s JOIN m ON m.n = s.n JOIN k ON k.shape_id = s.shape_id GROUP BY 1, 2),
         r AS (SELECT shape_id, t, round(least(1.0, share + 0.1 * meth), 6) AS confidence FROM j)
    SELECT shape_id, t AS base_type, confidence, count(*) OVER (PARTITION BY shape_id) > 1 AS ambiguous FROM r WHERE confidence >= 0.7""")
def _(f):
    members = f.part.select(F.col("p_brand").alias("base_type"), F.col("p_name").alias("member_name"), F.when(F.col("p_size") % 2 == 0, "method").otherwise("field").alias("member_kind"))
    shapes = f.part.groupBy(F.col("p_brand").alias("shape_id")).agg(F.slice(F.array_sort(F.collect_set("p_name")), 1, 4).alias("observed"))
    return resolve.match_shapes(shapes, members)


@query("o108_xref_targets", """
    WITH r AS (SELECT ref_id AS id, CASE WHEN ref_id % 3 = 0 THEN target_def_uid WHEN ref_id % 3 = 1 THEN 'red_widget' ELSE 'ring' END AS target FROM refs),
         m AS (SELECT id, 0 AS w, def_uid FROM r JOIN defs ON def_uid = target UNION ALL SELECT id, 1, def_uid FROM r JOIN defs ON name = target
               UNION ALL SELECT id, 2, def_uid FROM r JOIN defs ON list_last(string_split(qualified_name, '.')) = target),
         k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w, def_uid) AS p FROM m)
    SELECT id, def_uid FROM k WHERE p = 1""")
def _(f):
    return xref_targets(f, f.refs)


def xref_targets(f, refs):
    k = F.col("ref_id")
    r = refs.select(k.alias("id"), F.when(k % 3 == 0, F.col("target_def_uid")).when(k % 3 == 1, "red_widget").otherwise("ring").alias("target"))
    return resolve.xref_targets(r, f.defs)


@query("o109_enclosing_scope", """
    WITH m AS (SELECT r.ref_id, s.scope_id, s.kind, row_number() OVER (PARTITION BY r.ref_id ORDER BY CASE WHEN s.kind = 'class' THEN 0 WHEN s.kind <> 'file' THEN 1 ELSE 2 END, s.end_line - s.start_line, s.scope_id) AS p
        FROM refs r JOIN scopes s ON s.file_id = r.file_id AND r.start_line BETWEEN s.start_line AND s.end_line)
    SELECT ref_id, scope_id, kind FROM m WHERE p = 1""")
def _(f):
    points = f.refs.select("ref_id", "file_id", F.col("start_line").alias("_line"))
    return joins.innermost(points, "_line", f.scopes, "ref_id", "class")


@query("o107_access_upgrade", """
    SELECT ref_tier, CASE WHEN d.def_uid IS NOT NULL AND ref_tier = 'unknown' THEN 'anchored' ELSE ref_tier END AS new_tier, count(*) AS n FROM refs LEFT JOIN defs d ON d.def_uid = target_def_uid GROUP BY 1, 2""")
def _(f):
    j = f.refs.join(f.defs.select(F.col("def_uid").alias("target_def_uid"), F.lit(True).alias("_k")), "target_def_uid", "left")
    tier = F.when(F.col("_k") & (F.col("ref_tier") == "unknown"), "anchored").otherwise(F.col("ref_tier"))
    return j.groupBy("ref_tier", tier.alias("new_tier")).agg(F.count("*").alias("n"))


@query("o103_config_refs", """
    WITH t AS (SELECT path, 'src/pkg' || CAST((id + 1) % 20 AS STRING) || '/m' || CAST(id + 1 AS STRING) || '.md' AS target FROM files)
    SELECT path, target FROM t WHERE target IN (SELECT path FROM files) AND path <> target""")
def _(f):
    text = F.concat(F.lit('include = "src/pkg'), ((F.col("id") + 1) % 20).cast("string"), F.lit("/m"), (F.col("id") + 1).cast("string"), F.lit('.md"\nall: none'))
    return resolve.config_references(f.files.select("path", text.alias("text")), f.files)


@query("o110_reference_enrichment", """
    SELECT target_def_uid AS def_uid, count(*) AS refs, CAST(count(*) FILTER (ref_tier = 'proven') AS BIGINT) AS proven, CAST(count(*) FILTER (ref_tier = 'strong') AS BIGINT) AS strong, count(DISTINCT file_id) AS files
    FROM refs WHERE target_def_uid IS NOT NULL GROUP BY 1""")
def _(f):
    tier = [F.sum((F.col("ref_tier") == t).cast("long")).alias(t) for t in ("proven", "strong")]
    return f.refs.where("target_def_uid IS NOT NULL").groupBy(F.col("target_def_uid").alias("def_uid")).agg(F.count("*").alias("refs"), *tier, F.countDistinct("file_id").alias("files"))


@query("o117_export_pairs", f"""
    WITH m AS ({MODULES}), p AS (SELECT i.unit_id AS source_unit, m.unit_id AS target_unit, count(DISTINCT imported_name) AS names FROM imports i JOIN m ON m.declared_module = i.source_literal GROUP BY 1, 2)
    SELECT * FROM p WHERE source_unit <> target_unit""")
def _(f):
    modules = f.files.select(F.col("declared_module").alias("source_literal"), (1 + F.col("id") % 4).alias("target_unit")).distinct()
    j = f.imports.join(modules, "source_literal").where("unit_id <> target_unit")
    return j.groupBy(F.col("unit_id").alias("source_unit"), "target_unit").agg(F.countDistinct("imported_name").alias("names"))


@query("o116_label_join", """
    SELECT d.doc_id, d.lang, coalesce(CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 2 WHEN l.quality = 1 THEN 1 ELSE 0 END, 0) AS relevance FROM documents d LEFT JOIN labels l USING (doc_id)""")
def _(f):
    tier = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).when(F.col("quality") == 1, 1).otherwise(0)
    return f.documents.select("doc_id", "lang").join(f.labels, "doc_id", "left").select("doc_id", "lang", tier.alias("relevance"))


@query("o118_impact_refs", """
    WITH s AS (SELECT file_id, start_line FROM refs WHERE target_def_uid = 'd20'), lex AS (SELECT DISTINCT file_id, start_line FROM refs WHERE token_text = 'tok20')
    SELECT file_id, start_line, 'index' AS source FROM (SELECT DISTINCT * FROM s) UNION ALL SELECT file_id, start_line, 'lexical' FROM lex WHERE (file_id, start_line) NOT IN (SELECT file_id, start_line FROM s)""")
def _(f):
    known = f.refs.where("target_def_uid = 'd20'").select("file_id", "start_line").distinct()
    lexical = f.refs.where("token_text = 'tok20'").select("file_id", "start_line").distinct().join(known, ["file_id", "start_line"], "left_anti")
    return known.withColumn("source", F.lit("index")).unionByName(lexical.withColumn("source", F.lit("lexical")))


@query("o119_rename_candidates", """
    SELECT r.file_id, r.start_line AS line, CASE WHEN ref_tier IN ('proven', 'strong') THEN 'high' WHEN ref_tier = 'anchored' THEN 'medium' WHEN certainty = 'certain' THEN 'high' ELSE 'low' END AS certainty
    FROM refs r WHERE target_def_uid = 'd33' UNION ALL SELECT file_id, start_line, 'high' FROM defs WHERE def_uid = 'd33'""")
def _(f):
    refs = f.refs.where("target_def_uid = 'd33'").select("file_id", F.col("start_line").alias("line"), paths.rename_certainty(F.col("ref_tier"), F.col("certainty")).alias("certainty"))
    return refs.unionByName(f.defs.where("def_uid = 'd33'").select("file_id", F.col("start_line").alias("line"), F.lit("high").alias("certainty")))
