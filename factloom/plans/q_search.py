"""Queries of sections 2.2 and 2.8: lexical search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..operators import search
from .registry import query

BM25 = """
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM documents),
         d AS (SELECT doc_id, CAST(len(t) AS BIGINT) AS dl, unnest(t) AS term FROM w),
         tf AS (SELECT doc_id, term, count(*) AS tf, max(dl) AS dl FROM d GROUP BY ALL),
         df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
         s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM w),
         q AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM benchmark),
         r AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
               FROM q JOIN tf USING (term) JOIN df USING (term), s GROUP BY ALL),
         k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r)
    SELECT item_id, doc_id, score, rank FROM k WHERE rank <= 20"""


@query("o215_bm25_top20", BM25)
def bm25_files(f):
    scored = search.bm25(f.documents, f.benchmark, "doc_id", "item_id").withColumn("score", F.round("score", 6))
    return search.top_k(scored, "item_id", "score", "doc_id", 20).select("item_id", "doc_id", "score", "rank")


@query("o043_term_search", """
    SELECT def_uid, name FROM defs WHERE contains(lower(name), 'ring') OR contains(lower(qualified_name), 'ring') OR contains(lower(coalesce(docstring, '')), 'ring')
        OR contains(lower(lexical_path), 'ring') ORDER BY def_uid LIMIT 200""")
def _(f):
    return search.substring_search(f.defs, "Ring", ["name", "qualified_name", "docstring", "lexical_path"], "def_uid").select("def_uid", "name")


@query("o044_file_term_search", "SELECT path FROM files WHERE contains(lower(path), 'pkg1') ORDER BY path LIMIT 100")
def _(f):
    return search.substring_search(f.files, "pkg1", ["path"], "path", 100).select("path")


@query("o045_symbol_search", """
    SELECT def_uid, name, CASE WHEN lower(name) = 'red_bolt' THEN 1.0 WHEN starts_with(lower(name), 'red_bolt') THEN 0.8 ELSE 0.6 END AS score
    FROM defs WHERE contains(lower(name), 'red_bolt') ORDER BY score DESC, name, def_uid LIMIT 50""")
def _(f):
    return search.symbol_search(f.defs, "red_bolt", ["name", "def_uid"], 50).select("def_uid", "name", "score")


@query("o046_search_facade", """
    SELECT d.def_uid, f.path FROM defs d JOIN files f ON f.id = d.file_id
    WHERE contains(lower(d.name), 'widget') AND f.language_family = 'python' AND starts_with(f.path, 'src/') ORDER BY d.def_uid LIMIT 20 OFFSET 5""")
def _(f):
    files = f.files.where("language_family = 'python'").where(paths.matches_filter(F.col("path"), ["src"]))
    found = f.defs.where(F.contains(F.lower("name"), F.lit("widget"))).join(files, F.col("file_id") == F.col("id"))
    return found.select("def_uid", "path").orderBy("def_uid").offset(5).limit(20)


@query("o047_line_search", """
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
    SELECT doc_id, CAST(line_no AS BIGINT) AS line, line AS snippet FROM l
    WHERE ((contains(lower(line), 'the') AND contains(lower(line), 'tion')) OR contains(lower(line), 'und der')) AND NOT contains(lower(line), 'when')""")
def _(f):
    return search.line_search(f.documents, "doc_id", 'the tion OR "und der" NOT when')


@query("o050_snippets", """
    WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
         e AS (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM l)
    SELECT doc_id, CAST(i AS BIGINT) AS line, array_to_string(list_slice(lines, greatest(i - 1, 1), least(i + 1, len(lines))), chr(10)) AS snippet
    FROM e WHERE contains(lower(lines[i]), 'idiot')""")
def _(f):
    return search.line_search(f.documents, "doc_id", "idiot", context=1)


@query("o048_query_parser", "SELECT doc_id FROM documents WHERE contains(lower(text), 'of the') AND NOT contains(lower(text), 'by the')")
def _(f):
    return f.documents.where(search.predicate(search.parse('"of the" AND NOT "by the"'), F.col("text"))).select("doc_id")


@query("o049_boolean_terms", "SELECT doc_id FROM documents WHERE (contains(lower(text), 'ing') AND contains(lower(text), 'ouen')) OR contains(lower(text), 'que')")
def _(f):
    return f.documents.where(search.predicate(search.parse("ing ouen OR que"), F.col("text"))).select("doc_id")


@query("o051_field_search", "SELECT id, path FROM files WHERE contains(lower(path), 'test_m1')")
def _(f):
    value = dict(search.parse("path:test_m1").fields)["path"]
    return f.files.where(F.contains(F.lower("path"), F.lit(value))).select("id", "path")


@query("o053_glob", "SELECT path, regexp_matches(path, '(?:^|.*/)src/(?:.+/)?m[^/]*\\.py$') AS a, regexp_matches(path, '(?:^|/)test_[^/]*$') AS b FROM files")
def _(f):
    p = F.col("path")
    return f.files.select("path", paths.matches_glob(p, "src/**/m*.py").alias("a"), paths.matches_glob(p, "test_*").alias("b"))


@query("o054_path_filter", "SELECT path FROM files WHERE path = 'src/pkg1/m1.go' OR starts_with(path, 'src/pkg2/') OR regexp_matches(path, '(?:^|/)[^/]*\\.md$')")
def _(f):
    return f.files.where(paths.matches_filter(F.col("path"), ["src/pkg1/m1.go", "src/pkg2", "*.md"])).select("path")


@query("o055_include_exclude", "SELECT path FROM files WHERE ends_with(path, '.py') AND NOT starts_with(path, 'tests/')")
def _(f):
    return f.files.where(paths.included(F.col("path"), ["*.py"], ["tests/**"])).select("path")


@query("o056_artifact_class", """
    SELECT path, CASE WHEN starts_with(path, 'tests/') THEN 'test' WHEN ends_with(path, '.md') THEN 'doc' ELSE 'code' END AS artifact,
           starts_with(path, 'tests/') AS is_test, CASE WHEN starts_with(path, 'tests/') THEN 'test' WHEN ends_with(path, '.md') THEN 'docs' ELSE 'prod' END AS category FROM files""")
def _(f):
    p = F.col("path")
    return f.files.select("path", paths.artifact(p).alias("artifact"), paths.is_test(p).alias("is_test"), paths.diff_category(p).alias("category"))


NAMES = "['src/a/__init__.py', 'web/index.ts', 'tests/unit/test_x.py', 'pkg/x_test.py', 'src/mod.rs', 'setup.cfg', 'conf/app.yaml', 'app.yaml', 'docs/guide.txt', 'README', 'src/pom.xml', 'conf/data.xml', 'lib/main.go']"


def named_paths(f):
    """Each file beside a name that tells its class."""
    names = F.expr("array" + NAMES.replace("[", "(").replace("]", ")"))
    return f.files.select("id", F.get(names, (F.col("id") % 13).cast("int")).alias("path"))


@query("o057_test_and_barrel_files", f"SELECT id, path, id % 13 IN (2, 3) AS is_test, id % 13 IN (0, 1, 4) AS is_barrel FROM (SELECT id, {NAMES}[id % 13 + 1] AS path FROM files)")
def _(f):
    p = F.col("path")
    return named_paths(f).select("id", "path", paths.is_test(p).alias("is_test"), paths.is_barrel(p).alias("is_barrel"))


@query("o058_diff_category", f"""
    SELECT id, path, CASE id % 13 WHEN 2 THEN 'test' WHEN 3 THEN 'test' WHEN 5 THEN 'build' WHEN 7 THEN 'config' WHEN 8 THEN 'docs' WHEN 9 THEN 'docs' WHEN 10 THEN 'build' ELSE 'prod' END AS category,
        CASE id % 13 WHEN 2 THEN 'test' WHEN 3 THEN 'test' WHEN 5 THEN 'config' WHEN 6 THEN 'config' WHEN 7 THEN 'config' WHEN 8 THEN 'doc' WHEN 10 THEN 'config' WHEN 11 THEN 'config' ELSE 'code' END AS artifact
    FROM (SELECT id, {NAMES}[id % 13 + 1] AS path FROM files)""")
def _(f):
    p = F.col("path")
    return named_paths(f).select("id", "path", paths.diff_category(p).alias("category"), paths.artifact(p).alias("artifact"))


@query("o059_rename_certainty", """
    SELECT ref_id, CASE WHEN ref_tier IN ('proven', 'strong') THEN 'high' WHEN ref_tier = 'anchored' THEN 'medium' WHEN certainty = 'certain' THEN 'high' ELSE 'low' END AS level FROM refs""")
def _(f):
    return f.refs.select("ref_id", paths.rename_certainty(F.col("ref_tier"), F.col("certainty")).alias("level"))


@query("o063_test_pairs", """
    WITH s AS (SELECT path, split_part(path, '/', 2) AS sub, split_part(path, '/', 3) AS name FROM files WHERE ends_with(path, '.py') AND starts_with(path, 'src/'))
    SELECT path, unnest(list_distinct(['tests/' || sub || '/test_' || name, 'tests/test_' || name, 'src/' || sub || '/test_' || name])) AS pair FROM s""")
def _(f):
    return f.files.select("path", F.explode(paths.test_pairs(F.col("path"))).alias("pair"))


@query("o140_term_harvest", """
    WITH t AS (SELECT unnest(['ring', 'bolt', 'red_w']) AS term),
         m AS (SELECT d.def_uid, t.term FROM defs d JOIN t ON contains(lower(d.name), t.term) OR contains(lower(coalesce(d.docstring, '')), t.term)),
         c AS (SELECT term, count(*) AS total FROM m GROUP BY 1),
         k AS (SELECT m.*, row_number() OVER (PARTITION BY term ORDER BY def_uid) AS p FROM m)
    SELECT def_uid, count(*) AS term_match_count, max(total) AS best_total FROM k JOIN c USING (term) WHERE p <= 200 GROUP BY 1""")
def _(f):
    terms = f.spark.createDataFrame([("ring",), ("bolt",), ("red_w",)], "term string")
    return search.term_harvest(f.defs, terms, ["name", "docstring"])


@query("o176_worktree_overlay", """
    WITH h AS (SELECT path, worktree_id AS priority, CAST(line_count AS DOUBLE) AS score, id FROM files),
         r AS (SELECT regexp_replace(path, '[0-9]+\\.', '.') AS path, priority, score FROM h),
         k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY priority, score DESC) AS p FROM r)
    SELECT path, priority, score FROM k WHERE p = 1""")
def _(f):
    hits = f.files.select(F.regexp_replace("path", r"[0-9]+\.", ".").alias("path"), F.col("worktree_id").alias("priority"), F.col("line_count").cast("double").alias("score"))
    return search.overlay(hits)


@query("o052_escape", "SELECT part.p_partkey, regexp_replace(p_brand, '([#+&|!(){}^~*?:/-])', '\\\\\\1', 'g') AS escaped FROM part")
def _(f):
    return f.part.select("p_partkey", F.regexp_replace("p_brand", r"([#+&|!(){}^~*?:/-])", r"\\$1").alias("escaped"))
