"""Queries of section 2.7: scalar functions, and the chunkers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import chunks
from .facts import spread
from .registry import query

LINES = "l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), e AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM l)"
CUT = """
    c AS (SELECT doc_id, min(i) AS start_line, max(i) AS end_line, arg_min(name, i) AS chunk_key, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\\s+|\\s+$', '', 'g') AS t FROM n GROUP BY doc_id, chunk)"""


@query("o200_markdown_chunks", f"""
    WITH {LINES.replace('text,', "replace(text, '. ', chr(10) || '# '),")}, b AS (SELECT *, regexp_matches(line, '^#{{1,6}}\\s+.+') AS h FROM e),
         n AS (SELECT *, sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS chunk, CASE WHEN h THEN trim(regexp_extract(line, '^#{{1,6}}\\s+(.+)', 1)) ELSE 'preamble' END AS name FROM b), {CUT}
    SELECT doc_id, chunk_key, substr(t, 1, 2000) AS chunk_text, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line FROM c WHERE length(t) >= 30""")
def _(f):
    return chunks.markdown(f.documents.withColumn("text", F.regexp_replace("text", r"\. ", "\n# ")), "doc_id")


@query("o200_key_value_chunks", f"""
    WITH {LINES.replace('text,', "replace(text, '. ', chr(10) || 'key: '),")}, b AS (SELECT *, regexp_matches(line, '^[a-zA-Z_][a-zA-Z0-9_.-]*\\s*[:=]') AS h FROM e),
         n AS (SELECT *, sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS chunk, CASE WHEN h THEN regexp_extract(line, '^([a-zA-Z_][a-zA-Z0-9_.-]*)\\s*[:=]', 1) ELSE 'header' END AS name FROM b), {CUT}
    SELECT doc_id, chunk_key, substr(t, 1, 2000) AS chunk_text, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line FROM c WHERE length(t) >= 30""")
def _(f):
    return chunks.key_value(f.documents.withColumn("text", F.regexp_replace("text", r"\. ", "\nkey: ")), "doc_id")


@query("o200_paragraph_chunks")
def _(f):
    return chunks.paragraphs(f.documents.withColumn("text", F.regexp_replace("text", r"\. ", "\n\n\n")), "doc_id")


@query("o180_word_split", "SELECT def_uid, array_to_string(string_split(lower(name), '_'), ' ') AS words FROM defs")
def _(f):
    return f.defs.select("def_uid", F.array_join(text.word_split(F.col("name")), " ").alias("words"))


@query("o181_path_phrase", "SELECT path, regexp_replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(path, '^src/', ''), '\\.[a-z]+$', ''), '/', ' '), '_', ' '), '([a-z])([0-9])', '\\1 \\2', 'g'), '\\s+', ' ', 'g') AS phrase FROM files")
def _(f):
    return f.files.select("path", text.path_phrase(F.col("path")).alias("phrase"))


@query("o182_compact_signature", "SELECT def_uid, replace(name, '_', ' ') || replace(signature_text, 'self, ', '') AS signature FROM defs")
def _(f):
    return f.defs.select("def_uid", text.compact_signature(F.col("name"), F.col("signature_text")).alias("signature"))


@query("o183_scaffold", """
    WITH c AS (SELECT DISTINCT d.def_uid, t.name FROM refs r JOIN defs d ON d.file_id = r.file_id AND r.start_line BETWEEN d.start_line AND d.end_line JOIN defs t ON t.def_uid = r.target_def_uid WHERE d.def_uid <> t.def_uid),
         a AS (SELECT def_uid, list_slice(list_sort(list(name)), 1, 30) AS calls FROM c GROUP BY 1)
    SELECT d.def_uid, d.kind || ' ' || replace(d.name, '_', ' ') || replace(d.signature_text, 'self, ', '') AS head, coalesce('calls ' || array_to_string(calls, ', '), '') AS calls FROM defs d LEFT JOIN a USING (def_uid)""")
def _(f):
    from ..operators import joins

    names = f.defs.select(F.col("def_uid").alias("dst"), "name")
    calls = joins.enclosing_refs(f.refs, f.defs).join(names, "dst").groupBy(F.col("src").alias("def_uid")).agg(F.collect_set("name").alias("_calls"))
    d = f.defs.join(calls, "def_uid", "left").join(f.files.select(F.col("id").alias("file_id"), "path"), "file_id")
    whole = text.scaffold(F.col("path"), F.col("kind"), F.col("name"), F.col("signature_text"), F.col("qualified_name"), F.col("docstring"), F.col("_calls"), F.array().cast("array<string>"))
    lines = F.split(whole, "\n")
    return d.select("def_uid", F.get(lines, F.lit(1)).alias("head"), F.coalesce(F.get(F.filter(lines, lambda x: x.startswith("calls ")), F.lit(0)), F.lit("")).alias("calls"))


@query("o184_task_terms", """
    WITH t AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: length(x) >= 4)) AS w FROM benchmark), u AS (SELECT item_id, unnest(w) AS w FROM t)
    SELECT item_id, string_agg(w, ' ' ORDER BY length(w) DESC, w) AS terms FROM u GROUP BY 1""")
def _(f):
    return f.benchmark.select("item_id", F.array_join(text.task_terms(F.col("text")), " ").alias("terms")).where("terms <> ''")


TASK = "'change ' || p_name || CASE p_size % 5 WHEN 0 THEN ' but not ' || p_brand || '!' WHEN 1 THEN ' Without ' || p_type || ', skip   ' || p_brand WHEN 2 THEN ' except for a' WHEN 3 THEN ', ignore: none' ELSE ' and exclude x' END"


def tasks(f):
    return f.part.select("p_partkey", F.expr(TASK).alias("task"))


@query("o185_negative_mentions", f"""
    WITH t AS (SELECT p_partkey, {TASK} AS t FROM part), m AS (SELECT p_partkey, unnest(regexp_extract_all(t, '(?i)\\b(?:not|exclude|except|without|ignore|skip|excluding|except for)\\s+(\\S+)', 1)) AS w FROM t)
    SELECT DISTINCT p_partkey, trim(lower(w), '.,;:!?') AS negative FROM m WHERE length(trim(w, '.,;:!?')) >= 2""")
def _(f):
    return tasks(f).select("p_partkey", F.explode(text.negative_mentions(F.col("task"))).alias("negative"))


@query("o186_task_flags", """
    WITH t AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'a KeyError was raised in ' WHEN 1 THEN 'see the stack trace of ' WHEN 2 THEN 'increase coverage of ' ELSE 'the error in ' END || p_name AS t, p_size % 4 AS k FROM part)
    SELECT p_partkey, k IN (0, 1) AS is_stacktrace, k = 2 AS is_test_driven FROM t""")
def _(f):
    s = F.col("p_size") % 4
    task = F.concat(F.when(s == 0, "a KeyError was raised in ").when(s == 1, "see the stack trace of ").when(s == 2, "increase coverage of ").otherwise("the error in "), F.col("p_name"))
    return f.part.select("p_partkey", text.is_stacktrace(task).alias("is_stacktrace"), text.is_test_driven(task).alias("is_test_driven"))


@query("o186_intent", """
    WITH t AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'fix the error in ' WHEN 1 THEN 'add support for ' WHEN 2 THEN 'explain how ' ELSE 'a ' END || p_name AS t FROM part)
    SELECT p_partkey, CASE WHEN starts_with(t, 'fix') THEN 'debug' WHEN starts_with(t, 'add') THEN 'implement' WHEN starts_with(t, 'explain') THEN 'understand' ELSE 'unknown' END AS intent FROM t""")
def _(f):
    s = F.col("p_size") % 4
    task = F.concat(F.when(s == 0, "fix the error in ").when(s == 1, "add support for ").when(s == 2, "explain how ").otherwise("a "), F.col("p_name"))
    return f.part.select("p_partkey", text.intent(task).alias("intent"))


@query("o187_module_of", "SELECT path, replace(regexp_replace(regexp_replace(path, '\\.[a-z]+$', ''), '^src/', ''), '/', '.') AS module FROM files")
def _(f):
    from ..functions import paths

    return f.files.select("path", paths.module_of(F.col("path")).alias("module"))


@query("o188_def_uid", "SELECT def_uid, substr(sha256(CAST(unit_id AS STRING) || ':' || CAST(file_id AS STRING) || ':' || kind || ':' || lexical_path || ':' || signature_hash), 1, 16) AS uid FROM defs")
def _(f):
    return f.defs.select("def_uid", text.def_uid(F.col("unit_id").cast("string"), F.col("file_id").cast("string"), F.col("kind"), F.col("lexical_path"), F.col("signature_hash")).alias("uid"))


@query("o189_worktree_uid", "SELECT def_uid, CASE WHEN file_id % 3 = 0 THEN def_uid ELSE substr(sha256(CAST(1 + file_id % 3 AS STRING) || ':' || def_uid), 1, 16) END AS uid FROM defs")
def _(f):
    return f.defs.select("def_uid", text.worktree_uid(F.col("def_uid"), 1 + F.col("file_id") % 3, F.col("file_id") % 3 == 0).alias("uid"))


@query("o190_content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def _(f):
    from ..sources.files import content_hash

    return f.documents.select("doc_id", content_hash("text").alias("hash"))


@query("o191_lexical_path", "SELECT def_uid, lexical_path, CAST(len(string_split(lexical_path, '.')) AS BIGINT) AS depth FROM defs")
def _(f):
    return f.defs.select("def_uid", "lexical_path", F.size(F.split("lexical_path", r"\.")).cast("long").alias("depth"))


@query("o192_containing_scope", """
    WITH m AS (SELECT r.ref_id, s.scope_id, row_number() OVER (PARTITION BY r.ref_id ORDER BY CASE WHEN s.kind <> 'file' THEN 1 ELSE 2 END, s.end_line - s.start_line, s.scope_id) AS p FROM refs r JOIN scopes s ON s.file_id = r.file_id AND r.start_line BETWEEN s.start_line AND s.end_line)
    SELECT ref_id, scope_id FROM m WHERE p = 1""")
def _(f):
    from ..operators import joins

    return joins.innermost(f.refs.select("ref_id", "file_id", F.col("start_line").alias("_line")), "_line", f.scopes, "ref_id").select("ref_id", "scope_id")


@query("o193_sparse_codec", "SELECT p_partkey, round(p_retailprice / 7, 4) AS weight FROM part WHERE round(p_retailprice / 7, 4) <> 0")
def _(f):
    v = text.sparse_round(F.create_map(F.lit(1), F.col("p_retailprice") / 7))
    back = F.transform_keys(F.from_json(F.to_json(v), "map<string,double>"), lambda k, _: k.cast("int"))
    return f.part.select("p_partkey", F.element_at(back, 1).alias("weight"))


@query("o195_signature_parts", "SELECT def_uid, 'self, ' || regexp_extract(signature_text, '\\(self, ([^)]*)\\)', 1) AS params, trim(regexp_extract(signature_text, '->(.*)$', 1)) AS returns FROM defs")
def _(f):
    return f.defs.select("def_uid", text.parameters(F.col("signature_text")).alias("params"), text.return_type(F.col("signature_text")).alias("returns"))


@query("o196_delta_tags", """
    SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'symbol_added' WHEN 1 THEN 'symbol_renamed' WHEN 2 THEN CASE WHEN p_partkey % 30 <= 2 THEN 'minor_change,possibly_comment_or_whitespace' WHEN p_partkey % 30 = 3 THEN 'minor_change' WHEN p_partkey % 30 > 20 THEN 'major_change' ELSE 'body_logic_changed' END
        ELSE CASE WHEN p_partkey % 2 = 0 THEN 'parameters_changed' ELSE 'return_type_changed' END END AS tags FROM part""")
def _(f):
    s, k = F.col("p_size") % 4, F.col("p_partkey")
    change = F.when(s == 0, "added").when(s == 1, "renamed").when(s == 2, "body_changed").otherwise("signature_changed")
    tags = text.delta_tags(change, F.lit("f(a) -> int"), F.when(k % 2 == 0, "f(b) -> int").otherwise("f(a) -> str"), k % 30)
    return f.part.select("p_partkey", F.array_join(tags, ",").alias("tags"))


@query("o197_overlap", "SELECT def_uid, CASE WHEN least(end_line, 120) - greatest(start_line, 100) + 1 > 0 THEN least(end_line, 120) - greatest(start_line, 100) + 1 END AS n FROM defs")
def _(f):
    hunks = F.array(F.struct(F.lit(100).cast("long").alias("start"), F.lit(120).cast("long").alias("end")))
    return f.defs.select("def_uid", text.overlap(F.col("start_line"), F.col("end_line"), hunks).alias("n"))


@query("o199_behaviour_risk", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE CASE WHEN p_partkey % 20 > 10 THEN 'medium' ELSE 'unknown' END END AS risk FROM part")
def _(f):
    s = F.col("p_size") % 3
    change = F.when(s == 0, "added").when(s == 1, "removed").otherwise("body_changed")
    return f.part.select("p_partkey", text.behaviour_risk(change, F.col("p_partkey") % 20).alias("risk"))


@query("o201_cross_references", """
    SELECT def_uid, 1 AS line, name AS target, 'high' AS confidence FROM defs UNION ALL SELECT def_uid, 2, 'Brand' || file_id, 'high' FROM defs UNION ALL SELECT def_uid, 3, 'T' || file_id || '.run', 'high' FROM defs
    UNION ALL SELECT def_uid, 4, 'Result', 'high' FROM defs UNION ALL SELECT def_uid, 4, 'pkg' || file_id || '.Widget', 'medium' FROM defs WHERE file_id % 2 = 0 UNION ALL SELECT def_uid, 5, 'MyType', 'low' FROM defs""")
def _(f):
    k = F.col("file_id").cast("string")
    qualified = F.when(F.col("file_id") % 2 == 0, F.concat(F.lit(" pkg"), k, F.lit(".Widget"))).otherwise("")
    doc = F.concat(
        F.lit("Uses :func:`"), F.col("name"), F.lit("` here\nSee also `Brand"), k, F.lit("`\nas in [T"), k, F.lit(".run](x)\n  Returns: Result or"), qualified,
        F.lit("\nthen a.b.c of MyType\nclass NoType of plain Words"),
    )
    return spread(f.defs).select("def_uid", F.explode(text.cross_references(doc)).alias("x")).select("def_uid", F.col("x.line").alias("line"), "x.target", "x.confidence")


@query("o202_endpoints", """
    WITH e AS (SELECT id, lower(http_method) AS m, url_pattern AS u FROM endpoints), l AS (SELECT e.*, unnest(['python', 'javascript', 'go']) AS language FROM e)
    SELECT id, language, 1 AS line, 'server' AS kind, upper(m) AS method, u AS url FROM l UNION ALL SELECT id, language, 2, 'server', '*', 'p' || id FROM l UNION ALL
    SELECT id, language, 3, 'client', 'GET', '/' || id FROM l UNION ALL SELECT id, 'javascript', 4, 'server', upper(m), u FROM e""")
def _(f):
    m, u, k = F.lower("http_method"), F.col("url_pattern"), F.col("id").cast("string")
    tail = F.concat(F.lit("fetch('/"), k, F.lit("') or fetch('no path')"))
    python = F.concat(F.lit("@app."), m, F.lit('("'), u, F.lit('")\n  path("p'), k, F.lit('", view)\n'), tail)
    script = F.concat(F.lit("router."), m, F.lit("(`"), u, F.lit("`, f)\n@Controller('p"), k, F.lit("')\n"), tail, F.lit("\n@"), F.initcap(m), F.lit("('"), u, F.lit("')"))
    go = F.concat(F.lit("r."), F.upper(m), F.lit('("'), u, F.lit('", f)\nhttp.Handle("p'), k, F.lit('", f)\n'), tail)
    each = F.array(*[F.struct(F.lit(n).alias("language"), x.alias("source")) for n, x in (("python", python), ("javascript", script), ("go", go))])
    rows = f.endpoints.select("id", F.explode(each).alias("s")).select("id", "s.*")
    return rows.select("id", "language", F.explode(text.endpoints(F.col("source"), F.col("language"))).alias("x")).select("id", "language", "x.line", "x.kind", "x.method", "x.url")


@query("o203_percent_format", "SELECT s_suppkey, printf('%.1f%%', 100.0 * s_nationkey / 25) AS shown FROM supplier")
def _(f):
    return f.supplier.select("s_suppkey", F.format_string("%.1f%%", 100.0 * F.col("s_nationkey") / 25).alias("shown"))


@query("o204_test_ids", "SELECT test_id, split_part(test_id, '::', 1) AS path, split_part(test_id, '::', 2) AS name, bool_or(starts_with(test_id, 'tests/pkg1/')) AS failed FROM coverage GROUP BY ALL")
def _(f):
    parts = F.split("test_id", "::")
    failed = F.bool_or(F.col("test_id").startswith("tests/pkg1/") | F.lit("tests/pkg1/").startswith(F.col("test_id")))
    return f.coverage.groupBy("test_id", parts[0].alias("path"), parts[1].alias("name")).agg(failed.alias("failed"))


@query("o205_entropy", "WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), p AS (SELECT lang, n / sum(n) OVER (PARTITION BY lang) AS p FROM c) SELECT lang, round(-sum(p * ln(p)), 6) AS entropy, count(*) AS categories FROM p GROUP BY 1")
def _(f):
    from ..operators.aggregates import entropy

    return entropy(f.documents, "lang", "source")


@query("o206_json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(f):
    return f.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))
