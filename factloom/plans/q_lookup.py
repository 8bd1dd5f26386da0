"""Queries of section 2.1 (look-ups), and of the simple predicates of 2.2."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..operators import lookup
from .registry import query

DEF = "def_uid, file_id, kind, name, start_line"


@query("o001_point_lookup", f"SELECT {DEF} FROM defs WHERE def_uid = 'd17'")
def _(f):
    return lookup.by_key(f.defs, "def_uid", "d17").select(*DEF.split(", "))


@query("o002_batched_key_lookup", f"SELECT {DEF} FROM defs WHERE def_uid IN ('d1', 'd5', 'd99', 'nosuch')")
def _(f):
    return lookup.by_keys(f.defs, "def_uid", ["d1", "d5", "d99", "nosuch"]).select(*DEF.split(", "))


@query("o003_batch_lookup_by_table", f"SELECT {DEF} FROM defs WHERE def_uid IN (SELECT target_def_uid FROM refs WHERE token_text = 'tok3')")
def _(f):
    keys = f.refs.where("token_text = 'tok3'").select(F.col("target_def_uid").alias("def_uid"))
    return lookup.by_keys(f.defs, "def_uid", keys).select(*DEF.split(", "))


@query("o004_first_def_by_name", f"SELECT {DEF} FROM defs WHERE name = 'red_widget' ORDER BY def_uid LIMIT 3")
def _(f):
    return lookup.scan(f.defs, ["def_uid"], 3, name="red_widget").select(*DEF.split(", "))


@query("o005_defs_by_name_in_unit", f"SELECT {DEF} FROM defs WHERE unit_id = 2 AND name = 'blue_bolt' ORDER BY def_uid LIMIT 10")
def _(f):
    return lookup.scan(f.defs, ["def_uid"], 10, unit_id=2, name="blue_bolt").select(*DEF.split(", "))


@query("o006_defs_in_file", f"SELECT {DEF} FROM defs WHERE file_id = 4 ORDER BY start_line, def_uid LIMIT 1000")
def _(f):
    return lookup.scan(f.defs, ["start_line", "def_uid"], 1000, file_id=4).select(*DEF.split(", "))


@query("o007_refs_by_token", "SELECT ref_id, file_id, start_line, ref_tier FROM refs WHERE token_text = 'tok7' ORDER BY ref_id LIMIT 200")
def _(f):
    return lookup.scan(f.refs, ["ref_id"], 200, token_text="tok7").select("ref_id", "file_id", "start_line", "ref_tier")


@query("o008_scopes_in_file", "SELECT scope_id, kind, start_line, end_line FROM scopes WHERE file_id = 3")
def _(f):
    return lookup.by_key(f.scopes, "file_id", 3).select("scope_id", "kind", "start_line", "end_line")


@query("o009_imports_of_file", "SELECT import_uid, imported_name, source_literal, start_line FROM imports WHERE file_id = 9 ORDER BY start_line, import_uid LIMIT 100")
def _(f):
    return lookup.scan(f.imports, ["start_line", "import_uid"], 100, file_id=9).select("import_uid", "imported_name", "source_literal", "start_line")


@query("o010_export_entries", "SELECT unit_id, min(def_uid) AS def_uid, name AS exported_name FROM defs WHERE kind IN ('class', 'function') AND unit_id = 3 GROUP BY unit_id, name")
def _(f):
    from ..operators import resolve

    return resolve.export_entries(f.defs).where("unit_id = 3").select("unit_id", "def_uid", "exported_name")


@query("o011_null_aware_lookup", "SELECT ref_id, file_id FROM refs WHERE target_def_uid IS NULL AND token_text = 'tok1'")
def _(f):
    return lookup.scan(f.refs, ["ref_id"], None, target_def_uid=None, token_text="tok1").select("ref_id", "file_id")


@query("o012_files_capped_scan", "SELECT id, path FROM files ORDER BY id LIMIT 10000")
def _(f):
    return lookup.scan(f.files, ["id"], 10000).select("id", "path")


@query("o013_indexed_files", "SELECT id, path FROM files WHERE language_family = 'python' AND starts_with(path, 'src/pkg1')")
def _(f):
    return lookup.indexed_files(f.files, "python", "src/pkg1").select("id", "path")


@query("o016_language_family", """
    SELECT path, CASE WHEN ends_with(path, '.py') THEN 'python' WHEN ends_with(path, '.go') THEN 'go' WHEN ends_with(path, '.java') THEN 'java' WHEN ends_with(path, '.md') THEN 'markdown' END AS family FROM files""")
def _(f):
    return f.files.select("path", paths.language_family(F.col("path")).alias("family"))


@query("o017_read_text_safely", "SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(1 + length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS lines FROM documents")
def _(f):
    from ..sources import files

    raw = f.documents.select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return files.safe_text(raw).select("doc_id", F.char_length("text").cast("long").alias("chars"), F.size(F.split("text", "\n")).cast("long").alias("lines"))


@query("o060_entry_points", """
    SELECT def_uid, name FROM defs WHERE kind IN ('function', 'class') AND (name IN ('red_widget', 'small_ring')
        OR file_id IN (SELECT id FROM files WHERE ends_with(path, 'm14.py') OR ends_with(path, 'm25.py')))""")
def _(f):
    found = lookup.entry_points(f.defs, f.files, ["function", "class"], ["red_widget", "small_ring"], F.col("path").rlike(r"m(14|25)\.py$"))
    return found.select("def_uid", "name")


@query("o061_freshness", "SELECT id, CASE WHEN indexed_at IS NULL THEN 'unindexed' ELSE 'clean' END AS state FROM files")
def _(f):
    return lookup.freshness(f.files).select("id", "state")


@query("o062_mutation_gate", "SELECT CASE WHEN indexed_at IS NULL THEN 'blocked' ELSE 'allowed' END AS gate, count(*) AS files FROM files GROUP BY 1")
def _(f):
    return lookup.mutation_gate(lookup.freshness(f.files))


@query("o164_pagination", "SELECT ref_id, target_def_uid FROM refs WHERE target_def_uid = 'd20' ORDER BY ref_id LIMIT 5 OFFSET 5")
def _(f):
    return lookup.scan(f.refs, ["ref_id"], 5, 5, target_def_uid="d20").select("ref_id", "target_def_uid")
