"""Reference resolution: export surfaces, import chains, namespaces, members and shapes.

Passes are functions of the reference table; a cascade takes the first pass that
resolves a reference, in a fixed order, in place of updates in place.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from .graph import cut

EXPORTED = ["class", "function"]
#: Rows that every task may hold.
FEW = 20_000


def export_entries(defs: DataFrame, kinds: list[str] = EXPORTED) -> DataFrame:
    """unit_id, exported_name, def_uid: one definition for each name of a unit, the one with the smallest def_uid."""
    return defs.where(F.col("kind").isin(kinds)).groupBy("unit_id", F.col("name").alias("exported_name")).agg(F.min("def_uid").alias("def_uid"))


def cascade(refs: DataFrame, passes: list[tuple[str, DataFrame]]) -> DataFrame:
    """refs with target_def_uid from the first source that has one, and resolved_by; passes give (ref_id, def_uid)."""
    out = refs.withColumn("resolved_by", F.when(F.col("target_def_uid").isNotNull(), "known"))
    for name, found in passes:
        one = found.groupBy("ref_id").agg(F.min("def_uid").alias("_new"))
        out = out.join(one, "ref_id", "left")
        out = out.withColumn("resolved_by", F.coalesce("resolved_by", F.when(F.col("_new").isNotNull(), name)))
        out = out.withColumn("target_def_uid", F.coalesce("target_def_uid", "_new")).drop("_new")
    return out


def least(defs: DataFrame, *keys: str) -> DataFrame:
    """keys, def_uid: the smallest definition of each, so that a join by them keeps its references' number; broadcast if few, which is counted."""
    one = defs.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.min("def_uid").alias("def_uid"))
    return F.broadcast(one) if one.limit(FEW + 1).count() <= FEW else one


def by_namespace(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """ref_id, def_uid for refs (ref_id, name, namespace): a definition of the name in the same namespace or a parent of it."""
    asked = refs.select("ref_id", "name", F.explode(paths.prefixes(F.col("namespace"))).alias("namespace"))
    return asked.join(least(defs, "name", "namespace"), ["name", "namespace"]).groupBy("ref_id").agg(F.min("def_uid").alias("def_uid"))


def by_star_import(refs: DataFrame, imports: DataFrame, defs: DataFrame, files: DataFrame) -> DataFrame:
    """ref_id, def_uid for refs (ref_id, file_id, name): a top-level, public definition of a module that the file imports whole."""
    wild = imports.where(F.col("import_kind") == "wildcard").select("file_id", F.col("source_literal").alias("declared_module")).distinct()
    public = defs.where((F.col("lexical_path") == F.col("name")) & ~F.col("name").startswith("_"))
    offered = public.join(files.select(F.col("id").alias("file_id"), "declared_module"), "file_id").select("declared_module", "name", "def_uid")
    return refs.select("ref_id", "file_id", "name").join(wild, "file_id").join(offered, ["declared_module", "name"]).groupBy("ref_id").agg(F.min("def_uid").alias("def_uid"))


def by_import_chain(refs: DataFrame, imports: DataFrame, exports: DataFrame, modules: DataFrame) -> DataFrame:
    """ref_id, def_uid: local name, its import in the file, the module's unit, the unit's export."""
    bound = imports.select("file_id", F.coalesce("alias", "imported_name").alias("name"), "imported_name", "source_literal").distinct()
    units = modules.select(F.col("declared_module").alias("source_literal"), "unit_id")
    chain = refs.select("ref_id", "file_id", "name").join(bound, ["file_id", "name"]).join(units, "source_literal")
    return chain.join(exports, (chain["unit_id"] == exports["unit_id"]) & (chain["imported_name"] == exports["exported_name"])).groupBy("ref_id").agg(F.min("def_uid").alias("def_uid"))


def scope_ancestors(scopes: DataFrame, parent: str = "parent_scope_id", rounds: int | None = None) -> DataFrame:
    """scope_id, ancestor, depth: each scope with itself and its parents, up to rounds levels, or to the last parent."""
    level = scopes.select("scope_id", F.col("scope_id").alias("ancestor"), F.lit(0).alias("depth"))
    up = scopes.select(F.col("scope_id").alias("ancestor"), F.col(parent).alias("_up")).where("_up IS NOT NULL")
    if rounds is None:
        level, up = cut(level), cut(up)
    out, done = level, 0
    while done != rounds:
        level = level.join(up, "ancestor").select("scope_id", F.col("_up").alias("ancestor"), (F.col("depth") + 1).alias("depth"))
        if rounds is None:
            # a parent met before is a circle
            level = cut(level.join(out.select("scope_id", "ancestor"), ["scope_id", "ancestor"], "left_anti"))
            if not level.take(1):
                break
        out, done = out.unionByName(level), done + 1
    return out


def innermost_bind(uses: DataFrame, binds: DataFrame, ancestors: DataFrame) -> DataFrame:
    """use_id, bind_id: the binding of the name in the nearest scope outwards."""
    met = uses.join(ancestors, "scope_id").join(binds.select(F.col("scope_id").alias("ancestor"), "name", "bind_id"), ["ancestor", "name"])
    return met.groupBy("use_id").agg(F.min_by("bind_id", F.struct("depth", "bind_id")).alias("bind_id"))


def resolve_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """import_uid, resolved_path: the literal's module or its longest known parent; exact before parent, then by path."""
    asked = imports.select("import_uid", F.posexplode(paths.prefixes(F.col("source_literal"))).alias("_p", "declared_module"))
    met = asked.join(files.select("declared_module", "path"), "declared_module")
    return met.groupBy("import_uid").agg(F.min_by("path", F.struct("_p", "path")).alias("resolved_path"))


def import_candidates(literal: Column, importer: Column) -> Column:
    """Paths that a dotted or relative import may mean, best first."""
    folder = F.regexp_replace(importer, "/?[^/]*$", "")
    dots = F.length(F.regexp_extract(literal, r"^(\.*)", 1))
    rest = F.translate(F.regexp_replace(literal, r"^\.+", ""), ".", "/")
    parts = F.split(folder, "/")
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - F.greatest(dots - 1, F.lit(0)), F.lit(0))), "/")
    stem = F.when(dots > 0, F.concat(base, F.when(rest != "", F.concat(F.lit("/"), rest)).otherwise(F.lit("")))).otherwise(rest)
    plain = [F.concat(stem, F.lit(".py")), F.concat(stem, F.lit("/__init__.py"))]
    rooted = [F.concat(F.lit("src/"), stem, F.lit(x)) for x in (".py", "/__init__.py")]
    return F.array(*plain, *rooted)


# What is tried for a file's name, in this order.
JS_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".mts"]
INCLUDE_FOLDERS = ["include", "src", "lib", "third_party"]
LUA_FOLDERS = ["", "src/", "lib/", "lua/"]
IMPORT_KINDS = {
    "python": ["python_import", "python_from"], "js": ["js_import", "js_require", "js_dynamic_import", "js_reexport"], "c": ["c_include"], "lua": ["lua_require"],
}


def normal_path(path: Column) -> Column:
    """Without "." parts, and with each ".." taking the part before it."""
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part.isin("", "."), done).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), none, step), "/")


def path_candidates(literal: Column, importer: Column, kind: Column) -> Column:
    """Paths that an import may mean by its kind, best first; none for kinds that name declared modules."""
    folder = F.regexp_replace(importer, "/?[^/]*$", "")
    beside = normal_path(F.concat_ws("/", folder, literal))
    stem = F.regexp_replace(beside, r"\.(js|jsx|mjs)$", "")
    js = F.array(beside, *[F.concat(stem, F.lit(x)) for x in JS_EXTENSIONS], *[F.concat(beside, F.lit(f"/index{x}")) for x in JS_EXTENSIONS])
    c = F.array(beside, literal, *[F.concat(F.lit(f"{x}/"), literal) for x in INCLUDE_FOLDERS])
    plain = F.translate(literal, ".", "/")
    lua = F.array(*[F.concat(F.lit(x), plain, F.lit(y)) for x in LUA_FOLDERS for y in (".lua", "/init.lua")])
    none = F.array().cast("array<string>")
    return (
        F.when(kind.isin(IMPORT_KINDS["python"]), import_candidates(literal, importer)).when(kind.isin(IMPORT_KINDS["js"]) & literal.startswith("."), js)
        .when(kind.isin(IMPORT_KINDS["c"]), c).when(kind.isin(IMPORT_KINDS["lua"]), lua).otherwise(none)
    )


def module_candidates(literal: Column, kind: Column) -> Column:
    """Declared modules that an import of another kind may name: itself, then its beginnings, the longest first."""
    plain = F.when(kind == "php_use", F.translate(literal, "\\", ".")).otherwise(literal)

    def beginnings(mark: str) -> Column:
        parts = F.split(plain, re.escape(mark))
        return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), mark))

    known = [k for kinds in IMPORT_KINDS.values() for k in kinds]
    none = F.array().cast("array<string>")
    return F.when(kind.isin(known), none).when(kind == "rust_use", beginnings("::")).when(kind == "go_import", beginnings("/")).otherwise(beginnings("."))


def import_paths(imports: DataFrame, files: DataFrame) -> DataFrame:
    """import_uid, path for imports (import_uid, source_literal, import_kind, importer_path): the first candidate that is a file.

    A module's file for a beginning of the literal must bear the name of what follows it.
    """
    literal, kind = F.col("source_literal"), F.col("import_kind")
    by_path = imports.select("import_uid", F.posexplode(path_candidates(literal, F.col("importer_path"), kind)).alias("_p", "path"))
    found = by_path.join(files.select("path"), "path").select("import_uid", "_p", "path")
    tail = F.lower(F.regexp_extract(literal, r"([^./:\\]+)$", 1))
    by_module = imports.select("import_uid", tail.alias("_tail"), F.posexplode(module_candidates(literal, kind)).alias("_p", "declared_module"))
    stem = F.lower(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1))
    met = by_module.join(files.select("declared_module", "path"), "declared_module").where((F.col("_p") == 0) | (stem == F.col("_tail")))
    every = found.unionByName(met.select("import_uid", "_p", "path"))
    return every.groupBy("import_uid").agg(F.min(F.struct("_p", "path"))["path"].alias("path"))


def by_package(refs: DataFrame, packages: DataFrame, defs: DataFrame, exported: Column | None = None) -> DataFrame:
    """ref_id, def_uid for refs (ref_id, file_id, name): a definition in a file that the reference's file imports whole (file_id, source_file_id)."""
    offered = defs.where(exported) if exported is not None else defs
    packages = packages.distinct()
    offered = offered.withColumnRenamed("file_id", "source_file_id").join(packages.select("source_file_id").distinct(), "source_file_id", "left_semi")
    offered = least(offered, "source_file_id", "name")
    met = refs.select("ref_id", "file_id", "name").join(packages, "file_id").join(offered, ["source_file_id", "name"])
    return met.groupBy("ref_id").agg(F.min("def_uid").alias("def_uid"))


def by_go_dot(refs: DataFrame, imports: DataFrame, defs: DataFrame, files: DataFrame) -> DataFrame:
    """Go's dot imports: of the folder that is the longest ending of the import path, the last file without tests; capitalised names."""
    go = files.where(F.col("path").rlike(r"/[^/]*\.go$") & ~F.col("path").endswith("_test.go"))
    folders = go.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("package")).agg(F.max("id").alias("source_file_id"))
    dots = imports.where("import_kind = 'go_import' AND imported_name = '*'").select("file_id", F.array_compact(F.transform(F.split("source_literal", "/"), lambda x: F.nullif(x, F.lit("")))).alias("_s")).distinct()
    n = F.size("_s")
    endings = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(F.col("_s"), i, n), "/"))
    asked = dots.where(n > 0).select("file_id", F.col("_s"), F.posexplode(endings).alias("_p", "package"))
    best = asked.join(folders, "package").groupBy("file_id", "_s").agg(F.min(F.struct("_p", "source_file_id"))["source_file_id"].alias("source_file_id"))
    return by_package(refs, best.select("file_id", "source_file_id"), defs, F.col("name").rlike("^[A-Z]"))


def rust_module(path: Column) -> Column:
    """Module path of a Rust file."""
    stem = F.regexp_replace(F.regexp_replace(path, r"\.rs$", ""), r"/(lib|mod)$", "")
    return F.when(stem.endswith("/main"), "crate").otherwise(F.regexp_replace(F.regexp_replace(stem, "/", "::"), "^src::", "crate::"))


def by_rust_glob(refs: DataFrame, imports: DataFrame, defs: DataFrame, files: DataFrame) -> DataFrame:
    """Rust's glob imports: the file of the module, or else the first whose module ends with the same segment."""
    modules = files.where(F.col("path").endswith(".rs")).select(F.col("id").alias("source_file_id"), rust_module(F.col("path")).alias("_m"))
    last = lambda c: F.element_at(F.split(c, "::"), -1).alias("_last")
    globs = imports.where("import_kind = 'rust_use' AND imported_name = '*'").select("file_id", F.col("source_literal").alias("_l")).distinct()
    met = globs.select("file_id", "_l", last(F.col("_l"))).join(modules.select("source_file_id", "_m", last(F.col("_m"))), "_last")
    best = met.groupBy("file_id", "_l").agg(F.min(F.struct(F.col("_m") != F.col("_l"), "source_file_id"))["source_file_id"].alias("source_file_id"))
    return by_package(refs, best.select("file_id", "source_file_id"), defs)


def by_java_star(refs: DataFrame, imports: DataFrame, defs: DataFrame, kinds: list[str]) -> DataFrame:
    """Java's star imports: a type of the name in the imported namespace."""
    stars = imports.where("import_kind = 'java_import' AND imported_name = '*'").select("file_id", F.col("source_literal").alias("namespace")).distinct()
    types = least(defs.where(F.col("kind").isin(kinds)), "namespace", "name")
    return refs.select("ref_id", "file_id", "name").join(stars, "file_id").join(types, ["namespace", "name"]).groupBy("ref_id").agg(F.min("def_uid").alias("def_uid"))


def trace_members(starts: DataFrame, members: DataFrame, depth: int | None = None) -> DataFrame:
    """Walk a chain of members from a type, up to depth links or to its end: (id, type, chain array) to (id, type, steps, confidence)."""
    state = starts.select("id", F.col("type"), "chain", F.lit(0).alias("steps"), F.lit(True).alias("on"))
    done = 0
    while done != depth:
        name = F.get("chain", F.col("steps"))
        asked = state.withColumn("_m", F.when(F.col("on"), name))
        step = members.select(F.col("base_type").alias("type"), F.col("member_name").alias("_m"), F.col("member_type").alias("_t"))
        met = asked.join(step, ["type", "_m"], "left")
        go = F.col("_t").isNotNull()
        state = met.select("id", F.coalesce("_t", "type").alias("type"), "chain", (F.col("steps") + go.cast("int")).alias("steps"), (F.col("on") & go).alias("on"))
        done += 1
        if depth is None:
            state = cut(state)
            if not state.where("on").take(1):
                break
    return state.select("id", "type", "steps", F.round(F.col("steps") / F.size("chain"), 6).alias("confidence"))


def match_shapes(shapes: DataFrame, members: DataFrame, least: float = 0.7) -> DataFrame:
    """shape_id, base_type, confidence, ambiguous: types that have enough of a shape's observed members.

    Confidence is the share of the members plus a tenth of the methods' share, at most 1.
    """
    seen = shapes.select("shape_id", F.size("observed").alias("_n"), F.explode("observed").alias("member_name"))
    met = seen.join(members.select("base_type", "member_name", "member_kind").distinct(), "member_name")
    share = F.countDistinct("member_name") / F.max("_n")
    methods = F.countDistinct(F.when(F.col("member_kind") == "method", F.col("member_name"))) / F.max("_n")
    scored = met.groupBy("shape_id", "base_type").agg(F.round(F.least(F.lit(1.0), share + 0.1 * methods), 6).alias("confidence")).where(F.col("confidence") >= least)
    return scored.withColumn("ambiguous", F.count("*").over(Window.partitionBy("shape_id")) > 1)


def self_types(receivers: DataFrame, classes: DataFrame) -> DataFrame:
    """id, class_uid: the tightest class around each receiver (id, file_id, line)."""
    from .joins import contained

    met = contained(receivers, "line", classes, ["file_id"])
    return met.groupBy("id").agg(F.min_by("def_uid", F.struct(F.col("end_line") - F.col("start_line"), "def_uid")).alias("class_uid"))


def xref_targets(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """id, def_uid: the target by uid, else simple name, else last part of the qualified name; the smallest uid of the best way."""
    last = F.element_at(F.split("qualified_name", r"\."), -1)
    ways = F.array(*[F.struct(c.alias("target"), F.lit(w).alias("_w")) for w, c in enumerate((F.col("def_uid"), F.col("name"), last))])
    named = defs.select("def_uid", F.explode(ways).alias("_x")).where("_x.target IS NOT NULL")
    # one definition for each target: a name that very many bear meets its references once
    best = named.groupBy("_x.target").agg(F.min(F.struct("_x._w", "def_uid")).alias("_b"))
    return refs.join(best, "target").groupBy("id").agg(F.min("_b").alias("_b")).select("id", "_b.def_uid")


def config_references(files: DataFrame, known: DataFrame) -> DataFrame:
    """path, target: quoted strings and bare tokens of config texts that name known files."""
    tokens = F.array_distinct(F.concat(F.regexp_extract_all("text", F.lit("""["']([\\w./-]+)["']"""), F.lit(1)), F.regexp_extract_all("text", F.lit(r"(?:^|\s)([\w.-]+/[\w./-]+)"), F.lit(1))))
    named = files.select("path", F.explode(tokens).alias("target")).where("path <> target")
    return named.join(known.select(F.col("path").alias("target")), "target", "left_semi").select("path", "target")
