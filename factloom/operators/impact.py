"""Affected tests, blast radius, coverage gaps, governance gates and graph harvesting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from .joins import contained, test_file


def direct_importers(changed: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """path, module, match: files that import a changed file's module exactly, a parent of it, or something below it.

    Parents are exploded on whichever side is longer, so all three are equality joins.
    """
    modules = changed.join(files.select("path", "declared_module"), "path").select(F.col("declared_module").alias("module")).distinct()
    used = imports.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select("path", "source_literal")
    up = modules.select("module", F.posexplode(paths.prefixes(F.col("module"))).alias("_p", "source_literal"))
    exact_or_parent = used.join(up, "source_literal").select("path", "module", F.when(F.col("_p") == 0, "exact").otherwise("parent").alias("match"))
    down = used.select("path", "source_literal", F.posexplode(paths.prefixes(F.col("source_literal"))).alias("_p", "module")).where("_p > 0")
    child = down.join(modules, "module").select("path", "module", F.lit("child").alias("match"))
    return exact_or_parent.unionByName(child).distinct()


def transitive_importers(changed: DataFrame, edges: DataFrame, hops: int = 5, checkpoint=None) -> DataFrame:
    """path, hop: files that reach a changed one by import edges (src, dst), with the least hop; tests are not expanded.

    checkpoint cuts the lineage of each round's table, where the caller has a shared folder.
    """
    cut = checkpoint or (lambda df: df)
    seen = changed.select(F.col("path"), F.lit(0).alias("hop")).distinct()
    front = seen
    for hop in range(1, hops + 1):
        open_ = front.where(~paths.is_test(F.col("path")) | (F.col("hop") == 0)).select(F.col("path").alias("dst"))
        new = edges.join(open_, "dst", "left_semi").select(F.col("src").alias("path")).distinct()
        front = cut(new.join(seen, "path", "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(front)
    return seen.where("hop > 0")


def same_folder_tests(changed: DataFrame, files: DataFrame) -> DataFrame:
    """path, test: tests in the folder of a changed file."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    tests = files.where(paths.is_test(F.col("path"))).select(F.col("path").alias("test"), folder.alias("_folder"))
    return changed.select("path", folder.alias("_folder")).join(tests, "_folder").select("path", "test")


def imported_sources(files: DataFrame, imports: DataFrame) -> DataFrame:
    """test, module: internal modules that each test file imports."""
    tests = files.where(paths.is_test(F.col("path"))).select(F.col("id").alias("file_id"), F.col("path").alias("test"))
    internal = files.select(F.col("declared_module").alias("source_literal"))
    return imports.join(tests, "file_id").join(internal, "source_literal", "left_semi").select("test", F.col("source_literal").alias("module")).distinct()


def uncovered_modules(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Modules of source files that no test imports."""
    sources = files.where(~paths.is_test(F.col("path"))).select(F.regexp_replace("declared_module", r"^src\.", "").alias("module")).distinct()
    return sources.join(imported_sources(files, imports).select("module").distinct(), "module", "left_anti")


def uncovered_defs(defs: DataFrame, coverage: DataFrame, excluded: list[str], limit: int = 200) -> DataFrame:
    kept = defs.where(~F.col("kind").isin(excluded))
    return kept.join(coverage.select(F.col("target_def_uid").alias("def_uid")), "def_uid", "left_anti").orderBy("def_uid").limit(limit)


def covering_tests(defs: DataFrame, coverage: DataFrame, include_stale: bool = False) -> DataFrame:
    """def_uid, test_id of each definition; a definition without any has a null test."""
    facts = coverage if include_stale else coverage.where(~F.col("stale"))
    return defs.select("def_uid").join(facts.select(F.col("target_def_uid").alias("def_uid"), "test_id").distinct(), "def_uid", "left")


def blast_radius(changed: DataFrame, defs: DataFrame, refs: DataFrame, coverage: DataFrame, callers: int = 50, siblings: int = 30) -> DataFrame:
    """test_id, layer, confidence: tests of the changed definitions (0), of their callers (1), of their files' other definitions (2).

    A test stays in its first layer; limits take the first by test_id.
    """
    fresh = coverage.where(~F.col("stale")).select(F.col("target_def_uid").alias("def_uid"), "test_id").distinct()
    changed = changed.select("def_uid").distinct()
    direct = fresh.join(changed, "def_uid", "left_semi").select("test_id").distinct()
    points = refs.join(changed.withColumnRenamed("def_uid", "target_def_uid"), "target_def_uid", "left_semi").select("file_id", F.col("start_line").alias("_line"))
    spans = defs.select("file_id", "start_line", "end_line", "def_uid")
    calling = contained(points, "_line", spans, ["file_id"]).select("def_uid").distinct().join(changed, "def_uid", "left_anti")
    layer1 = fresh.join(calling, "def_uid", "left_semi").select("test_id").distinct().orderBy("test_id").limit(callers)
    at = defs.join(changed, "def_uid", "left_semi").select("file_id").distinct()
    near = defs.join(at, "file_id", "left_semi").select("def_uid").join(changed, "def_uid", "left_anti")
    layer2 = fresh.join(near, "def_uid", "left_semi").select("test_id").distinct().orderBy("test_id").limit(siblings)
    parts = [d.withColumn("layer", F.lit(i)).withColumn("confidence", F.lit(c)) for i, (d, c) in enumerate(((direct, 1.0), (layer1, 0.7), (layer2, 0.4)))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("test_id").agg(F.min("layer").alias("layer"), F.max("confidence").alias("confidence"))


def covered_by_test_files(coverage: DataFrame, test_files: DataFrame) -> DataFrame:
    facts = coverage.withColumn("path", test_file(F.col("test_id")))
    return facts.join(test_files.select("path").distinct(), "path", "left_semi").select(F.col("target_def_uid").alias("def_uid"), "path").distinct()


def test_debt(changed: DataFrame, files: DataFrame) -> DataFrame:
    """path, pair: changed sources with a test file that exists and hasn't changed."""
    pairs = changed.select("path", F.explode(paths.test_pairs(F.col("path"))).alias("pair"))
    known = files.select(F.col("path").alias("pair"))
    return pairs.join(known, "pair", "left_semi").join(changed.select(F.col("path").alias("pair")), "pair", "left_anti").select("path", "pair")


def gates(coverage: DataFrame, lint: DataFrame, debt: DataFrame, floor: float, most_errors: int) -> DataFrame:
    """rule, actual, violated of the governance rules; a floor of 0 means 0."""
    rate = coverage.where(~F.col("stale")).agg(F.round(100 * F.coalesce(F.avg("line_rate"), F.lit(0.0)), 4).alias("actual"))
    a = rate.select(F.lit("coverage_floor").alias("rule"), "actual", (F.col("actual") < floor).alias("violated"))
    errors = lint.agg(F.coalesce(F.sum("error_count"), F.lit(0)).cast("double").alias("actual"))
    b = errors.select(F.lit("lint_clean").alias("rule"), "actual", (F.col("actual") > most_errors).alias("violated"))
    c = debt.agg(F.count("*").cast("double").alias("actual")).select(F.lit("test_debt").alias("rule"), "actual", (F.col("actual") > 0).alias("violated"))
    return a.unionByName(b).unionByName(c)


# The order in which a kind of edge wins when a candidate is reached by several of the same seed.
EDGES = ["callee", "caller", "sibling", "implementor", "doc_xref"]


def graph_harvest(seeds: DataFrame, defs: DataFrame, refs: DataFrame, impls: DataFrame, xrefs: DataFrame) -> DataFrame:
    """def_uid, edge, seed_rank: definitions one step from a seed (def_uid, seed_rank), by the best ranked seed and first kind of edge.

    All seeds are expanded at once: one join for each kind of edge. Every task gets the seeds, on the caller's word that they are few.
    """
    from .joins import enclosing_refs

    s = F.broadcast(seeds.select(F.col("def_uid").alias("seed"), "seed_rank"))

    def of_seeds(df: DataFrame, column: str) -> DataFrame:
        return df.join(s.withColumnRenamed("seed", column), column, "left_semi")

    # an edge of any kind begins at a seed, so the seeds go first: neither all calls nor all pairs of an interface's implementors arise
    called = enclosing_refs(refs, F.broadcast(of_seeds(defs, "def_uid")))
    calling = enclosing_refs(of_seeds(refs, "target_def_uid"), defs)
    at = F.broadcast(of_seeds(defs.select(F.col("def_uid").alias("seed"), "file_id"), "seed"))
    mine = of_seeds(impls.select(F.col("implementor_def_uid").alias("seed"), "interface_name"), "seed").distinct()
    kinds = [
        called.select(F.col("src").alias("seed"), F.col("dst").alias("def_uid")), calling.select(F.col("dst").alias("seed"), F.col("src").alias("def_uid")),
        at.join(defs.select("file_id", "def_uid"), "file_id").select("seed", "def_uid"),
        mine.join(impls, "interface_name").select("seed", F.col("implementor_def_uid").alias("def_uid")), xrefs.select(F.col("source_def_uid").alias("seed"), F.col("target_def_uid").alias("def_uid")),
    ]
    found = None
    for i, k in enumerate(kinds):
        part = k.join(s, "seed").where("seed <> def_uid").select("def_uid", F.lit(i).alias("_k"), "seed_rank")
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("def_uid").agg(F.min(F.struct("seed_rank", "_k")).alias("_b"))
    names = F.array(*[F.lit(e) for e in EDGES])
    known = best.join(defs.select("def_uid"), "def_uid", "left_semi")
    return known.select("def_uid", F.get(names, F.col("_b._k")).alias("edge"), F.col("_b.seed_rank").alias("seed_rank"))


def import_harvest(seed_files: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """path, direction: files that seed files import (forward), that import them (reverse), package files beside them (barrel), their tests."""
    at = files.select(F.col("id").alias("file_id"), "path")
    edges = imports.where("resolved_path IS NOT NULL").join(at, "file_id").select(F.col("path").alias("src"), F.col("resolved_path").alias("dst"))
    s = seed_files.select("path").distinct()
    forward = edges.join(s.withColumnRenamed("path", "src"), "src", "left_semi").select(F.col("dst").alias("path"), F.lit(2).alias("_d"))
    reverse = edges.join(s.withColumnRenamed("path", "dst"), "dst", "left_semi").select(F.col("src").alias("path"), F.lit(1).alias("_d"))
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    barrels = at.where(paths.is_barrel(F.col("path"))).select("path", folder.alias("_f")).join(s.select(folder.alias("_f")).distinct(), "_f", "left_semi").select("path", F.lit(3).alias("_d"))
    pairs = s.select(F.explode(paths.test_pairs(F.col("path"))).alias("path")).join(at.select("path"), "path", "left_semi").select("path", F.lit(0).alias("_d"))
    every = forward.unionByName(reverse).unionByName(barrels).unionByName(pairs).join(s, "path", "left_anti")
    names = F.array(*[F.lit(x) for x in ("test_pair", "reverse", "forward", "barrel")])
    return every.groupBy("path").agg(F.min("_d").alias("_d")).select("path", F.get(names, F.col("_d")).alias("direction"))


def coverage_expansion(candidates: DataFrame, coverage: DataFrame, defs: DataFrame) -> DataFrame:
    """Definitions that the tests of candidate definitions also cover and that aren't candidates."""
    c = candidates.select("def_uid").distinct()
    tests = coverage.join(c.withColumnRenamed("def_uid", "target_def_uid"), "target_def_uid", "left_semi").select("test_id").distinct()
    more = coverage.join(tests, "test_id", "left_semi").select(F.col("target_def_uid").alias("def_uid")).distinct()
    return more.join(c, "def_uid", "left_anti").join(defs.select("def_uid"), "def_uid", "left_semi")


def seeds_of(candidates: DataFrame, top: int = 10) -> DataFrame:
    """def_uid, seed_rank: candidates with an explicit mention or two axes of evidence; without any, the top by matched terms (2 at least)."""
    sure = F.col("explicit") | (F.col("axes") >= 2)
    has = candidates.agg(F.coalesce(F.max(sure), F.lit(False)).alias("_any"))
    pool = candidates.crossJoin(F.broadcast(has)).where((F.col("_any") & sure) | (~F.col("_any") & (F.col("term_match_count") >= 2)))  # one row
    best = pool.orderBy(F.col("term_match_count").desc(), "def_uid").limit(top)
    return best.select("def_uid", (F.row_number().over(Window.orderBy(F.col("term_match_count").desc(), "def_uid")) - 1).cast("long").alias("seed_rank"))
