"""Joins whose keys very many rows share: the rows that arise on the way are counted."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import impact, joins, resolve, sparse
from factloom.plans import q_joins
from factloom.sources import reports

N = 200


def arose(df, kind, metric="numOutputRows"):
    """The rows of df, and the largest number that a step of that kind gave."""
    rows, found = df.collect(), [0]

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if kind in name and node.metrics().contains(metric):
            found.append(node.metrics().apply(metric).value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return rows, max(found)


@pytest.fixture(scope="module")
def defs(spark):
    """N definitions of one name, namespace and qualified end; one file each."""
    return spark.createDataFrame(
        [(f"d{i:03}", i, "x", "p.x", "p", "class", "X") for i in range(N)], "def_uid string, file_id long, name string, qualified_name string, namespace string, kind string, lexical_path string"
    )


@pytest.fixture(scope="module")
def refs(spark):
    return spark.createDataFrame([(i, i, "x", "p.q") for i in range(N)], "ref_id long, file_id long, name string, namespace string")


def test_same_namespace(spark, refs, defs):
    named = refs.withColumn("namespace", F.lit("p"))
    rows, n = arose(q_joins.namespace_using(type("Facts", (), {"defs": defs}), named), "Join")
    assert sorted(map(tuple, rows)) == [(i, "d000") for i in range(N)] and n <= N


def test_parent_namespace(refs, defs):
    rows, n = arose(resolve.by_namespace(refs, defs), "Join")
    assert sorted(map(tuple, rows)) == [(i, "d000") for i in range(N)] and n <= N


@pytest.mark.parametrize("few", [0, 20_000])
def test_many_keys_are_not_broadcast(refs, defs, few, monkeypatch):
    monkeypatch.setattr(resolve, "FEW", few)
    assert resolve.by_namespace(refs, defs).count() == N
    assert ("broadcast" in resolve.least(defs, "name")._jdf.queryExecution().analyzed().toString().lower()) == (few > 0)


def test_xref_targets(spark, defs):
    asked = spark.createDataFrame([(i, "x") for i in range(N)] + [(N, "d007"), (N + 1, "none"), (N + 1, None), (N, "x")], "id long, target string")
    rows, n = arose(resolve.xref_targets(asked, defs), "Join")
    assert sorted(map(tuple, rows)) == [(i, "d000") for i in range(N)] + [(N, "d007")] and n <= N + 2


def test_whole_packages(spark, refs, defs):
    stars = spark.createDataFrame([(i, "p", "*", "java_import") for i in range(N)], "file_id long, source_literal string, imported_name string, import_kind string")
    rows, n = arose(resolve.by_java_star(refs, stars, defs, ["class"]), "Join")
    assert sorted(map(tuple, rows)) == [(i, "d000") for i in range(N)] and n <= N
    one = defs.withColumn("file_id", F.lit(5).cast("long"))
    packages = spark.createDataFrame([(i, 5) for i in range(N)], "file_id long, source_file_id long")
    rows, n = arose(resolve.by_package(refs, packages, one), "Join")
    assert sorted(map(tuple, rows)) == [(i, "d000") for i in range(N)] and n <= N


def test_cascade(spark, refs, defs):
    named = refs.withColumn("namespace", F.when(F.col("ref_id") % 2 == 0, "p").otherwise("p.q"))
    rows, n = arose(q_joins.resolution_cascade(type("Facts", (), {"defs": defs}), named), "Join")
    assert sorted(map(tuple, rows)) == [("namespace", N // 2), ("parent", N // 2)] and n <= N


def test_hierarchy_shuffles_no_pairs(spark, defs):
    impls = spark.createDataFrame([(f"d{i:03}", "x") for i in range(N)] * 2, "implementor_def_uid string, interface_name string")
    rows, n = arose(joins.hierarchy(impls, defs, defs), "ShuffleExchange", "shuffleRecordsWritten")
    assert len(rows) == len(set(rows)) == N + 2 * N * (N - 1) and n <= 2 * N


def test_hierarchy_of_several_names(spark):
    impls = spark.createDataFrame([("a", "x"), ("a", "y")], "implementor_def_uid string, interface_name string")
    of = spark.createDataFrame([("b", "x"), ("b", "y"), ("c", "x"), ("c", "x")], "def_uid string, name string")
    own = of.union(spark.createDataFrame([("a", "z")], "def_uid string, name string"))
    got = sorted(map(tuple, joins.hierarchy(impls, own, own).collect()))
    assert got == [("a", "interface", "x"), ("a", "interface", "y"), ("a", "super", "b"), ("a", "super", "c"), ("b", "sub", "a"), ("c", "sub", "a")]


SCOPES = "scope_id long, file_id long, kind string, start_line long, end_line long"


@pytest.mark.parametrize("preferred", ["class", None])
def test_innermost_of_long_scopes(spark, preferred):
    longest = (1 << 63) - 1
    given = [(1, 1, "file", 1, 10_000_000), (2, 1, "class", 5, 900), (3, 1, "function", 10, 20), (4, 1, "function", 10, 20), (5, 1, "block", 901, 5_000_000), (6, 2, "file", -70, longest - 100), (9, 4, "file", 1, longest), (7, 2, None, 9, 3), (8, None, "file", 1, 9)]
    asked = [(i, f, line) for i, (f, line) in enumerate([(1, 1), (1, 5), (1, 15), (1, 20), (1, 21), (1, 900), (1, 901), (1, 5_000_001), (1, 10_000_001), (1, 0), (2, -64), (2, longest - 100), (4, longest), (2, 5), (3, 1), (None, 2), (1, None)])]

    def rank(kind):
        return 0 if preferred and kind == preferred else 1 if kind not in ("file", None) else 2

    want = []
    for i, f, line in asked:
        around = [(rank(k), e - s, u, k) for u, file, k, s, e in given if file is not None and file == f and line is not None and s <= line <= e]
        want += [(i, *min(around)[2:])] if around else []
    points = spark.createDataFrame(asked, "ref_id long, file_id long, _line long")
    rows, n = arose(joins.innermost(points, "_line", spark.createDataFrame(given, SCOPES), "ref_id", preferred), "Generate")
    assert sorted(map(tuple, rows)) == want and n < 100


def test_hierarchy_files_are_small(spark, tmp_path):
    named, n = 20_000, 100
    own = spark.range(named).select(F.format_string("d%05d", "id").alias("def_uid"), F.expr("left('x' || id, 1)").alias("name"))
    impls = own.where(f"def_uid < 'd{n:05}'").toDF("implementor_def_uid", "interface_name")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joins.hierarchy(impls, own, own).write.parquet(str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("relation").agg(F.count("*"), F.count_distinct("def_uid", "other"))
    pairs = n * (named - 1)
    assert sorted(map(tuple, got.collect())) == [("interface", n, n), ("sub", pairs, pairs), ("super", pairs, pairs)]
    assert sum(x.stat().st_size for x in (tmp_path / "out").glob("*.parquet")) < 0.5 * 2 * pairs


def test_products_of_many_lists(spark, monkeypatch):
    for k, v in (("RUN", 4), ("COPIES", 3), ("PIECES", 5)):
        monkeypatch.setattr(joins, k, v)
    left = [(k, f"a{i}") for k, n in (("x", 30), ("y", 1), ("z", 4), ("w", 9), (None, 5)) for i in range(n)]
    right = [(k, f"b{i}") for k, n in (("x", 7), ("y", 50), ("z", 4), ("v", 9), (None, 5)) for i in range(n)]
    got = joins.products(spark.createDataFrame(left, "k string, a string"), spark.createDataFrame(right, "k string, b string"), "k")
    assert sorted(map(tuple, got.collect())) == sorted((a, b) for k, a in left for q, b in right if k == q and k)


def test_cross_reference_patterns_stand_once(spark):
    plan = spark.range(1).select(text.cross_references(F.lit("a")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all") <= len(text.CROSS_REFERENCES)


def test_harvest_begins_at_seeds(spark, defs):
    spans = defs.withColumn("start_line", F.lit(1)).withColumn("end_line", F.lit(9))
    refs = spark.createDataFrame([(i, 5, f"d{(i + 1) % N:03}") for i in range(N)], "file_id long, start_line long, target_def_uid string")
    impls = spark.createDataFrame([(f"d{i:03}", "x") for i in range(N)], "implementor_def_uid string, interface_name string")
    xrefs = spark.createDataFrame([("d003", "d009")], "source_def_uid string, target_def_uid string")
    seeds = spark.createDataFrame([("d003", 0), ("d007", 1)], "def_uid string, seed_rank int")
    rows, n = arose(impact.graph_harvest(seeds, spans, refs, impls, xrefs), "Join")
    assert len(rows) == N and n <= 2 * N + 4
    got = {r["def_uid"]: (r["edge"], r["seed_rank"]) for r in rows}
    assert got["d004"] == ("callee", 0) and got["d002"] == ("caller", 0) and got["d006"] == ("implementor", 0) and got["d003"] == ("implementor", 1)


def test_pair_products_round_once(spark):
    v = spark.createDataFrame([(1, "t", 1.0), (2, "t", 0.0499999996)], "doc_id long, term string, weight double")
    pairs = spark.createDataFrame([(1, 2), (1, 2)], "a long, b long")
    assert [tuple(r) for r in sparse.pair_products(v, v, pairs, "doc_id", 1).collect()] == [(1, 2, 0.0)]


def test_junit_in_one_pass(spark):
    case = '<testcase classname="s" name="t%d" time="1,000.5">%s</testcase>'
    odd = '<testcase name="a"><failure/><skipped/></testcase><testcase time="x"><properties/></testcase><testcase classname="&lt;testcase&gt;"><error><![CDATA[<testcase name="no"/>]]></error></testcase>'
    many = "".join(case % (i, "<skipped/>" if i % 2 else "") for i in range(50_000))
    rows = [("m", f"<?xml version='1.0'?><testsuite>{many}</testsuite>"), ("o", f"\n<testsuites><testsuite>{odd}<testsuite>{odd}</testsuite></testsuite></testsuites>"), ("bad", f"<testsuite>{odd}"), ("none", None), ("", "")]
    got = [tuple(r) for r in reports.junit_results(spark.createDataFrame(rows, "report string, content string")).collect()]
    assert sorted(r for r in got if r[0] != "m") == [("o", "", "passed", 0.0), ("o", "<testcase>", "error", 0.0), ("o", "a", "failed", 0.0)]
    assert sorted(r for r in got if r[0] == "m") == sorted(("m", f"s::t{i}", "skipped" if i % 2 else "passed", 1000.5) for i in range(50_000))
