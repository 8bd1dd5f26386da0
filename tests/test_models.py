"""Learned rankers, the stored index, import paths and walks on small tables."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import models, resolve
from factloom.operators.index import LexicalIndex
from factloom.plans import catalogue
from factloom.sources import files

SF = "/root/testdata/sf0.001"


def test_trained_ranker_orders_by_grade(spark):
    got = catalogue.queries()["o159_trained_ranker"](spark, SF).collect()
    assert got and min(r["ndcg"] for r in got) > 0.9
    kept = catalogue.queries()["o161_model_pipeline"](spark, SF).collect()
    assert kept and {r["rank"] for r in kept} >= {1}


def test_gate_learns_its_labels(spark):
    rows = spark.createDataFrame([(float(i), ["OK", "UNSAT", "BROAD"][i // 20]) for i in range(60)], "x double, label string")
    gate = models.train_gate(rows, ["x"], "label")
    got = models.classify(rows, gate)
    assert got.where(F.col("gate") == F.col("label")).count() >= 56
    assert models.classify(rows).select("gate").distinct().collect()[0][0] == "OK"
    cut = models.cut_off(rows, models.train_regressor(rows.withColumn("y", F.col("x")), ["x"], "y"))
    assert cut.where(F.abs(F.col("n") - F.col("x")) <= 8).count() >= 55 and cut.agg(F.min("n")).first()[0] >= 1


def test_index_is_seen_whole_or_not(spark, tmp_path):
    index = LexicalIndex(spark, f"file://{tmp_path}/index", "doc_id")
    docs = spark.createDataFrame([(1, "red bolt red"), (2, "blue bolt")], "doc_id long, text string")
    assert index.publish(docs) == 0
    staged = index.staged(spark.createDataFrame([(1, "green")], "doc_id long, text string"))
    assert {r["term"] for r in staged.collect()} == {"green"}
    assert {(r["doc_id"], r["tf"]) for r in index.look_up(["red", "green"]).collect()} == {(1, 2)}
    index.publish(spark.createDataFrame([(1, "green nut"), (3, "red")], "doc_id long, text string"))
    assert {(r["doc_id"], r["term"]) for r in index.look_up(["red", "green", "bolt"]).collect()} == {(1, "green"), (3, "red"), (2, "bolt")}
    index.publish(docs.limit(0), docs.where("doc_id = 2"))
    assert index.look_up(["bolt"]).count() == 0 and index.look_up(["bolt"], 0).count() == 2


@pytest.mark.parametrize("kind,literal,importer,want", [
    ("js_import", "./util.js", "web/app/main.ts", "web/app/util.ts"), ("js_require", "../lib", "web/app/main.ts", "web/lib/index.js"), ("js_import", "react", "web/app/main.ts", None),
    ("c_include", "a.h", "src/x/b.c", "src/x/a.h"), ("c_include", "base/c.h", "src/x/b.c", "include/base/c.h"), ("lua_require", "foo.bar", "x.lua", "lua/foo/bar/init.lua"),
    ("python_from", "..core", "pkg/sub/m.py", "pkg/core.py"), ("java_import", "org.x.Thing", "A.java", "j/Thing.java"), ("rust_use", "crate::net::Socket", "src/a.rs", "src/net/socket.rs"),
    ("go_import", "example.org/x", "a.go", "x/x.go"), ("php_use", "App\\Model\\User", "a.php", "app/User.php"),
])
def test_import_paths(spark, kind, literal, importer, want):
    known = [
        ("web/app/util.ts", None), ("web/lib/index.js", None), ("src/x/a.h", None), ("include/base/c.h", None), ("lua/foo/bar/init.lua", None), ("pkg/core.py", None),
        ("j/Thing.java", "org.x"), ("j/Other.java", "org.x"), ("src/net/socket.rs", "crate::net"), ("x/x.go", "example.org/x"), ("app/User.php", "App.Model"),
    ]
    rows = spark.createDataFrame([("i", literal, kind, importer)], "import_uid string, source_literal string, import_kind string, importer_path string")
    got = resolve.import_paths(rows, spark.createDataFrame(known, "path string, declared_module string")).collect()
    assert [r["path"] for r in got] == ([want] if want else [])


def test_wildcard_imports(spark):
    refs = spark.createDataFrame([(1, 10, "Run"), (2, 10, "hide"), (3, 11, "Map")], "ref_id long, file_id long, name string")
    defs = spark.createDataFrame([("u1", 20, "Run", "class", "a.b"), ("u2", 20, "hide", "class", "a.b"), ("u3", 30, "Map", "interface", "java.util"), ("u4", 31, "Map", "function", "java.util")], "def_uid string, file_id long, name string, kind string, namespace string")
    known = spark.createDataFrame([(19, "x/net/a.go"), (20, "x/net/b.go"), (21, "x/net/b_test.go"), (30, "src/coll/mod.rs")], "id long, path string")
    ddl = "file_id long, source_literal string, import_kind string, imported_name string"
    go = spark.createDataFrame([(10, "example.org/x/net", "go_import", "*"), (11, "example.org/none", "go_import", "*")], ddl)
    assert [tuple(r) for r in resolve.by_go_dot(refs, go, defs, known).collect()] == [(1, "u1")]
    rust = spark.createDataFrame([(11, "crate::coll", "rust_use", "*"), (10, "crate::coll", "rust_use", "Map")], ddl)
    assert [tuple(r) for r in resolve.by_rust_glob(refs, rust, defs, known).collect()] == [(3, "u3")]
    java = spark.createDataFrame([(11, "java.util", "java_import", "*")], ddl)
    assert [tuple(r) for r in resolve.by_java_star(refs, java, defs, ["class", "interface"]).collect()] == [(3, "u3")]


def test_walk_with_ignore_rules(spark, tmp_path):
    for name in ("src/a.py", "src/a.log", "keep.log", "out/b.py", ".git/c"):
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")
    found = files.walk(spark, f"{tmp_path}/tree", rules=["# logs", "*.log", "", "!keep.log", "out/"])
    assert sorted(r["path"].split("/tree/")[1] for r in found.collect()) == ["keep.log", "src/a.py"]
