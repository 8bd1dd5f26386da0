"""Cases that the driver's tables don't hold."""

import re
import time

import pytest
from pyspark.sql import functions as F

from factloom.functions import paths, text
from factloom.operators import aggregates, diff, graph, impact, joins, ranking, resolve, search
from factloom.sources import coverage, files, reports, tables
from factloom.streaming import events


@pytest.mark.parametrize(
    ("glob", "path", "hit"),
    [
        ("*.py", "a/b.py", True), ("*.py", "a/b.pyc", False), ("src/**/x.py", "src/x.py", True), ("src/**/x.py", "src/a/b/x.py", True), ("**/x", "x", True), ("**", "a/b", True),
        ("a?c", "z/abc", True), ("a?c", "a/c", False), ("[!a]b", "cb", True), ("[!a]b", "ab", False), ("/a/*", "/a/b", True), ("/a/*", "x/a/b", False), ("a/*", "x/a/b", True), ("a+b", "a+b", True),
    ],
)
def test_globs(glob, path, hit):
    assert bool(re.search(paths.glob_regex(glob), path)) is hit


def test_query_parser():
    p = search.parse('a "b c" OR content:d NOT e path:src x:y')
    assert p.groups == [["a", "b c"], ["d", "x:y"]] and p.negative == ["e"] and p.fields == [("path", "src")]
    assert search.parse("").groups == [] and search.parse("a OR b", literal=True).groups == [["a", "or", "b"]]


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    c = F.col("a")
    assert one(spark, text.word_split(c), a="parseHTTPResponse_v2") == ["parse", "http", "response", "v", "2"]
    assert one(spark, text.path_phrase(c), a="src/fooBar/my_mod.py") == "foo bar my mod"
    assert one(spark, text.compact_signature(c, F.lit("(self, x)")), a="getIt") == "get it(x)"
    assert one(spark, text.intent(c), a="Fix the bug and add a test") == "debug"
    assert one(spark, text.negative_mentions(c), a="do it without Redis, not the cache!") == ["redis", "the"]
    assert one(spark, text.negative_mentions(c), a="Skip Tests, ignore: x and except for y; excluding a-b.") == ["tests", "for", "a-b"]
    assert one(spark, text.is_stacktrace(c), a="KeyError and an error") is True and one(spark, text.is_stacktrace(c), a="crash and fail") is False
    assert one(spark, text.is_test_driven(c), a="increase coverage of x") is True and one(spark, text.is_test_driven(c), a="rename x") is False
    assert one(spark, text.is_stacktrace(c), a="raised an exception") is True
    assert one(spark, text.task_paths(c), a="see ./src/a/b.py and c/d.go") == ["src/a/b.py", "c/d.go"]
    assert one(spark, paths.prefixes(c), a="a.b.c") == ["a.b.c", "a.b", "a"]
    assert one(spark, text.parameters(c), a="f(a, (b, c)) -> d") == "a, (b, c)" and one(spark, text.return_type(c), a="f(a) -> d") == "d"
    assert one(spark, paths.tree_distance(c, F.lit("a/x/f.py")), a="a/b/c/f.py") == 3


def test_cross_references(spark):
    def found(doc):
        return [(r["line"], r["target"], r["confidence"]) for r in one(spark, text.cross_references(F.col("a")), a=doc)]

    assert found("Uses :class:`~pkg.Foo` and :const:`MAX`") == [(1, "pkg.Foo", "high"), (1, "MAX", "high")]
    assert found("See also FooBar\nsee `Baz.run`") == [(1, "FooBar", "high"), (2, "Baz.run", "high")]
    assert found("[Foo](x) or [Bar.baz][] #Tag") == [(1, "Foo", "high"), (1, "Bar.baz", "high"), (1, "Tag", "high")]
    assert found("Returns: Result\nRaises: KeyError") == [(1, "Result", "high"), (2, "KeyError", "high")]
    assert found("calls pkg.Thing.Other once") == [(1, "pkg.Thing.Other", "medium")]
    assert found("a MyType\nclass MyType:\n\nplain words") == [(1, "MyType", "low")]


def test_endpoints(spark):
    def found(source, language):
        return [(r["line"], r["kind"], r["method"], r["url"]) for r in one(spark, text.endpoints(F.col("a"), F.lit(language)), a=source)]

    assert found('@app.route("/a")\n@r.post("/b")\npath("c/", v)', "python") == [(1, "server", "*", "/a"), (2, "server", "POST", "/b"), (3, "server", "*", "c/")]
    assert found('x = APIRouter(tags=[], prefix="/p")', "python") == [(1, "server", "*", "/p")]
    assert found("app.get('/u', f)\n@Post('/v')\n@Controller('w')\nr.all(`/z`)", "javascript") == [(1, "server", "GET", "/u"), (2, "server", "POST", "/v"), (3, "server", "*", "w"), (4, "server", "*", "/z")]
    assert found('r.GET("/u", f)\nhttp.HandleFunc("/h", f)', "go") == [(1, "server", "GET", "/u"), (2, "server", "*", "/h"), (2, "server", "*", "/h")]
    assert found('requests.get("https://x/y")\nhttpx.post("nope")\nfetch("/api")\naxios.put("/q")', "rust") == [(1, "client", "GET", "https://x/y"), (3, "client", "GET", "/api"), (4, "client", "PUT", "/q")]


def test_jacoco_falls_back(spark):
    counters = '<counter type="LINE" missed="2" covered="1"/>'
    xml = (
        '<report name="x"><package name="p"><class name="p/A" sourcefilename="A.java"><method name="m" line="3"><counter type="METHOD" missed="0" covered="1"/></method></class>'
        f'<class name="p/B">{counters}</class><class name="p/C" sourcefilename="C.java">{counters}</class>'
        '<sourcefile name="C.java"><line nr="9" ci="4"/></sourcefile></package></report>'
    )
    got = coverage.jacoco_lines(spark.createDataFrame([("r", xml)], "report string, content string")).collect()
    assert sorted((r["path"], r["line"], r["hits"]) for r in got) == [("p/A.java", 3, 1), ("p/B.java", 1, 1), ("p/B.java", 2, 0), ("p/B.java", 3, 0), ("p/C.java", 9, 4)]


def test_bodies_without_hunks_count_as_changed(spark):
    rows = "path string, kind string, name string, lexical_path string, signature_hash string, display_name string, start_line long, end_line long"
    base = spark.createDataFrame([("f", "function", "a", "a", "s", "a()", 1, 5)], rows)
    assert [r["change"] for r in diff.structural_diff(base, base).collect()] == ["body_changed"]
    hunks = spark.createDataFrame([("f", [(9, 10)])], "path string, hunks array<struct<start:long,end:long>>")
    assert diff.structural_diff(base, base, hunks).count() == 0


def test_containment_across_buckets(spark):
    spans = spark.createDataFrame([(1, 1, 1000, "all"), (1, 60, 70, "mid"), (2, 1, 5, "other")], "file_id int, start_line int, end_line int, d string")
    points = spark.createDataFrame([(1, 63), (1, 64), (1, 1000), (2, 9)], "file_id int, p int")
    got = {(r["p"], r["d"]) for r in joins.contained(points, "p", spans, ["file_id"]).collect()}
    assert got == {(63, "all"), (63, "mid"), (64, "all"), (64, "mid"), (1000, "all")}
    a = spark.createDataFrame([(1, 1, 500)], "k int, start int, end int")
    b = spark.createDataFrame([(1, 100, 300), (1, 500, 600), (1, 501, 502)], "k int, other_start int, other_end int")
    assert sorted(r["other_start"] for r in joins.overlapping(a, b, ["k"]).collect()) == [100, 500]


def test_elbow(spark):
    def n(scores):
        df = spark.createDataFrame([("q", float(s), i) for i, s in enumerate(scores)], "q string, s double, i int")
        return ranking.elbow(df, "q", "s", "i").first()["n"]

    assert n([5]) == 1 and n([3, 2, 1]) == 3 and n([9, 8, 1, 1, 1]) == 3 and n([9, 9, 9, 9, 1, 1]) == 4 and n([1] * 50) == 30 and n([1] * 7) == 7


def test_cycles_and_ranks(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "b"), ("e", "f"), ("f", "e"), ("f", "g")], "src string, dst string")
    got = {}
    for r in graph.strongly_connected(edges).collect():
        got.setdefault(r["component"], set()).add(r["node"])
    assert got == {"a": {"a", "b", "c"}, "e": {"e", "f"}}
    assert graph.strongly_connected(edges.limit(0)).count() == 0
    ranks = {r["node"]: r["score"] for r in graph.page_rank(edges, 12).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-6 and ranks["b"] > ranks["d"]


def test_transitive_importers_do_not_expand_tests(spark):
    edges = spark.createDataFrame([("b.py", "a.py"), ("tests/t.py", "b.py"), ("z.py", "tests/t.py")], "src string, dst string")
    got = impact.transitive_importers(spark.createDataFrame([("a.py",)], "path string"), edges)
    assert {(r["path"], r["hop"]) for r in got.collect()} == {("b.py", 1), ("tests/t.py", 2)}


def test_structural_diff_with_hunks(spark):
    ddl = "path string, kind string, lexical_path string, name string, signature_hash string, display_name string, start_line long, end_line long"
    base = spark.createDataFrame([("p", "f", "a", "a", "s1", "a(x)", 1, 10), ("p", "f", "b", "b", "s2", "b()", 20, 30), ("p", "f", "c", "c", "s3", "c()", 40, 50)], ddl)
    new = spark.createDataFrame([("p", "f", "a", "a", "s1", "a(x)", 1, 10), ("p", "f", "b2", "b2", "s2", "b()", 20, 30), ("p", "f", "c", "c", "s9", "c(y)", 40, 50)], ddl)
    hunks = spark.createDataFrame([("p", [(5, 6)])], "path string, hunks array<struct<start:long,end:long>>")
    got = {r["lexical_path"]: (r["change"], r["tags"]) for r in diff.structural_diff(base, new, hunks).collect()}
    assert got == {"a": ("body_changed", ["minor_change", "possibly_comment_or_whitespace"]), "b2": ("renamed", ["symbol_renamed"]), "c": ("signature_changed", ["parameters_changed"])}


def test_import_candidates(spark):
    c = resolve.import_candidates(F.col("a"), F.col("b"))
    assert one(spark, c, a=".mod", b="src/p/x.py")[0] == "src/p/mod.py" and one(spark, c, a="..q.mod", b="src/p/x.py")[0] == "src/q/mod.py"
    assert "src/p/mod.py" in one(spark, c, a="p.mod", b="x.py")


def content(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "report string, content string")


def test_coverage_readers_on_odd_input(spark):
    odd = content(
        spark, a="SF:x.py\nDA:1,5\nDA:2,-\nDA:bad\nend_of_record\nSF:x.py\nDA:1,0\nBRDA:1,0,1,-\nFN:3,f\nFNDA:2,f", b="mode: set\nm.go:1.2,3.4 1 0\nm.go:2.1,2.9 1 4\nrubbish", c="nothing",
        d='<?xml version="1.0"?><report name="r"><package name="p"><class name="p/C" sourcefilename="C.java"><method name="m" line="7"><counter type="METHOD" missed="0" covered="1"/></method></class></package></report>',
        e='{"RSpec":{"coverage":{"a.rb":[1,null,0]}},"Other":{"coverage":{"a.rb":[0,null,3]}}}',
    )
    assert {r["report"]: r["format"] for r in coverage.detect(odd).collect()} == {"a": "lcov", "b": "go", "c": None, "d": "jacoco", "e": "simplecov"}
    got = {(r["report"], r["path"], r["line"]): r["hits"] for r in coverage.read_lines(odd).collect()}
    assert got == {("a", "x.py", 1): 0, ("b", "m.go", 1): 0, ("b", "m.go", 2): 4, ("b", "m.go", 3): 0, ("d", "p/C.java", 7): 1, ("e", "a.rb", 1): 1, ("e", "a.rb", 3): 3}
    assert [tuple(r)[3:] for r in coverage.lcov_branches(odd).collect()] == [(0, 1, 0)]
    assert [tuple(r)[2:] for r in coverage.lcov_functions(odd).collect()] == [("f", 3, 2)]


@pytest.mark.parametrize(
    ("tool", "line", "want"),
    [
        ("go-vet", "vet: a/b.go:3:4: bad thing", ("a/b.go", 3, 4, "warning", None, "bad thing")), ("yamllint", "a.yml:2:1: [error] too long (line-length)", ("a.yml", 2, 1, "error", "line-length", "too long")),
        ("black", "would reformat a.py", ("a.py", 1, None, "warning", None, "needs formatting")), ("flake8", "a.py:1:80: E501 long line", ("a.py", 1, 80, "warning", "E501", "long line")),
        ("msbuild", "A.cs(3,9): error CS1002: ; expected [p.csproj]", ("A.cs", 3, 9, "error", "CS1002", "; expected")), ("mypy", "a.py:5: note: hm", ("a.py", 5, None, "info", None, "hm")),
        ("checkstyle", "[ERROR] A.java:3:1: Missing doc. [JavadocMethod]", ("A.java", 3, 1, "error", "JavadocMethod", "Missing doc.")), ("hadolint", "Dockerfile:3 DL3008 warning: pin", ("Dockerfile", 3, None, "warning", "DL3008", "pin")),
    ],
)
def test_line_diagnostics(spark, tool, line, want):
    (r,) = reports.TOOLS[tool](content(spark, r=f"{line}\n???\n")).collect()
    assert tuple(r)[2:] == want


def test_json_diagnostics(spark):
    (r,) = reports.TOOLS["ruff"](content(spark, r='[{"filename":"a.py","location":{"row":3,"column":1},"code":"F401","message":"m"}]')).collect()
    assert tuple(r)[1:] == ("ruff", "a.py", 3, 1, "warning", "F401", "m")
    (r,) = reports.TOOLS["phpstan"](content(spark, r='{"files":{"a.php":{"messages":[{"line":4,"message":"m","identifier":"i"}]}}}')).collect()
    assert tuple(r)[2:] == ("a.php", 4, None, "error", "i", "m")
    (r,) = reports.TOOLS["pyright"](content(spark, r='{"generalDiagnostics":[{"file":"a.py","severity":"error","rule":"x","message":"m","range":{"start":{"line":4,"character":2}}}]}')).collect()
    assert tuple(r)[2:6] == ("a.py", 4, 2, "error")
    assert reports.TOOLS["eslint"](content(spark, r="not json")).count() == 0


def test_diff_hunks(spark):
    d = "diff --git a/x b/x\nnew file mode 1\n@@ -0,0 +1,3 @@\n+a\ndiff --git a/y b/z\n@@ -10,2 +10,3 @@ f\n@@ -40 +41 @@\n"
    got = {tuple(r)[1:] for r in reports.diff_hunks(content(spark, r=d)).collect()}
    assert got == {("z", 10, 11, False, False), ("z", 40, 40, False, False)}


def test_file_tables(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a" / "x.py").write_text("é = 1\n")
    (tmp_path / "a" / "b.bin").write_bytes(b"\0\1")
    (tmp_path / "a" / "bad.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "node_modules" / "y.js").write_text("no")
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.safe_text(files.walk(spark, str(tmp_path))).collect()}
    assert got == {"x.py": "é = 1\n", "b.bin": "", "bad.txt": ""}
    (tmp_path / "repo1").mkdir()
    (tmp_path / "repo1" / "r.jsonl").write_text('{"a":1}\n{"a":2}\n')
    assert {(r["a"], r["repo"]) for r in tables.json_lines(spark, str(tmp_path / "repo1"), "a long").collect()} == {(1, "repo1"), (2, "repo1")}
    tables.append_snapshot(spark.createDataFrame([(1, 0.5), (2, 0.7)], "epoch long, rate double"), str(tmp_path / "health"))
    assert [r["epoch"] for r in tables.last_snapshots(spark, str(tmp_path / "health"), "epoch long, rate double", 1).collect()] == [2]


def test_epochs(spark, tmp_path):
    e = events.Epochs(spark, f"file://{tmp_path}/t")
    with pytest.raises(ValueError):
        e.read()
    e.publish(spark.range(3), 1)
    e.publish(spark.range(99), 1)
    assert e.read().count() == 3 and e.current() == 1
    spark.range(5).write.parquet(f"{tmp_path}/t/epoch=2")
    assert e.read().count() == 3 and e.discard_unfinished() == [2]
    e.publish(spark.range(7), 2)
    assert e.read().count() == 7 and e.read(1).count() == 3


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    rows = [(f"2024-01-01 00:{m:02d}:00", "k", float(m)) for m in (0, 1, 2, 20, 21, 50)]
    df = spark.createDataFrame(rows, "t string, key string, value double").select(F.to_timestamp("t").alias("ts"), "key", "value")
    df.write.parquet(str(source))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(source))

    def run(out, name, mode):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        return spark.table(name).collect()

    got = run(events.debounced(stream(), "ts", "key", "10 minutes", "0 seconds"), "runs", "append")
    assert sorted(r["events"] for r in got) == [2, 3]  # the last run is still open
    got = run(events.windowed(stream(), "ts", "30 minutes", None, "1 hour", ["key"]), "windows", "complete")
    assert sorted(r["events"] for r in got) == [1, 5]
    capped = events.debounced_with_cap(stream(), "ts", "key", 600.0, 90.0)
    q = capped.writeStream.format("memory").queryName("capped").outputMode("append").option("checkpointLocation", str(tmp_path / "capped")).start()
    for _ in range(60):  # timers keep such a stream busy, so there is no end to wait for
        time.sleep(0.5)
        if spark.table("capped").count():
            break
    q.stop()
    got = spark.table("capped").collect()
    assert sum(r["events"] for r in got) == 5 and max(r["events"] for r in got) == 2
    seen = []
    q = events.flush_batches(stream(), ["key"], lambda b, i: seen.append((i, b.count())), str(tmp_path / "flush")).start()
    q.processAllAvailable()
    q.stop()
    assert seen == [(0, 1)]


def test_upsert_and_aggregates_with_nulls(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    assert sorted(map(tuple, joins.merge_rows(a, spark.createDataFrame([(2, "z"), (3, None)], "k long, v string"), ["k"]).collect())) == [(1, "x"), (2, "z"), (3, None)]
    facts = spark.createDataFrame([("t", "d1", None, True)], "test_id string, target_def_uid string, line_rate double, stale boolean")
    assert tuple(aggregates.fresh_tests(facts, spark.createDataFrame([("d1",)], "def_uid string")).first()) == (False, None, None)
    assert tuple(aggregates.fresh_tests(facts, spark.createDataFrame([("d9",)], "def_uid string")).first()) == (False, None, None)
    left = spark.createDataFrame([(1, 10), (1, 5), (2, 7)], "k long, t long")
    right = spark.createDataFrame([(1, 5, "a"), (1, 9, "b")], "k long, t long, v string")
    assert sorted(map(tuple, joins.as_of_join(left, right, ["k"], "t", ["v"]).collect())) == [(1, 5, "a"), (1, 10, "b"), (2, 7, None)]
