"""Queries of the report readers (2.1): reports are made of the driver's rows, read back, and compared with the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import coverage, reports
from .registry import query

ROWS = "SELECT 'r' || CAST(l_suppkey % 10 AS STRING) AS report, 'f' || CAST(l_suppkey AS STRING) || '.py' AS path, CAST(l_linenumber AS BIGINT) AS line, CAST(max(l_quantity) AS BIGINT) AS hits FROM lineitem GROUP BY 1, 2, 3"


def rows(f):
    s = F.col("l_suppkey")
    return f.lineitem.groupBy(
        F.concat(F.lit("r"), (s % 10).cast("string")).alias("report"), F.concat(F.lit("f"), s.cast("string"), F.lit(".py")).alias("path"), F.col("l_linenumber").cast("long").alias("line")
    ).agg(F.max("l_quantity").cast("long").alias("hits"))


def by_file(f, line, head, tail, joiner="\n"):
    """report, content: each file's lines between head and tail."""
    one = rows(f).withColumn("_t", line).groupBy("report", "path").agg(F.array_join(F.array_sort(F.collect_list("_t")), joiner).alias("_b"))
    return one.withColumn("_f", F.concat(head, F.col("_b"), tail))


def whole(files, before="", after="", joiner="\n"):
    g = files.groupBy("report").agg(F.array_join(F.sort_array(F.collect_list("_f")), joiner).alias("_c"))  # array_sort compares by an interpreted lambda
    return g.select("report", F.concat(F.lit(before), "_c", F.lit(after)).alias("content"))


def lcov_reports(f):
    return whole(by_file(f, F.format_string("DA:%d,%d", "line", "hits"), F.concat(F.lit("SF:"), "path", F.lit("\n")), F.lit("\nend_of_record")))


@query("o021_lcov", ROWS)
def _(f):
    return coverage.lcov_lines(lcov_reports(f))


@query("o020_autodetect", ROWS)
def _(f):
    return coverage.read_lines(lcov_reports(f))


@query("o022_cobertura", ROWS)
def _(f):
    files = by_file(f, F.format_string('<line number="%d" hits="%d"/>', "line", "hits"), F.concat(F.lit('<class filename="'), "path", F.lit('"><lines>')), F.lit("</lines></class>"), "")
    return coverage.cobertura_lines(whole(files, '<?xml version="1.0"?><coverage><packages><package><classes>', "</classes></package></packages></coverage>", ""))


@query("o023_jacoco", ROWS.replace("'f' ||", "'p/f' ||"))
def _(f):
    files = by_file(f, F.format_string('<line nr="%d" ci="%d"/>', "line", "hits"), F.concat(F.lit('<sourcefile name="'), "path", F.lit('">')), F.lit("</sourcefile>"), "")
    return coverage.jacoco_lines(whole(files, '<report name="x"><package name="p">', "</package></report>", ""))


@query("o024_clover", ROWS)
def _(f):
    files = by_file(f, F.format_string('<line num="%d" count="%d" type="stmt"/>', "line", "hits"), F.concat(F.lit('<file name="'), "path", F.lit('">')), F.lit("</file>"), "")
    return coverage.clover_lines(whole(files, "<coverage><project>", "</project></coverage>", ""))


@query("o025_opencover", ROWS)
def _(f):
    r = rows(f)
    names = r.select("report", "path").distinct().groupBy("report").agg(F.array_join(F.array_sort(F.collect_list(F.format_string('<File uid="%s" fullPath="%s"/>', "path", "path"))), "").alias("_n"))
    points = r.groupBy("report").agg(F.array_join(F.array_sort(F.collect_list(F.format_string('<SequencePoint vc="%d" sl="%d" fileid="%s"/>', "hits", "line", "path"))), "").alias("_p"))
    both = names.join(points, "report").select("report", F.concat(F.lit("<CoverageSession><Modules><Module><Files>"), "_n", F.lit("</Files><Classes><Class><Methods><Method><SequencePoints>"), "_p", F.lit("</SequencePoints></Method></Methods></Class></Classes></Module></Modules></CoverageSession>")).alias("content"))
    return coverage.opencover_lines(both)


@query("o026_istanbul", ROWS)
def _(f):
    r = rows(f)
    g = r.groupBy("report", "path").agg(
        F.array_join(F.array_sort(F.collect_list(F.format_string('"%d":{"start":{"line":%d},"end":{"line":%d}}', "line", "line", "line"))), ",").alias("_m"),
        F.array_join(F.array_sort(F.collect_list(F.format_string('"%d":%d', "line", "hits"))), ",").alias("_s"),
    )
    files = g.withColumn("_f", F.format_string('"%s":{"path":"%s","statementMap":{%s},"s":{%s}}', "path", "path", "_m", "_s"))
    return coverage.istanbul_lines(whole(files, "{", "}", ","))


@query("o027_simplecov", ROWS)
def _(f):
    g = rows(f).groupBy("report", "path").agg(F.map_from_entries(F.collect_list(F.struct("line", "hits"))).alias("_m"))
    places = F.sequence(F.lit(1).cast("long"), F.array_max(F.map_keys("_m")))
    values = F.array_join(F.transform(places, lambda i: F.coalesce(F.element_at("_m", i).cast("string"), F.lit("null"))), ",")
    files = g.withColumn("_f", F.format_string('"%s":{"lines":[%s]}', F.col("path"), values))
    return coverage.simplecov_lines(whole(files, '{"RSpec":{"coverage":{', "}}}", ","))


@query("o028_go_cover", ROWS)
def _(f):
    files = by_file(f, F.format_string("%s:%d.1,%d.9 1 %d", "path", "line", "line", "hits"), F.lit(""), F.lit(""))
    return coverage.go_lines(whole(files, "mode: count\n"))


TESTS = "SELECT 'r' || CAST(event_id % 5 AS STRING) AS report, 's' || CAST(user_id AS STRING) || '{sep}t' || CAST(event_id AS STRING) AS name, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'passed' END AS status, {seconds} AS seconds FROM events"


def tests(f):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "skipped").otherwise("passed")
    return f.events.select(F.concat(F.lit("r"), (F.col("event_id") % 5).cast("string")).alias("report"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("c"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("t"), status.alias("status"))


@query("o029_junit", TESTS.format(sep="::", seconds="0.5"))
def _(f):
    inner = F.when(F.col("status") == "failed", "<failure>x</failure>").when(F.col("status") == "skipped", "<skipped/>").otherwise("")
    case = F.concat(F.format_string('<testcase classname="%s" name="%s" time="0.5">', "c", "t"), inner, F.lit("</testcase>"))
    return reports.junit_results(whole(tests(f).withColumn("_f", case), "<testsuite>", "</testsuite>", ""))


@query("o029_pytest_json", TESTS.format(sep="::", seconds="0.5"))
def _(f):
    return reports.pytest_results(whole(tests(f).withColumn("_f", F.format_string('{"nodeid":"%s::%s","outcome":"%s","duration":0.5}', "c", "t", "status")), '{"tests":[', "]}", ","))


@query("o029_go_test", TESTS.format(sep="/", seconds="0.5"))
def _(f):
    action = F.when(F.col("status") == "passed", "pass").when(F.col("status") == "failed", "fail").otherwise("skip")
    return reports.go_test_results(whole(tests(f).withColumn("_f", F.format_string('{"Action":"%s","Package":"%s","Test":"%s","Elapsed":0.5}', action, F.col("c"), F.col("t")))))


@query("o029_tap", TESTS.format(sep=".", seconds="0.0"))
def _(f):
    line = F.format_string("%s 1 - %s.%s%s", F.when(F.col("status") == "failed", "not ok").otherwise("ok"), F.col("c"), F.col("t"), F.when(F.col("status") == "skipped", " # SKIP why").otherwise(""))
    return reports.tap_results(whole(tests(f).withColumn("_f", line), "TAP version 13\n"))


LINT = "SELECT 'r' || CAST(o_orderkey % 7 AS STRING) AS report, '{tool}' AS tool, 'f' || CAST(o_custkey AS STRING) || '.{ext}' AS path, CAST(o_orderkey AS BIGINT) AS line, CAST(3 AS BIGINT) AS col, CASE WHEN o_orderkey % 2 = 0 THEN 'error' ELSE 'warning' END AS severity, '{code}' AS code, 'msg ' || CAST(o_custkey AS STRING) AS message FROM orders"


def lint(f, ext):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    return f.orders.select(F.concat(F.lit("r"), (k % 7).cast("string")).alias("report"), F.concat(F.lit("f"), c, F.lit("." + ext)).alias("path"), k.alias("line"), F.when(k % 2 == 0, "error").otherwise("warning").alias("severity"), F.concat(F.lit("msg "), c).alias("message"))


@query("o032_tsc_lint", LINT.format(tool="tsc", ext="ts", code="TS2304"))
def _(f):
    return reports.line_diagnostics(whole(lint(f, "ts").withColumn("_f", F.format_string("%s(%d,3): %s TS2304: %s", "path", "line", "severity", "message"))), "tsc")


@query("o033_mypy_lint", LINT.format(tool="mypy", ext="py", code="attr"))
def _(f):
    return reports.line_diagnostics(whole(lint(f, "py").withColumn("_f", F.format_string("%s:%d:3: %s: %s  [attr]", "path", "line", "severity", "message"))), "mypy")


@query("o031_eslint", LINT.format(tool="eslint", ext="js", code="no-x"))
def _(f):
    level = F.when(F.col("severity") == "error", "2").otherwise("1")
    one = F.format_string('{"filePath":"%s","messages":[{"line":%d,"column":3,"severity":%s,"ruleId":"no-x","message":"%s"}]}', F.col("path"), F.col("line"), level, F.col("message"))
    return reports.json_diagnostics(whole(lint(f, "js").withColumn("_f", one), "[", "]", ","), "eslint")


@query("o030_sarif", LINT.format(tool="toolx", ext="c", code="R1"))
def _(f):
    one = F.format_string('{"ruleId":"R1","level":"%s","message":{"text":"%s"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"%s"},"region":{"startLine":%d,"startColumn":3}}}]}', "severity", "message", "path", "line")
    return reports.sarif_diagnostics(whole(lint(f, "c").withColumn("_f", one), '{"runs":[{"tool":{"driver":{"name":"toolx"}},"results":[', "]}]}", ","))


@query("o040_sarif_sink", "SELECT path, count(*) AS results FROM (SELECT 'f' || CAST(o_custkey AS STRING) || '.c' AS path FROM orders) GROUP BY 1")
def _(f):
    found = lint(f, "c").withColumn("code", F.lit("R1"))
    back = reports.sarif_diagnostics(reports.to_sarif(found, "toolx").select(F.col("path").alias("report"), F.col("sarif").alias("content")))
    return back.groupBy("path").agg(F.count("*").alias("results"))


@query("o037_unified_diff", "SELECT 'r' || CAST(o_orderkey % 7 AS STRING) AS report, 'f' || CAST(o_custkey AS STRING) || '.c' AS path, CAST(o_orderkey AS BIGINT) AS start_line, CAST(o_orderkey + 1 AS BIGINT) AS end_line, false AS is_new, false AS is_deleted FROM orders")
def _(f):
    one = F.format_string("diff --git a/%s b/%s\n--- a/%s\n+++ b/%s\n@@ -%d,2 +10,3 @@ x\n-a\n+b\n@@ -5,0 +9,1 @@\n+c", "path", "path", "path", "path", "line")
    return reports.diff_hunks(whole(lint(f, "c").withColumn("_f", one)))


@query("o014_walk")
def _(f):
    from ..sources.files import walk

    return walk(f.spark, f.sf_dir, rules=["# tables of events are left out", "events.*", "!*/part-*"]).select("path", "size")
