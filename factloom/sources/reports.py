"""Lint output, test results and unified diffs as tables, and the SARIF sink.

Inputs are tables (report, content). Diagnostics are (report, tool, path, line,
col, severity, code, message); results are (report, name, status, seconds).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIAGNOSTIC = ["report", "tool", "path", "line", "col", "severity", "code", "message"]

# The line forms of tools. Groups by name: p path, l line, c column, s severity, k code, m message.
LINE_FORMS: dict[str, tuple[str, str, str]] = {
    "tsc": (r"^(.+?)\((\d+),(\d+)\): (error|warning) (TS\d+): (.*)$", "plcskm", "error"),
    "go-vet": (r"^(?:vet: )?([^:\s]+\.go):(\d+):(\d+): (.*)$", "plcm", "warning"),
    "yamllint": (r"^(.+?):(\d+):(\d+): \[(error|warning)\] (.*?)(?: \(([\w-]+)\))?$", "plcsmk", "warning"),
    "mypy": (r"^(.+?):(\d+):(?:(\d+):)? (error|warning|note): (.*?)(?:  \[([\w-]+)\])?$", "plcsmk", "error"),
    "flake8": (r"^(.+?):(\d+):(\d+): ([A-Z]\d+) (.*)$", "plckm", "warning"),
    "golangci": (r"^(.+?\.go):(\d+):(\d+): (.*?) \(([\w-]+)\)$", "plcmk", "warning"),
    "gcc": (r"^(.+?):(\d+):(\d+): (error|warning|note): (.*?)(?: \[([^\]]+)\])?$", "plcsmk", "warning"),
    "shellcheck-gcc": (r"^(.+?\.sh):(\d+):(\d+): (error|warning|note): (.*?) \[(SC\d+)\]$", "plcsmk", "warning"),
    "checkstyle": (r"^\[(ERROR|WARN)\] (.+?):(\d+)(?::(\d+))?: (.*?) \[(\w+)\]$", "splcmk", "warning"),
    "msbuild": (r"^(.+?)\((\d+),(\d+)\): (error|warning) ([A-Z]+\d+): (.*?)(?: \[.*\])?$", "plcskm", "error"),
    "swiftlint": (r"^(.+?\.swift):(\d+):(\d+): (error|warning): (.*?) \((\w+)\)$", "plcsmk", "warning"),
    "luacheck": (r"^\s*(.+?\.lua):(\d+):(\d+): (?:\(([WE]\d+)\) )?(.*)$", "plckm", "warning"),
    "markdownlint": (r"^(.+?\.md):(\d+)(?::(\d+))? (MD\d+)(?:/[\w/-]+)? (.*)$", "plckm", "warning"),
    "phpcs-emacs": (r"^(.+?\.php):(\d+):(\d+): (error|warning) - (.*)$", "plcsm", "warning"),
    "ktlint": (r"^(.+?\.kts?):(\d+):(\d+): (.*?) \(([\w:-]+)\)$", "plcmk", "warning"),
    "hadolint": (r"^(.+?):(\d+) (DL\d+|SC\d+) (?:(error|warning|info): )?(.*)$", "plksm", "warning"),
    "black": (r"^would reformat (.+)$", "p", "warning"),
    "prettier": (r"^(?:\[warn\] )?([\w./-]+\.(?:js|ts|tsx|jsx|css|json|md|yaml|yml|html))$", "p", "warning"),
    "gofmt": (r"^([\w./-]+\.go)$", "p", "warning"),
    "rustfmt": (r"^Diff in (.+?)(?: at line |:)(\d+):?$", "pl", "warning"),
}
SEVERITY = {"ERROR": "error", "WARN": "warning", "note": "info", "refactor": "info", "convention": "info", "fatal": "error", "style": "info", "2": "error", "1": "warning"}

# JSON tools: schema, the arrays to open in turn, and the place of each value.
JSON_FORMS: dict[str, tuple[str, list[str], dict[str, str], str]] = {
    "ruff": ("ARRAY<STRUCT<filename: STRING, location: STRUCT<row: LONG, column: LONG>, code: STRING, message: STRING>>", [""], {"path": "filename", "line": "location.row", "col": "location.column", "code": "code", "message": "message"}, "warning"),
    "pylint": ("ARRAY<STRUCT<path: STRING, line: LONG, column: LONG, type: STRING, symbol: STRING, message: STRING>>", [""], {"path": "path", "line": "line", "col": "column", "severity": "type", "code": "symbol", "message": "message"}, "warning"),
    "eslint": ("ARRAY<STRUCT<filePath: STRING, messages: ARRAY<STRUCT<line: LONG, column: LONG, severity: STRING, ruleId: STRING, message: STRING>>>>", ["", "messages"], {"path": "0.filePath", "line": "line", "col": "column", "severity": "severity", "code": "ruleId", "message": "message"}, "warning"),
    "pyright": ("STRUCT<generalDiagnostics: ARRAY<STRUCT<file: STRING, severity: STRING, rule: STRING, message: STRING, range: STRUCT<start: STRUCT<line: LONG, character: LONG>>>>>", ["generalDiagnostics"], {"path": "file", "line": "range.start.line", "col": "range.start.character", "severity": "severity", "code": "rule", "message": "message"}, "error"),
    "bandit": ("STRUCT<results: ARRAY<STRUCT<filename: STRING, line_number: LONG, issue_severity: STRING, test_id: STRING, issue_text: STRING>>>", ["results"], {"path": "filename", "line": "line_number", "severity": "issue_severity", "code": "test_id", "message": "issue_text"}, "warning"),
    "rubocop": ("STRUCT<files: ARRAY<STRUCT<path: STRING, offenses: ARRAY<STRUCT<severity: STRING, cop_name: STRING, message: STRING, location: STRUCT<line: LONG, column: LONG>>>>>>", ["files", "offenses"], {"path": "0.path", "line": "location.line", "col": "location.column", "severity": "severity", "code": "cop_name", "message": "message"}, "warning"),
    "shellcheck": ("ARRAY<STRUCT<file: STRING, line: LONG, column: LONG, level: STRING, code: STRING, message: STRING>>", [""], {"path": "file", "line": "line", "col": "column", "severity": "level", "code": "code", "message": "message"}, "warning"),
    "golangci-json": ("STRUCT<Issues: ARRAY<STRUCT<FromLinter: STRING, Text: STRING, Pos: STRUCT<Filename: STRING, Line: LONG, Column: LONG>>>>", ["Issues"], {"path": "Pos.Filename", "line": "Pos.Line", "col": "Pos.Column", "code": "FromLinter", "message": "Text"}, "warning"),
    "phpstan": ("STRUCT<files: MAP<STRING, STRUCT<messages: ARRAY<STRUCT<line: LONG, message: STRING, identifier: STRING>>>>>", ["files", "messages"], {"path": "0.key", "line": "line", "code": "identifier", "message": "message"}, "error"),
}


def _severity(c: Column, default: str) -> Column:
    mapped = F.coalesce(*[F.when(c == k, v) for k, v in SEVERITY.items()], F.lower(c))
    return F.when(c.isNull() | (c == ""), default).otherwise(F.when(mapped.isin("error", "warning", "info"), mapped).otherwise("warning"))


def line_diagnostics(reports: DataFrame, tool: str) -> DataFrame:
    """Diagnostics of a tool that prints one a line."""
    pattern, groups, default = LINE_FORMS[tool]
    rows = reports.select("report", F.explode(F.split("content", "\r?\n")).alias("text")).where(F.col("text").rlike(pattern))
    got = {g: F.nullif(F.regexp_extract("text", pattern, i + 1), F.lit("")) for i, g in enumerate(groups)}
    none = F.lit(None).cast("string")
    return rows.select(
        "report", F.lit(tool).alias("tool"), got["p"].alias("path"), F.coalesce(got.get("l", none).cast("long"), F.lit(1)).alias("line"), got.get("c", none).cast("long").alias("col"),
        _severity(got.get("s", none), default).alias("severity"), got.get("k", none).alias("code"), F.coalesce(got.get("m", none), F.lit("needs formatting")).alias("message"),
    )


def json_diagnostics(reports: DataFrame, tool: str) -> DataFrame:
    """Diagnostics of a tool that prints JSON."""
    schema, opened, places, default = JSON_FORMS[tool]
    rows = reports.select("report", F.from_json("content", schema).alias("x"))
    at = F.col("x")
    for i, name in enumerate(opened):
        inner = at if name == "" else at[name]
        kept = [F.col(f"_{j}") for j in range(i)]
        if "MAP<" in schema and i == 0:
            rows = rows.select("report", *kept, F.explode(F.map_entries(inner)).alias(f"_{i}"))
            at = F.col(f"_{i}.value")
        else:
            rows = rows.select("report", *kept, F.explode(inner).alias(f"_{i}"))
            at = F.col(f"_{i}")
    last = len(opened) - 1

    def value(k: str) -> Column:
        p = places.get(k)
        if p is None:
            return F.lit(None)
        head, _, rest = p.partition(".")
        return F.col(f"_{head}.{rest}") if head.isdigit() else F.col(f"_{last}.{p}")

    return rows.select(
        "report", F.lit(tool).alias("tool"), value("path").cast("string").alias("path"), F.coalesce(value("line").cast("long"), F.lit(1)).alias("line"), value("col").cast("long").alias("col"),
        _severity(value("severity").cast("string"), default).alias("severity"), value("code").cast("string").alias("code"), value("message").cast("string").alias("message"),
    )


SARIF = "runs ARRAY<STRUCT<tool: STRUCT<driver: STRUCT<name: STRING>>, results: ARRAY<STRUCT<ruleId: STRING, level: STRING, message: STRUCT<text: STRING>, locations: ARRAY<STRUCT<physicalLocation: STRUCT<artifactLocation: STRUCT<uri: STRING>, region: STRUCT<startLine: LONG, startColumn: LONG>>>>>>>>"


def sarif_diagnostics(reports: DataFrame) -> DataFrame:
    """One diagnostic for each run, result and location; the line is 1 where none is given."""
    runs = reports.select("report", F.explode(F.from_json("content", f"STRUCT<{SARIF.replace('runs ARRAY', 'runs: ARRAY', 1)}>")["runs"]).alias("r"))
    results = runs.select("report", F.col("r.tool.driver.name").alias("tool"), F.explode("r.results").alias("x"))
    at = results.select("report", "tool", "x", F.explode("x.locations").alias("a"))
    return at.select(
        "report", "tool", F.col("a.physicalLocation.artifactLocation.uri").alias("path"), F.coalesce("a.physicalLocation.region.startLine", F.lit(1)).alias("line"), F.col("a.physicalLocation.region.startColumn").alias("col"),
        _severity(F.col("x.level"), "warning").alias("severity"), F.col("x.ruleId").alias("code"), F.col("x.message.text").alias("message"),
    )


def to_sarif(diagnostics: DataFrame, tool: str, version: str = "1.0") -> DataFrame:
    """path, sarif: a SARIF 2.1.0 document for each file; a file's diagnostics are few."""
    result = F.struct(
        F.col("code").alias("ruleId"), F.when(F.col("severity") == "info", "note").otherwise(F.col("severity")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))).alias("locations"),
    )
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version")).alias("driver")).alias("tool"), F.array_sort(F.collect_list(result)).alias("results"))
    return diagnostics.groupBy("path").agg(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


#: Tool names to readers; others can be added.
TOOLS: dict[str, Callable[[DataFrame], DataFrame]] = {
    **{t: (lambda r, t=t: line_diagnostics(r, t)) for t in LINE_FORMS}, **{t: (lambda r, t=t: json_diagnostics(r, t)) for t in JSON_FORMS}, "sarif": sarif_diagnostics,
}

RESULT = ["report", "name", "status", "seconds"]


def _seconds(text: str | None) -> float:
    try:
        return float((text or "0").strip().replace(",", "") or 0)
    except ValueError:
        return 0.0


def _junit_cases(text: str) -> Iterator[list[tuple]]:
    """(name, status, seconds) of a report's test cases, some at a time; none of a report that isn't well-formed."""
    body = re.sub(r"(?s)<\?xml.*?\?>", "", text)
    del text
    whole = body.lstrip().startswith("<testsuites")
    step = 1 << 20
    pieces = lambda: chain(["" if whole else "<testsuites>"], (body[i : i + step] for i in range(0, len(body), step)), ["" if whole else "</testsuites>"])
    try:
        check = expat.ParserCreate()
        for p in pieces():
            check.Parse(p)
        check.Parse("", True)
    except expat.ExpatError:
        return
    path, case, rows = [], {}, []

    def begin(tag: str, attributes: dict) -> None:
        path.append(tag)
        if len(path) == 3 and path[1:] == ["testsuite", "testcase"]:
            case.clear()
            case.update(attributes)
        elif len(path) == 4 and path[1:3] == ["testsuite", "testcase"] and tag in PROBLEMS:
            case["", tag] = True

    def end(tag: str) -> None:
        if len(path) == 3 and path[1:] == ["testsuite", "testcase"]:
            name = "::".join(case[k] for k in ("classname", "name") if k in case)
            rows.append((name, next((s for t, s in PROBLEMS.items() if ("", t) in case), "passed"), _seconds(case.get("time"))))
        path.pop()

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler = begin, end
    for p in pieces():
        parser.Parse(p)
        if rows:
            yield rows
            rows.clear()


#: What a test case holds and its status, the first that is there.
PROBLEMS = {"failure": "failed", "error": "error", "skipped": "skipped"}


def junit_results(reports: DataFrame) -> DataFrame:
    """Each report is read in one pass in pieces: an array of its cases, as from_xml makes it, is copied for each case."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for report, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for rows in _junit_cases(content.as_py() or ""):
                    name, status, seconds = zip(*rows, strict=True)
                    columns = [pa.array([report] * len(rows), pa.string()), pa.array(name, pa.string()), pa.array(status, pa.string()), pa.array(seconds, pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, names=RESULT)

    known = reports.where("content IS NOT NULL").select(F.col("report").cast("string"), F.col("content").cast("string"))
    return known.mapInArrow(run, "report string, name string, status string, seconds double")


def pytest_results(reports: DataFrame) -> DataFrame:
    tests = reports.select("report", F.explode(F.from_json("content", "STRUCT<tests: ARRAY<STRUCT<nodeid: STRING, outcome: STRING, duration: DOUBLE>>>")["tests"]).alias("t"))
    return tests.select("report", F.col("t.nodeid").alias("name"), F.col("t.outcome").alias("status"), F.coalesce("t.duration", F.lit(0.0)).alias("seconds"))


def go_test_results(reports: DataFrame) -> DataFrame:
    rows = reports.select("report", F.explode(F.split("content", "\n")).alias("text")).select("report", F.from_json("text", "Action STRING, Package STRING, Test STRING, Elapsed DOUBLE").alias("e"))
    done = rows.where(F.col("e.Test").isNotNull() & F.col("e.Action").isin("pass", "fail", "skip"))
    status = F.when(F.col("e.Action") == "pass", "passed").when(F.col("e.Action") == "fail", "failed").otherwise("skipped")
    return done.select("report", F.concat_ws("/", "e.Package", "e.Test").alias("name"), status.alias("status"), F.coalesce("e.Elapsed", F.lit(0.0)).alias("seconds"))


def tap_results(reports: DataFrame) -> DataFrame:
    p = r"^(not ok|ok)\s+(\d+)?\s*-?\s*([^#]*?)\s*(?:#\s*(?i:(skip|todo)).*)?$"
    rows = reports.select("report", F.explode(F.split("content", "\n")).alias("text")).where(F.col("text").rlike(p))
    got = [F.regexp_extract("text", p, k) for k in (1, 2, 3, 4)]
    status = F.when(got[3] != "", "skipped").when(got[0] == "ok", "passed").otherwise("failed")
    return rows.select("report", F.when(got[2] != "", got[2]).otherwise(F.concat(F.lit("test "), got[1])).alias("name"), status.alias("status"), F.lit(0.0).alias("seconds"))


def diff_hunks(diffs: DataFrame) -> DataFrame:
    """report, path, start_line, end_line, is_new, is_deleted: old-side hunks of unified diffs; hunks without old lines are left out."""
    order = Window.partitionBy("report").orderBy("i")
    rows = diffs.select("report", F.posexplode(F.split("content", "\n")).alias("i", "text"))

    def running(pattern: str, group: int = 1) -> Column:
        return F.last(F.when(F.col("text").rlike(pattern), F.regexp_extract("text", pattern, group)), ignorenulls=True).over(order)

    rows = rows.withColumn("path", running(r"^diff --git a/(.+?) b/(.+)$", 2)).withColumn("_f", F.sum(F.col("text").startswith("diff --git ").cast("int")).over(order))
    file = Window.partitionBy("report", "_f")
    rows = rows.withColumn("is_new", F.max(F.col("text").startswith("new file")).over(file)).withColumn("is_deleted", F.max(F.col("text").startswith("deleted file")).over(file))
    hunk = r"^@@ -(\d+)(?:,(\d+))? \+"
    start, n = F.regexp_extract("text", hunk, 1).cast("long"), F.coalesce(F.nullif(F.regexp_extract("text", hunk, 2), F.lit("")).cast("long"), F.lit(1))
    found = rows.where(F.col("text").rlike(hunk) & F.col("path").isNotNull()).select("report", "path", start.alias("start_line"), (start + n - 1).alias("end_line"), "is_new", "is_deleted", n.alias("_n"))
    return found.where("_n > 0").drop("_n")
