"""Coverage reports as tables: LCOV, Cobertura, JaCoCo, Clover, OpenCover, Istanbul, SimpleCov, Go.

Readers take a table (report, content) of whole reports and give long rows:
lines (report, path, line, hits), and branches or functions where a format has
them. XML is read with from_xml, JSON with from_json; line formats are cut into
records by running windows within a report.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINES = ["report", "path", "line", "hits"]


def _numbered(reports: DataFrame) -> DataFrame:
    return reports.select("report", F.posexplode(F.split("content", "\r?\n")).alias("i", "text"))


def _lcov_records(reports: DataFrame) -> DataFrame:
    """Rows of LCOV files with their source file; a later block of a file replaces an earlier one; a missing end is tolerated."""
    order = Window.partitionBy("report").orderBy("i")
    rows = _numbered(reports).withColumn("path", F.last(F.when(F.col("text").startswith("SF:"), F.substring("text", 4, 1 << 20)), ignorenulls=True).over(order))
    rows = rows.withColumn("block", F.sum(F.col("text").startswith("SF:").cast("int")).over(order)).where("path IS NOT NULL")
    last = F.max("block").over(Window.partitionBy("report", "path"))
    return rows.withColumn("_last", last).where("block = _last").select("report", "path", "i", "text")


def lcov_lines(reports: DataFrame) -> DataFrame:
    """DA records; '-' counts 0, malformed rows are left out."""
    rows = _lcov_records(reports).withColumn("line", F.regexp_extract("text", r"^DA:(\d+),(-|\d+)", 1)).withColumn("hits", F.regexp_extract("text", r"^DA:(\d+),(-|\d+)", 2))
    rows = rows.where("line <> ''").select("report", "path", F.col("line").cast("long"), F.when(F.col("hits") == "-", 0).otherwise(F.col("hits").cast("long")).alias("hits"))
    return rows.groupBy("report", "path", "line").agg(F.max("hits").cast("long").alias("hits"))


def lcov_branches(reports: DataFrame) -> DataFrame:
    p = r"^BRDA:(\d+),(\d+),(\d+),(-|\d+)"
    part = [F.regexp_extract("text", p, k) for k in (1, 2, 3, 4)]
    rows = _lcov_records(reports).where(part[0] != "")
    return rows.select("report", "path", part[0].cast("long").alias("line"), part[1].cast("long").alias("block_id"), part[2].cast("long").alias("branch_id"), F.when(part[3] == "-", 0).otherwise(part[3].cast("long")).cast("long").alias("hits"))


def lcov_functions(reports: DataFrame) -> DataFrame:
    rows = _lcov_records(reports)
    begins = rows.where(F.col("text").rlike(r"^FN:\d+,")).select("report", "path", F.regexp_extract("text", r"^FN:(\d+),(?:\d+,)?(.+)$", 2).alias("name"), F.regexp_extract("text", r"^FN:(\d+),", 1).cast("long").alias("start_line"))
    hits = rows.where(F.col("text").rlike(r"^FNDA:\d+,")).select("report", "path", F.regexp_extract("text", r"^FNDA:(\d+),(.+)$", 2).alias("name"), F.regexp_extract("text", r"^FNDA:(\d+),", 1).cast("long").alias("hits"))
    g = hits.groupBy("report", "path", "name").agg(F.max("hits").alias("hits"))
    return begins.groupBy("report", "path", "name").agg(F.min("start_line").alias("start_line")).join(g, ["report", "path", "name"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def go_lines(reports: DataFrame) -> DataFrame:
    """Blocks file:line.col,line.col statements count; reports without a mode line give nothing; overlaps take the most."""
    p = r"^(.+):(\d+)\.\d+,(\d+)\.\d+ \d+ (\d+)$"
    part = [F.regexp_extract("text", p, k) for k in (1, 2, 3, 4)]
    valid = reports.where(F.trim("content").startswith("mode:"))
    rows = _numbered(valid).where(F.col("text").rlike(p)).select("report", part[0].alias("path"), F.explode(F.sequence(part[1].cast("long"), part[2].cast("long"))).alias("line"), part[3].cast("long").alias("hits"))
    return rows.groupBy("report", "path", "line").agg(F.max("hits").alias("hits"))


def _xml(reports: DataFrame, schema: str) -> DataFrame:
    body = F.regexp_replace("content", r"(?s)<\?xml.*?\?>|<!DOCTYPE.*?>", "")
    return reports.select("report", F.from_xml(body, schema).alias("x"))


LINE = "ARRAY<STRUCT<_number: LONG, _hits: LONG>>"


def _all_max(rows: DataFrame) -> DataFrame:
    return rows.where("line IS NOT NULL").groupBy("report", "path", "line").agg(F.max(F.coalesce("hits", F.lit(0))).cast("long").alias("hits"))


def cobertura_lines(reports: DataFrame) -> DataFrame:
    x = _xml(reports, f"packages STRUCT<package: ARRAY<STRUCT<classes: STRUCT<class: ARRAY<STRUCT<_filename: STRING, lines: STRUCT<line: {LINE}>>>>>>>")
    c = x.select("report", F.explode("x.packages.package").alias("p")).select("report", F.explode("p.classes.class").alias("c"))
    return _all_max(c.select("report", F.col("c._filename").alias("path"), F.explode("c.lines.line").alias("l")).select("report", "path", F.col("l._number").alias("line"), F.col("l._hits").alias("hits")))


def jacoco_lines(reports: DataFrame) -> DataFrame:
    """Lines where a file has any (covered instructions); else methods by their line; else as many lines as its classes' counters tell, the covered first."""
    lines = "ARRAY<STRUCT<_nr: LONG, _ci: LONG>>"
    counter = "ARRAY<STRUCT<_type: STRING, _covered: LONG, _missed: LONG>>"
    of_class = f"ARRAY<STRUCT<_name: STRING, _sourcefilename: STRING, method: ARRAY<STRUCT<_line: LONG, counter: {counter}>>, counter: {counter}>>"
    x = _xml(reports, f"package ARRAY<STRUCT<_name: STRING, sourcefile: ARRAY<STRUCT<_name: STRING, line: {lines}>>, class: {of_class}>>")
    p = x.select("report", F.explode("x.package").alias("p"))
    file, key = ["report", "path"], lambda df: df.select("report", "path").distinct()
    a = p.select("report", "p._name", F.explode("p.sourcefile").alias("s")).select("report", F.concat_ws("/", "_name", "s._name").alias("path"), F.explode("s.line").alias("l"))
    exact = a.select("report", "path", F.col("l._nr").alias("line"), F.col("l._ci").alias("hits"))
    own = F.coalesce("c._sourcefilename", F.concat(F.element_at(F.split("c._name", "/"), -1), F.lit(".java")))
    c = p.select("report", "p._name", F.explode("p.class").alias("c")).select("report", F.concat_ws("/", "_name", own).alias("path"), "c")
    m = c.select("report", "path", F.explode("c.method").alias("m")).where("m._line IS NOT NULL")
    hit = F.exists("m.counter", lambda k: (k["_type"] == "METHOD") & (k["_covered"] > 0)).cast("long")
    rough = m.select("report", "path", F.col("m._line").alias("line"), hit.alias("hits")).join(key(exact), file, "left_anti")
    n = F.get(F.filter("c.counter", lambda k: k["_type"] == "LINE"), F.lit(0))
    told = c.select("report", "path", F.coalesce(n["_covered"], F.lit(0)).alias("_c"), (F.coalesce(n["_covered"], F.lit(0)) + F.coalesce(n["_missed"], F.lit(0))).alias("_n"))
    told = told.join(key(exact), file, "left_anti").join(key(rough), file, "left_anti").where("_n > 0")
    least = told.select("report", "path", F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("line"), "_c").withColumn("hits", (F.col("line") <= F.col("_c")).cast("long")).drop("_c")
    return _all_max(exact.unionByName(rough).unionByName(least))


def clover_lines(reports: DataFrame) -> DataFrame:
    file = "ARRAY<STRUCT<_name: STRING, _path: STRING, line: ARRAY<STRUCT<_num: LONG, _count: LONG>>>>"
    x = _xml(reports, f"project STRUCT<file: {file}, package: ARRAY<STRUCT<file: {file}>>>")
    none = F.array().cast("array<struct<_name:string,_path:string,line:array<struct<_num:bigint,_count:bigint>>>>")
    every = F.concat(F.coalesce("x.project.file", none), F.coalesce(F.flatten(F.transform(F.col("x.project.package"), lambda p: F.coalesce(p["file"], none))), none))
    f = x.select("report", F.explode(every).alias("f")).select("report", F.coalesce("f._path", "f._name").alias("path"), F.explode("f.line").alias("l"))
    return _all_max(f.select("report", "path", F.col("l._num").alias("line"), F.col("l._count").alias("hits")))


def opencover_lines(reports: DataFrame) -> DataFrame:
    points = "STRUCT<SequencePoint: ARRAY<STRUCT<_vc: LONG, _sl: LONG, _fileid: STRING>>>"
    x = _xml(reports, f"Modules STRUCT<Module: ARRAY<STRUCT<Files: STRUCT<File: ARRAY<STRUCT<_uid: STRING, _fullPath: STRING>>>, Classes: STRUCT<Class: ARRAY<STRUCT<Methods: STRUCT<Method: ARRAY<STRUCT<FileRef: STRUCT<_uid: STRING>, SequencePoints: {points}>>>>>>>>>")
    m = x.select("report", F.explode("x.Modules.Module").alias("m"))
    files = m.select("report", F.explode("m.Files.File").alias("f")).select("report", F.col("f._uid").alias("uid"), F.col("f._fullPath").alias("path"))
    methods = m.select("report", F.explode("m.Classes.Class").alias("c")).select("report", F.explode("c.Methods.Method").alias("d"))
    p = methods.select("report", "d.FileRef._uid", F.explode("d.SequencePoints.SequencePoint").alias("s"))
    p = p.select("report", F.coalesce("s._fileid", "_uid").alias("uid"), F.col("s._sl").alias("line"), F.col("s._vc").alias("hits"))
    return _all_max(p.join(files, ["report", "uid"]))


def istanbul_lines(reports: DataFrame) -> DataFrame:
    """The most hits of the statements that cover each line."""
    place = "STRUCT<start: STRUCT<line: LONG>, `end`: STRUCT<line: LONG>>"
    x = reports.select("report", F.explode(F.from_json("content", f"MAP<STRING, STRUCT<path: STRING, statementMap: MAP<STRING, {place}>, s: MAP<STRING, LONG>>>")).alias("key", "f"))
    s = x.select("report", F.coalesce("f.path", "key").alias("path"), F.col("f.s").alias("_s"), F.explode("f.statementMap").alias("id", "at"))
    rows = s.select("report", "path", F.explode(F.sequence("at.start.line", F.greatest("at.start.line", "at.end.line"))).alias("line"), F.coalesce(F.element_at("_s", F.col("id")), F.lit(0)).alias("hits"))
    return _all_max(rows)


def simplecov_lines(reports: DataFrame) -> DataFrame:
    """Place + 1 is the line, null isn't executable; old reports have a list, new ones a list below lines; suites take the most."""
    new = F.from_json("content", "MAP<STRING, STRUCT<coverage: MAP<STRING, STRUCT<lines: ARRAY<LONG>>>>>")
    old = F.from_json("content", "MAP<STRING, STRUCT<coverage: MAP<STRING, ARRAY<LONG>>>>")

    def lines(parsed: Column, inner: Callable[[Column], Column]) -> DataFrame:
        suites = reports.select("report", F.explode(parsed).alias("suite", "x")).select("report", F.explode("x.coverage").alias("path", "f"))
        return suites.select("report", "path", F.posexplode(inner(F.col("f"))).alias("_i", "hits")).select("report", "path", (F.col("_i") + 1).cast("long").alias("line"), "hits")

    both = lines(new, lambda f: f["lines"]).unionByName(lines(old, lambda f: f))
    return _all_max(both.where("hits IS NOT NULL"))


#: Formats by name: what tells one, and its reader. Others can be added.
FORMATS: dict[str, tuple[Callable[[Column], Column], Callable[[DataFrame], DataFrame]]] = {
    "go": (lambda c: F.trim(c).startswith("mode:"), go_lines),
    "lcov": (lambda c: c.rlike(r"(?m)^SF:"), lcov_lines),
    "jacoco": (lambda c: c.rlike(r"<report\b") & c.rlike("jacoco|<counter"), jacoco_lines),
    "opencover": (lambda c: c.rlike("<CoverageSession"), opencover_lines),
    "clover": (lambda c: c.rlike(r"<coverage\b") & c.rlike(r"<project\b"), clover_lines),
    "cobertura": (lambda c: c.rlike(r"<coverage\b"), cobertura_lines),
    "istanbul": (lambda c: F.contains(c, F.lit('"statementMap"')), istanbul_lines),
    "simplecov": (lambda c: F.contains(c, F.lit('"coverage"')), simplecov_lines),
}


def register(name: str, tells: Callable[[Column], Column], reader: Callable[[DataFrame], DataFrame]) -> None:
    FORMATS[name] = tells, reader


def detect(reports: DataFrame) -> DataFrame:
    """Adds format: the first that the content tells, null for none."""
    found = F.lit(None).cast("string")
    for name, (tells, _) in reversed(FORMATS.items()):
        found = F.when(tells(F.col("content")), name).otherwise(found)
    return reports.withColumn("format", found)


def read_lines(reports: DataFrame) -> DataFrame:
    """Lines of reports of any known format."""
    known, out = detect(reports), None
    for name, (_, reader) in FORMATS.items():
        part = reader(known.where(F.col("format") == name).select("report", "content")).select(*LINES)
        out = part if out is None else out.unionByName(part)
    return out
