"""Containment, interval, as-of, anti and self joins over the facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines to a bucket: intervals are cut into buckets, so that a join on file and bucket stays linear in one large file.
BUCKET = 64

#: Of products(): values to a list, most copies of a list, by which the pairs of one key are dealt out to tasks, and least number of tasks.
RUN, COPIES, PIECES = 256, 16, 128


def contained(points: DataFrame, point: str, intervals: DataFrame, keys: list[str], start: str = "start_line", end: str = "end_line") -> DataFrame:
    """Every pair of a point and an interval of the same keys that holds it.

    Intervals are listed under each bucket they touch and points under their
    own, so the join is an equality join and each pair comes once.
    """
    cut = intervals.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / BUCKET), F.floor(F.col(end) / BUCKET))))
    at = points.withColumn("_bucket", F.floor(F.col(point) / BUCKET))
    hit = (F.col(point) >= F.col(start)) & (F.col(point) <= F.col(end))
    return at.join(cut, [*keys, "_bucket"]).where(hit).drop("_bucket")


def covering(points: DataFrame, point: str, intervals: DataFrame, keys: list[str], start: str = "start_line", end: str = "end_line") -> DataFrame:
    """As contained, where some intervals may be very long: each is listed under nine buckets at most, of a width that suits its length.

    Points are listed under every width that occurs, of fifteen.
    """
    length = F.col(end).cast("double") - F.col(start).cast("double")
    shift = reduce(lambda c, k: c.when(length <= 8 * 2.0**k, k), range(10, 60, 4), F.when(length <= 8 * 2.0**6, 6)).otherwise(62)
    sized = intervals.where(F.col(start) <= F.col(end)).withColumn("_shift", shift)
    used = sorted(r["_shift"] for r in sized.select("_shift").distinct().collect())
    bucket = lambda c: F.expr(f"shiftright(CAST(`{c}` AS BIGINT), _shift)")
    cut = sized.withColumn("_bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    at = points.withColumn("_shift", F.explode(F.array(*[F.lit(k) for k in used]).cast("array<int>"))).withColumn("_bucket", bucket(point))
    hit = (F.col(point) >= F.col(start)) & (F.col(point) <= F.col(end))
    return at.join(cut, [*keys, "_shift", "_bucket"]).where(hit).drop("_shift", "_bucket")


def overlapping(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of intervals (start, end) and (other_start, other_end) that share a line, each once: in the bucket of the later start."""
    left = a.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor(F.col("end") / BUCKET))))
    right = b.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("other_start") / BUCKET), F.floor(F.col("other_end") / BUCKET))))
    hit = (F.col("start") <= F.col("other_end")) & (F.col("end") >= F.col("other_start"))
    once = F.col("_bucket") == F.floor(F.greatest("start", "other_start") / BUCKET)
    return left.join(right, [*keys, "_bucket"]).where(hit & once).drop("_bucket")


def enclosing_refs(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """src, dst: each definition whose lines hold a reference, and the reference's target; self references dropped."""
    points = refs.where(F.col("target_def_uid").isNotNull()).select("file_id", F.col("start_line").alias("_line"), F.col("target_def_uid").alias("dst"))
    spans = defs.select("file_id", "start_line", "end_line", F.col("def_uid").alias("src"))
    return contained(points, "_line", spans, ["file_id"]).where("src <> dst").select("src", "dst").distinct()


def callees(defs: DataFrame, refs: DataFrame, of: DataFrame) -> DataFrame:
    """src, dst for the definitions in of (def_uid): known targets of references within their lines."""
    spans = defs.join(of.select("def_uid").distinct(), "def_uid", "left_semi")
    known = defs.select(F.col("def_uid").alias("dst"))
    return enclosing_refs(refs, spans).join(known, "dst", "left_semi").select("src", "dst")


def innermost(points: DataFrame, point: str, scopes: DataFrame, key: str, preferred: str | None = None) -> DataFrame:
    """Each point (key) with its smallest enclosing scope: of the preferred kind if there is one, of the whole file only as a last resort."""
    rank = F.when(F.col("kind") == preferred, 0).when(F.col("kind") != "file", 1).otherwise(2) if preferred else F.when(F.col("kind") != "file", 1).otherwise(2)
    # what is innermost changes only where a scope begins or has ended: it is found there, and each point takes the last before it
    last = (1 << 63) - 1
    after = F.col("end_line").cast("long")
    edges = F.array(F.col("start_line").cast("long"), F.when(after < last, after + 1))
    at = scopes.where("file_id IS NOT NULL AND start_line <= end_line").select("file_id", F.explode(edges).alias("_at")).where("_at IS NOT NULL").distinct()
    best = F.min(F.struct(rank.alias("_rank"), (F.col("end_line") - F.col("start_line")).alias("_length"), "scope_id", "kind"))
    there = covering(at, "_at", scopes, ["file_id"]).groupBy("file_id", "_at").agg(best.alias("best"))
    steps = at.join(there, ["file_id", "_at"], "left").withColumnRenamed("_at", point)
    found = as_of_join(points.where(F.col("file_id").isNotNull() & F.col(point).isNotNull()).select(key, "file_id", point), steps, ["file_id"], point, ["best"])
    return found.where("best IS NOT NULL").groupBy(key).agg(F.min("best").alias("_s")).select(key, "_s.scope_id", "_s.kind")


def as_of(snapshots: DataFrame, keys: list[str], version: str, at: int, tie: str) -> DataFrame:
    """The latest row of each key up to a version."""
    rest = [c for c in snapshots.columns if c not in keys]
    latest = F.max_by(F.struct(*rest), F.struct(version, tie))
    return snapshots.where(F.col(version) <= at).groupBy(*keys).agg(latest.alias("_r")).select(*keys, "_r.*")


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, columns: list[str]) -> DataFrame:
    """Each left row with the columns of the last right row of its keys at or before its time.

    Both sides go through one window over their union, so that no pairs arise.
    """
    names = left.columns
    a = left.select(*names, F.lit(1).alias("_side"), *[F.lit(None).alias(f"_{c}") for c in columns])
    b = right.select(*[F.col(c) if c in [*keys, time] else F.lit(None).cast(dict(left.dtypes)[c]).alias(c) for c in names], F.lit(0).alias("_side"), *[F.col(c).alias(f"_{c}") for c in columns])
    order = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    row = F.when(F.col("_side") == 0, F.struct(*[F.col(f"_{c}").alias(c) for c in columns]))
    found = a.unionByName(b).withColumn("_last", F.last(row, ignorenulls=True).over(order)).where("_side = 1")
    return found.select(*names, *[F.col(f"_last.{c}").alias(c) for c in columns])


def without(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of left whose key is not in right; unlike NOT IN, nulls in right hide nothing."""
    return left.join(right.select(key).distinct(), key, "left_anti")


def co_implementors(impls: DataFrame, of: DataFrame) -> DataFrame:
    """def_uid, other: other definitions that share an interface with those in of."""
    mine = impls.join(of.select(F.col("def_uid").alias("implementor_def_uid")).distinct(), "implementor_def_uid", "left_semi")
    mine = mine.select(F.col("implementor_def_uid").alias("def_uid"), "interface_name")
    return mine.join(impls.withColumnRenamed("implementor_def_uid", "other"), "interface_name").where("def_uid <> other").select("def_uid", "other").distinct()


def products(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """a, b: every pair of an a of left (key, a) and a b of right (key, b) that have one key.

    Lists of values are shuffled and met, and pairs arise only at the end. There each
    b stands beside a short list of a, so that columnar files hold its runs in a
    fraction of a byte for each pair; one long list would fill their pages anew for each b.
    """

    def lists(x: DataFrame, c: str) -> DataFrame:
        at = F.row_number().over(Window.partitionBy(key).orderBy(c))
        return x.select(key, c, F.floor((at - 1) / RUN).alias("_list")).groupBy(key, "_list").agg(F.collect_list(c).alias(f"_{c}"))

    # a stated number of partitions, as adaptive execution joins them by the size of the lists and not by that of the pairs
    n = max(PIECES, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    copies = right.groupBy(key).agg(F.least(F.lit(COPIES), F.ceil(F.count("*") / RUN)).cast("int").alias("_copies"))
    copied = lists(left, "a").join(copies, key).select(key, "_a", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("_copy")).repartition(n, key, "_copy")
    dealt = lists(right, "b").withColumn("_copy", (F.col("_list") % COPIES).cast("int")).repartition(n, key, "_copy")
    met = copied.join(dealt.drop("_list"), [key, "_copy"])
    return met.select("_a", F.explode("_b").alias("b")).select(F.explode("_a").alias("a"), "b")


def hierarchy(impls: DataFrame, defs: DataFrame, of: DataFrame) -> DataFrame:
    """def_uid, relation, other of each definition in of, one step away.

    interface: the names it implements; super: the definitions of those names;
    sub: the definitions that implement its own name.
    """
    pairs = impls.select("implementor_def_uid", "interface_name").distinct()
    mine = of.select("def_uid").distinct()
    named = defs.select(F.col("def_uid").alias("other"), F.col("name").alias("interface_name")).distinct()
    up = pairs.join(mine.select(F.col("def_uid").alias("implementor_def_uid")), "implementor_def_uid", "left_semi").withColumnRenamed("implementor_def_uid", "def_uid")
    own = defs.join(mine, "def_uid", "left_semi").select("def_uid", F.col("name").alias("interface_name")).distinct()
    implementing = pairs.withColumnRenamed("implementor_def_uid", "other")
    rows = [up.select("def_uid", F.lit("interface").alias("relation"), F.col("interface_name").alias("other"))]
    # definitions of one name meet an implementor once: only those of several names may meet it again, and only their pairs are made distinct
    several = defs.groupBy("def_uid").agg(F.min("name").alias("_a"), F.max("name").alias("_z")).where("_a <> _z").select("def_uid")
    again = several.withColumnRenamed("def_uid", "other")
    for how, met in (("left_anti", products), ("left_semi", lambda a, b, key: a.join(b, key).select("a", "b").distinct())):
        found = ("super", "a", "b", up, named.join(again, "other", how)), ("sub", "b", "a", implementing, own.join(several, "def_uid", how))
        for relation, this, other, a, b in found:
            pairs = met(a.toDF("a", "interface_name"), b.toDF("b", "interface_name"), "interface_name").where("a <> b")
            rows.append(pairs.select(F.col(this).alias("def_uid"), F.lit(relation).alias("relation"), F.col(other).alias("other")))
    return reduce(DataFrame.unionByName, rows)


def implementors(impls: DataFrame, interfaces: list[str]) -> DataFrame:
    """The definitions that implement a stated list of interfaces."""
    return impls.where(F.col("interface_name").isin(interfaces)).select("implementor_def_uid", "interface_name").distinct()


def cross_references_of(xrefs: DataFrame, of: list[str]) -> DataFrame:
    """References of documentation from or to a stated list of definitions."""
    return xrefs.where(F.col("source_def_uid").isin(of) | F.col("target_def_uid").isin(of)).select("id", "source_def_uid", "target_def_uid", "confidence")


def first_per(df: DataFrame, key: str, order: list) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def url_links(endpoints: DataFrame) -> DataFrame:
    """server, client ids of which one URL pattern is a whole-segment beginning of the other, or equal.

    Containment anywhere has no join key. Patterns are paths, so each is listed
    under all runs of its segments, and the shorter meets the longer there.
    """
    p = endpoints.select("id", "kind", "url_pattern").distinct()
    parts = F.split(F.regexp_replace("url_pattern", "^/|/$", ""), "/")
    n = F.size(parts)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: F.array_join(F.slice(parts, i, j - i + 1), "/"))))
    listed = p.select(F.col("id").alias("long_id"), F.col("kind").alias("long_kind"), F.explode(F.array_distinct(runs)).alias("run"))
    short = p.select(F.col("id").alias("short_id"), F.col("kind").alias("short_kind"), F.array_join(parts, "/").alias("run"))
    met = listed.join(short, "run").where("long_kind <> short_kind")
    server = F.when(F.col("long_kind") == "server", F.col("long_id")).otherwise(F.col("short_id"))
    client = F.when(F.col("long_kind") == "server", F.col("short_id")).otherwise(F.col("long_id"))
    return met.select(server.alias("server"), client.alias("client")).distinct()


def coverage_by_intervals(lines: DataFrame, defs: DataFrame) -> DataFrame:
    """def_uid, covered_lines, total_lines, line_rate of a line report (path, line, hits) over definitions (path, start_line, end_line)."""
    found = contained(lines, "line", defs, ["path"])
    covered = F.sum((F.col("hits") > 0).cast("long"))
    return found.groupBy("def_uid").agg(covered.alias("covered_lines"), F.count("*").alias("total_lines"), F.round(covered / F.count("*"), 6).alias("line_rate"))


def merge_rows(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: new rows replace current ones of the same keys."""
    return current.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def dangling(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """References whose target isn't there."""
    known = defs.select(F.col("def_uid").alias("target_def_uid"))
    return refs.where(F.col("target_def_uid").isNotNull()).join(known, "target_def_uid", "left_anti")


def cleared(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """refs with null in place of targets that aren't there."""
    known = defs.select(F.col("def_uid").alias("target_def_uid"), F.lit(True).alias("_known"))
    joined = refs.join(known, "target_def_uid", "left")
    return joined.withColumn("target_def_uid", F.when(F.col("_known"), F.col("target_def_uid"))).drop("_known")


def reuse_by_hash(files: DataFrame) -> DataFrame:
    """id, donor: the smallest file of another worktree with the same content."""
    donors = files.groupBy("content_hash", "worktree_id").agg(F.min("id").alias("donor"))
    donors = donors.withColumnRenamed("worktree_id", "_other")
    met = files.join(donors, "content_hash").where("worktree_id <> _other")
    return met.groupBy("id").agg(F.min("donor").alias("donor"))


def test_file(test_id: Column) -> Column:
    return F.split(test_id, "::")[0]
