"""Queries of section 2.9: streams and increments. A bounded table goes through the same operators as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diff, joins
from ..streaming import events as ev
from .registry import query


@query("o225_debounce", """
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events),
         s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT user_id, epoch_us(min(ts)) AS started_us, count(*) AS events FROM s GROUP BY user_id, s""")
def _(f):
    return ev.debounced(f.events, "ts", "user_id", "30 minutes").select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("started_us"), "events")


@query("o225_windowed", """
    SELECT epoch_ms(time_bucket(INTERVAL 1 HOUR, ts)) AS started_ms, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def _(f):
    return ev.windowed(f.events, "ts", "1 hour", None, "10 minutes", ["event_type"]).select(F.unix_millis(F.col("start").cast("timestamp")).alias("started_ms"), "event_type", "events", "total")


@query("o226_pending_flush", "SELECT DISTINCT user_id, event_type FROM events")
def _(f):
    return f.events.dropDuplicates(["user_id", "event_type"]).select("user_id", "event_type")


@query("o228_polled_changes", """
    WITH a AS (SELECT 'f' || CAST(c_custkey AS STRING) AS path, c_custkey % 5 AS m FROM customer WHERE c_custkey % 7 <> 0), b AS (SELECT 'f' || CAST(c_custkey AS STRING) AS path, c_custkey % 3 AS m FROM customer WHERE c_custkey % 11 <> 0)
    SELECT * FROM (SELECT path, CASE WHEN a.m IS NULL THEN 'created' WHEN b.m IS NULL THEN 'deleted' WHEN a.m <> b.m THEN 'modified' END AS kind FROM a FULL OUTER JOIN b USING (path)) WHERE kind IS NOT NULL""")
def _(f):
    k = F.col("c_custkey")
    path = F.concat(F.lit("f"), k.cast("string")).alias("path")
    return ev.polled_changes(f.customer.where("c_custkey % 7 <> 0").select(path, (k % 5).alias("mtime")), f.customer.where("c_custkey % 11 <> 0").select(path, (k % 3).alias("mtime")))


@query("o233_incremental_reindex", "SELECT DISTINCT file_id FROM (SELECT id AS file_id FROM files WHERE id IN (3, 4) UNION ALL SELECT file_id FROM refs WHERE target_def_uid IS NOT NULL AND target_def_uid NOT IN (SELECT def_uid FROM defs WHERE file_id NOT IN (3, 4)))")
def _(f):
    lost = joins.dangling(f.refs, f.defs.where("file_id NOT IN (3, 4)"))
    return ev.widened(f.files.where("id IN (3, 4)").select(F.col("id").alias("file_id")), lost)


@query("o234_full_reindex_diff", "SELECT path, CASE WHEN worktree_id = 1 THEN 'removed' ELSE CASE WHEN id % 2 = 0 THEN 'modified' ELSE 'unchanged' END END AS change FROM files")
def _(f):
    now = f.files.where("worktree_id <> 1").withColumn("content_hash", F.when(F.col("id") % 2 == 0, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")))
    return diff.reconcile(f.files, now)


@query("o235_stale_coverage", "SELECT target_def_uid, count(*) AS facts, CAST(count(*) FILTER (stale OR target_def_uid IN (SELECT def_uid FROM defs WHERE file_id < 30)) AS BIGINT) AS stale_facts FROM coverage GROUP BY 1")
def _(f):
    changed = f.defs.where("file_id < 30").select(F.col("def_uid").alias("target_def_uid"))
    return ev.mark_stale(f.coverage, changed).groupBy("target_def_uid").agg(F.count("*").alias("facts"), F.sum(F.col("stale").cast("long")).alias("stale_facts"))


@query("o236_signal_backfill", "SELECT def_uid FROM defs WHERE def_uid NOT IN (SELECT 'd' || CAST(vec_id AS STRING) FROM embeddings WHERE label <> 1)")
def _(f):
    return joins.without(f.defs, f.embeddings.where("label <> 1").select(F.concat(F.lit("d"), F.col("vec_id").cast("string")).alias("def_uid")), "def_uid").select("def_uid")


@query("o231_epoch_publish", "SELECT epoch_id, count(*) AS n FROM snapshots WHERE epoch_id = 7 GROUP BY 1")
def _(f):
    import uuid

    from ..operators.graph import shared_folder

    epochs = ev.Epochs(f.spark, f"{shared_folder(f.spark)}/factloom-epochs/{uuid.uuid4().hex}")
    for e in (6, 7):
        epochs.publish(f.snapshots.where(F.col("epoch_id") == e), e)
    return epochs.read().groupBy("epoch_id").agg(F.count("*").alias("n"))


def folder(f, name):
    """A fresh folder that all executors see."""
    import uuid

    from ..operators.graph import shared_folder

    return f"{shared_folder(f.spark)}/factloom-{name}/{uuid.uuid4().hex}"


@query("o232_epoch_recovery", "SELECT epoch_id, count(*) AS n, '8' AS discarded FROM snapshots WHERE epoch_id = 7 GROUP BY 1")
def _(f):
    epochs = ev.Epochs(f.spark, folder(f, "epochs"))
    epochs.publish(f.snapshots.where("epoch_id = 7"), 7)
    f.snapshots.where("epoch_id = 6").write.parquet(f"{epochs.root}/epoch=8")  # a writer that died before its pointer
    gone = ",".join(map(str, epochs.discard_unfinished()))
    return epochs.read().groupBy("epoch_id").agg(F.count("*").alias("n")).withColumn("discarded", F.lit(gone))


TOK = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


@query("o039_lexical_index", f"""
    WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'ring the ' || lang ELSE text END AS text FROM documents WHERE doc_id % 3 <> 1), w AS (SELECT doc_id, {TOK.format('text')} AS t FROM d),
         u AS (SELECT doc_id, CAST(len(t) AS BIGINT) AS dl, unnest(t) AS term FROM w)
    SELECT doc_id, term, count(*) AS tf, max(dl) AS dl FROM u WHERE term IN ('ring', 'the', 'und', 'de', 'no such') GROUP BY 1, 2""")
def _(f):
    """Published in three parts: all documents; a third anew; a third removed."""
    from ..operators.index import LexicalIndex

    index = LexicalIndex(f.spark, folder(f, "index"), "doc_id")
    index.publish(f.documents.select("doc_id", "text"))
    index.publish(f.documents.where("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("ring the "), "lang").alias("text")))
    index.publish(f.documents.limit(0).select("doc_id", "text"), f.documents.where("doc_id % 3 = 1").select("doc_id"))
    return index.look_up(["ring", "the", "und", "de", "no such"]).drop("bucket")


@query("o035_json_lines_merge", "SELECT doc_id, lang, 'part-b' AS repo FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, lang, 'part-a' FROM documents WHERE doc_id % 2 = 1")
def _(f):
    from ..sources.tables import json_lines

    root = folder(f, "lines")
    for name, rest in (("part-b", 0), ("part-a", 1)):
        f.documents.where(F.col("doc_id") % 2 == rest).select("doc_id", "lang").write.json(f"{root}/{name}")
    merged = json_lines(f.spark, f"{root}/*", "doc_id long, lang string")
    merged.write.parquet(f"{root}/merged")
    return f.spark.read.parquet(f"{root}/merged")


@query("o041_health_snapshots", "SELECT CAST(e AS BIGINT) AS epoch, (SELECT count(*) FROM files WHERE id % 5 < e) AS files FROM (SELECT unnest([3, 4, 5]) AS e)")
def _(f):
    from ..sources.tables import append_snapshot, last_snapshots

    root = folder(f, "health")
    for e in range(1, 6):
        append_snapshot(f.files.where(F.col("id") % 5 < e).agg(F.count("*").alias("files")).withColumn("epoch", F.lit(e)), root)
    return last_snapshots(f.spark, root, "epoch long, files long", 3)


@query("o038_upsert", """
    WITH c AS (SELECT doc_id, quality, toxic FROM labels), n AS (SELECT doc_id, CAST(1 AS INTEGER) AS quality, CAST(0 AS INTEGER) AS toxic FROM documents WHERE doc_id % 10 = 0)
    SELECT * FROM n UNION ALL SELECT * FROM c WHERE doc_id NOT IN (SELECT doc_id FROM n)""")
def _(f):
    new = f.documents.where("doc_id % 10 = 0").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    return joins.merge_rows(f.labels.select("doc_id", "quality", "toxic"), new, ["doc_id"])


@query("o034_parquet_scan", "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE n_chars > 1000 GROUP BY 1")
def _(f):
    return f.documents.where("n_chars > 1000").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("o036_schema_alignment", "SELECT CAST(doc_id AS STRING) AS doc_id, CAST(NULL AS DOUBLE) AS score, lang FROM documents")
def _(f):
    from ..sources.tables import aligned

    return aligned(f.documents, "doc_id string, score double, lang string")
