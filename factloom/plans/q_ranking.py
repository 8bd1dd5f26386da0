"""Queries of section 2.5 and 2.6: fusion, cutoffs, evaluation, diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diff, ranking
from ..operators.aggregates import cutoff_features
from .registry import query

CANDIDATES = """
    c AS (SELECT CAST(p_size % 4 AS BIGINT) AS query_id, 'd' || CAST(p_partkey AS STRING) AS def_uid, p_partkey AS ord, 'src/f' || CAST(p_partkey % 60 AS STRING) || '.py' AS path,
        p_partkey % 5 AS term_match_count, CAST(p_partkey % 11 AS DOUBLE) AS bm25, CASE p_partkey % 9 WHEN 0 THEN 'agent_seed' WHEN 1 THEN 'pin' WHEN 2 THEN 'auto_seed' END AS symbol_source,
        CASE WHEN p_partkey % 4 = 0 THEN 'callee' END AS edge, CASE p_partkey % 3 WHEN 0 THEN 'proven' WHEN 1 THEN 'strong' ELSE 'unknown' END AS tier, p_partkey % 7 AS seed_rank,
        CASE p_partkey % 6 WHEN 0 THEN 'reverse' WHEN 1 THEN 'forward' END AS dir, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END AS splade, p_partkey % 13 = 0 AS shares, p_partkey % 17 = 0 AS cov,
        p_partkey % 4 AS hits, p_size AS hub, p_partkey % 19 = 0 AS callee, p_partkey % 23 = 0 AS imported FROM part)"""
LISTS = CANDIDATES + """,
    l AS (
        SELECT query_id, def_uid, 'term_match' AS list, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, term_match_count DESC, ord) AS rank FROM c WHERE term_match_count > 0
        UNION ALL SELECT query_id, def_uid, 'explicit', row_number() OVER (PARTITION BY query_id ORDER BY CASE symbol_source WHEN 'agent_seed' THEN 0 WHEN 'pin' THEN 1 ELSE 4 END, ord) FROM c WHERE symbol_source IS NOT NULL
        UNION ALL SELECT query_id, def_uid, 'graph', row_number() OVER (PARTITION BY query_id ORDER BY CASE tier WHEN 'proven' THEN 3 WHEN 'strong' THEN 2 ELSE 0 END DESC, CASE WHEN seed_rank = 0 THEN 999 ELSE seed_rank END, ord) FROM c WHERE edge IS NOT NULL
        UNION ALL SELECT query_id, def_uid, 'import', row_number() OVER (PARTITION BY query_id ORDER BY CASE dir WHEN 'reverse' THEN 1 ELSE 2 END, ord) FROM c WHERE dir IS NOT NULL
        UNION ALL SELECT query_id, def_uid, 'splade', row_number() OVER (PARTITION BY query_id ORDER BY splade DESC, ord) FROM c WHERE splade > 0
        UNION ALL SELECT query_id, def_uid, 'shares_file', row_number() OVER (PARTITION BY query_id ORDER BY ord) FROM c WHERE shares
        UNION ALL SELECT query_id, def_uid, 'coverage', row_number() OVER (PARTITION BY query_id ORDER BY ord) FROM c WHERE cov
        UNION ALL SELECT query_id, def_uid, 'retriever_agreement', row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, ord) FROM c WHERE hits >= 2
        UNION ALL SELECT query_id, def_uid, 'hub_score', row_number() OVER (PARTITION BY query_id ORDER BY hub DESC, ord) FROM c WHERE hub > 0
        UNION ALL SELECT query_id, def_uid, 'callee_of_seed', row_number() OVER (PARTITION BY query_id ORDER BY ord) FROM c WHERE callee
        UNION ALL SELECT query_id, def_uid, 'imported_by_seed', row_number() OVER (PARTITION BY query_id ORDER BY ord) FROM c WHERE imported)"""
SCORED = LISTS + """,
    s AS (SELECT c.query_id, c.def_uid, c.path, c.symbol_source, coalesce(r.s, 0.0) AS rrf_score FROM c LEFT JOIN (SELECT query_id, def_uid, round(sum(1.0 / (60 + rank)), 9) AS s FROM l GROUP BY 1, 2) r USING (query_id, def_uid))"""


def candidates(f):
    k = F.col("p_partkey")
    return f.part.select(
        (F.col("p_size") % 4).cast("long").alias("query_id"), F.concat(F.lit("d"), k.cast("string")).alias("def_uid"), k.alias("ord"), F.concat(F.lit("src/f"), (k % 60).cast("string"), F.lit(".py")).alias("path"),
        (k % 5).alias("term_match_count"), (k % 11).cast("double").alias("bm25_file_score"), F.when(k % 9 == 0, "agent_seed").when(k % 9 == 1, "pin").when(k % 9 == 2, "auto_seed").alias("symbol_source"),
        F.when(k % 4 == 0, "callee").alias("graph_edge_type"), F.when(k % 3 == 0, "proven").when(k % 3 == 1, "strong").otherwise("unknown").alias("graph_caller_max_tier"), (k % 7).alias("graph_seed_rank"),
        F.when(k % 6 == 0, "reverse").when(k % 6 == 1, "forward").alias("import_direction"), F.when(k % 2 == 0, F.col("p_retailprice")).alias("splade_score"), (k % 13 == 0).alias("shares_file_with_seed"),
        (k % 17 == 0).alias("from_coverage"), (k % 4).alias("retriever_hits"), F.col("p_size").alias("hub_score"), (k % 19 == 0).alias("is_callee_of_top"), (k % 23 == 0).alias("is_imported_by_top"),
    )


@query("o152_rank_fusion", f"WITH {SCORED} SELECT query_id, def_uid, rrf_score FROM s")
def _(f):
    return ranking.fuse_candidates(candidates(f)).select("query_id", "def_uid", "rrf_score")


@query("o153_rank_lists", f"WITH {LISTS} SELECT query_id, def_uid, list, rank FROM l")
def _(f):
    return ranking.ranked_lists(candidates(f))


@query("o154_file_prune", f"""
    WITH {SCORED}, b AS (SELECT query_id, path, max(rrf_score) AS best, bool_or(coalesce(symbol_source IN ('pin', 'agent_seed'), false)) AS pin FROM s GROUP BY 1, 2),
         k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, path) AS p FROM b)
    SELECT query_id, def_uid, path FROM s WHERE (query_id, path) IN (SELECT (query_id, path) FROM k WHERE p <= 5 OR pin)""")
def _(f):
    return ranking.prune_files(ranking.fuse_candidates(candidates(f)), most=5).select("query_id", "def_uid", "path")


ELBOW = """
    g AS (SELECT *, row_number() OVER w AS r, rrf_score - lead(rrf_score) OVER w AS gap FROM s WINDOW w AS (PARTITION BY query_id ORDER BY rrf_score DESC, def_uid)),
    h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gap DESC NULLS LAST, r) AS b, count(*) OVER (PARTITION BY query_id) AS c FROM g),
    n AS (SELECT query_id, CASE WHEN max(c) <= 3 THEN max(c) WHEN coalesce(max(gap), 0) <= 0 THEN least(30, max(c)) ELSE greatest(3, least(max(CASE WHEN b = 1 THEN r END), least(30, max(c)))) END AS n FROM h GROUP BY 1)"""


@query("o155_elbow", f"WITH {SCORED}, {ELBOW.replace('    n AS', '    n2 AS')} SELECT query_id, CAST(n AS BIGINT) AS n FROM n2")
def _(f):
    return ranking.elbow(ranking.fuse_candidates(candidates(f)), "query_id", "rrf_score", "def_uid")


@query("o160_heuristic_pipeline", f"""
    WITH {SCORED}, b AS (SELECT query_id, path, max(rrf_score) AS best, bool_or(coalesce(symbol_source IN ('pin', 'agent_seed'), false)) AS pin FROM s GROUP BY 1, 2),
         kk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, path) AS p FROM b), s1 AS (SELECT * FROM s WHERE (query_id, path) IN (SELECT (query_id, path) FROM kk WHERE p <= 20 OR pin)),
         {ELBOW.replace('FROM s WINDOW', 'FROM s1 WINDOW').replace('    n AS', '    n2 AS')}
    SELECT g.query_id, g.def_uid, g.r AS rank FROM g JOIN n2 ON n2.query_id = g.query_id WHERE g.r <= n2.n""")
def _(f):
    from pyspark.sql import Window

    kept = ranking.prune_files(ranking.fuse_candidates(candidates(f)))
    n = ranking.elbow(kept, "query_id", "rrf_score", "def_uid")
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rrf_score").desc(), "def_uid"))
    return kept.withColumn("rank", r.cast("long")).join(n, "query_id").where("rank <= n").select("query_id", "def_uid", "rank")


RANKED = "SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank, coalesce(quality, 0) AS label, coalesce(quality, 0) * 2 - CASE WHEN toxic = 1 THEN coalesce(quality, 0) ELSE 0 END AS gain FROM documents LEFT JOIN labels USING (doc_id)"


def ranked(f):
    from pyspark.sql import Window

    d = f.documents.select("doc_id", "lang", "n_chars").join(f.labels, "doc_id", "left")
    q = F.coalesce("quality", F.lit(0))
    r = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n_chars").desc(), "doc_id")).cast("long")
    return d.select("lang", "doc_id", r.alias("rank"), q.alias("label"), (q * 2 - F.when(F.col("toxic") == 1, q).otherwise(0)).alias("gain"))


@query("o156_best_n", f"""
    WITH r AS ({RANKED}), h AS (SELECT lang, rank, sum(label) OVER (PARTITION BY lang ORDER BY rank) AS hits, sum(label) OVER (PARTITION BY lang) AS total FROM r),
         f AS (SELECT lang, rank, round(CASE WHEN total > 0 THEN 2 * hits / (rank + total) ELSE 0 END, 9) AS f FROM h WHERE rank <= 100), k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY f DESC, rank) AS p FROM f)
    SELECT lang, rank AS n_star, round(f, 6) AS f1 FROM k WHERE p = 1""")
def _(f):
    return ranking.best_n(ranked(f), "lang")


@query("o157_subsample", f"""
    WITH r AS ({RANKED}), k AS (SELECT *, row_number() OVER (PARTITION BY lang, label > 0 ORDER BY md5('s:' || CAST(doc_id AS STRING)), doc_id) AS p FROM r)
    SELECT lang, doc_id, label FROM k WHERE (label > 0 OR p <= 20) AND lang IN (SELECT lang FROM r WHERE label > 0)""")
def _(f):
    return ranking.subsample_negatives(ranked(f), "lang", "label", "doc_id", 20).select("lang", "doc_id", "label")


@query("o165_ndcg", f"""
    WITH r AS ({RANKED}), i AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY gain DESC, rank) AS i FROM r),
         d AS (SELECT lang, sum(CASE WHEN rank <= 20 THEN gain / log2(rank + 1) ELSE 0 END) AS d, sum(CASE WHEN i <= 20 THEN gain / log2(i + 1) ELSE 0 END) AS b FROM i GROUP BY 1)
    SELECT lang, round(CASE WHEN b > 0 THEN d / b ELSE 0 END, 6) AS ndcg FROM d""")
def _(f):
    return ranking.ndcg(ranked(f), "lang", 20)


@query("o166_precision_recall", f"""
    WITH r AS ({RANKED}), k AS (SELECT unnest([5, 10, 20]) AS k), g AS (SELECT lang, k, CAST(count(*) FILTER (rank <= k AND label > 0) AS DOUBLE) AS h, count(*) FILTER (label > 0) AS t, least(max(k), count(*)) AS n FROM r, k GROUP BY 1, 2),
         x AS (SELECT lang, k, h, h / n AS p, CASE WHEN t > 0 THEN h / t ELSE 0 END AS r FROM g)
    SELECT lang, k, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, h > 0 AS hit FROM x""")
def _(f):
    return ranking.precision_recall(ranked(f), "lang")


@query("o167_reciprocal_rank", f"WITH r AS ({RANKED}), m AS (SELECT lang, min(CASE WHEN label > 0 THEN rank END) AS r FROM r GROUP BY 1) SELECT round(avg(coalesce(1.0 / r, 0)), 6) AS mrr, count(*) AS queries FROM m")
def _(f):
    return ranking.mean_reciprocal_rank(ranked(f), "lang")


@query("o167_ablation", f"""
    WITH {LISTS}, y AS (SELECT query_id, def_uid FROM c WHERE hub % 10 = 0), x AS (SELECT DISTINCT list AS left_out FROM l UNION ALL SELECT 'none'),
         t AS (SELECT left_out, query_id, def_uid, round(sum(1.0 / (60 + rank)), 9) AS s FROM l JOIN x ON list <> left_out GROUP BY ALL),
         k AS (SELECT *, row_number() OVER (PARTITION BY left_out, query_id ORDER BY s DESC, def_uid) AS p FROM t)
    SELECT x.left_out, round(count(y.def_uid) / (SELECT count(*) FROM y), 6) AS recall FROM x LEFT JOIN k ON k.left_out = x.left_out AND p <= 20 LEFT JOIN y ON y.query_id = k.query_id AND y.def_uid = k.def_uid GROUP BY 1""")
def _(f):
    c = candidates(f)
    return ranking.ablation(ranking.ranked_lists(c), c.where("hub_score % 10 = 0"))


@query("o139_candidate_merge", """
    WITH u AS (SELECT 'd' || CAST(p_partkey AS STRING) AS def_uid, true AS from_term, false AS from_explicit, CAST(p_size AS DOUBLE) AS score, p_name AS term, CAST(NULL AS STRING) AS source, 1 AS tier FROM part WHERE p_size < 20
        UNION ALL SELECT 'd' || CAST(p_partkey AS STRING), false, true, p_retailprice, p_brand, CASE WHEN p_partkey % 2 = 0 THEN 'pin' ELSE 'auto_seed' END, 3 FROM part WHERE p_size > 10)
    SELECT def_uid, bool_or(from_term) AS from_term, bool_or(from_explicit) AS from_explicit, max(score) AS score, array_to_string(list_sort(list(DISTINCT term)), ',') AS terms, min(source) FILTER (source = 'pin' OR source = 'auto_seed') AS source, max(tier) AS tier
    FROM u GROUP BY 1""")
def _(f):
    uid = F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("def_uid")
    a = f.part.where("p_size < 20").select(uid, F.lit(True).alias("from_term"), F.col("p_size").cast("double").alias("score"), F.array("p_name").alias("terms"), F.lit(None).cast("string").alias("source"), F.lit("anchored").alias("tier"))
    b = f.part.where("p_size > 10").select(uid, F.lit(True).alias("from_explicit"), F.col("p_retailprice").alias("score"), F.array("p_brand").alias("terms"), F.when(F.col("p_partkey") % 2 == 0, "pin").otherwise("auto_seed").alias("source"), F.lit("proven").alias("tier"))
    return ranking.merge_candidates([a, b]).withColumn("terms", F.array_join("terms", ","))


@query("o175_evidence_axes", "SELECT p_partkey, CAST(p_size % 2 = 0 AS INTEGER) + CAST(p_size % 3 = 0 AS INTEGER) + CAST(p_size % 5 = 0 AS INTEGER) AS axes FROM part")
def _(f):
    s = F.col("p_size")
    flags = f.part.select("p_partkey", (s % 2 == 0).alias("from_term"), (s % 3 == 0).alias("from_explicit"), (s % 5 == 0).alias("from_graph"), F.lit(None).cast("boolean").alias("from_coverage"))
    return flags.select("p_partkey", ranking.evidence_axes().alias("axes"))


@query("o168_offline_scoring", "SELECT source AS run_id, lang AS query_id, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents")
def _(f):
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("source", "lang").orderBy(F.col("n_chars").desc(), "doc_id")).cast("long")
    return f.documents.select(F.col("source").alias("run_id"), F.col("lang").alias("query_id"), "doc_id", r.alias("rank"))


@query("o169_locality", """
    WITH s AS (SELECT string_split(regexp_replace(path, '/[^/]*$', ''), '/') AS d FROM files WHERE id IN (1, 2)), f AS (SELECT path, string_split(regexp_replace(path, '/[^/]*$', ''), '/') AS d FROM files)
    SELECT path, min(CASE WHEN f.d[1] <> s.d[1] THEN 4 WHEN f.d[2] <> s.d[2] THEN 2 ELSE 0 END) AS distance FROM f, s GROUP BY 1""")
def _(f):
    from ..functions import paths

    seeds = f.files.where("id IN (1, 2)").select(F.col("path").alias("_seed"))
    return f.files.select("path").crossJoin(F.broadcast(seeds)).groupBy("path").agg(F.min(paths.tree_distance(F.col("path"), F.col("_seed"))).alias("distance"))  # a stated, short list of seeds


@query("o171_health_direction", """
    WITH e AS (SELECT epoch, avg(line_rate) AS rate FROM coverage GROUP BY 1), d AS (SELECT epoch, rate - lag(rate) OVER (ORDER BY epoch) AS d FROM e)
    SELECT epoch, CASE WHEN d IS NULL THEN 'unknown' WHEN d > 0.001 THEN 'improving' WHEN d < -0.001 THEN 'degrading' ELSE 'stable' END AS direction FROM d""")
def _(f):
    e = f.coverage.groupBy("epoch").agg(F.avg("line_rate").alias("rate"))
    return ranking.health_direction(e, band=0.001).select("epoch", "direction")


@query("o145_cutoff_by_score", f"""
    WITH {SCORED}, g AS (SELECT *, row_number() OVER w AS r, rrf_score - lead(rrf_score) OVER w AS gap FROM s WINDOW w AS (PARTITION BY query_id ORDER BY rrf_score DESC, def_uid)),
         b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gap DESC NULLS LAST, r) AS best FROM g)
    SELECT query_id, round(max(gap), 6) AS max_gap, max(CASE WHEN best = 1 THEN r END) AS gap_at, round(var_pop(rrf_score), 6) AS variance, round(sum(CASE WHEN r <= 10 THEN rrf_score END) / sum(rrf_score), 6) AS top10_mass FROM b GROUP BY 1""")
def _(f):
    return cutoff_features(ranking.fuse_candidates(candidates(f)), "query_id", "rrf_score", "def_uid")


BASE = "SELECT 'p' || CAST(c_nationkey AS STRING) AS path, CASE WHEN c_custkey % 2 = 0 THEN 'function' ELSE 'class' END AS kind, 's' || CAST(c_custkey AS STRING) AS lexical_path, md5(c_mktsegment || CAST(c_custkey % 50 AS STRING)) AS sig, c_custkey AS start_line FROM customer"
TARGET = """SELECT 'p' || CAST(c_nationkey AS STRING) AS path, CASE WHEN c_custkey % 2 = 0 THEN 'function' ELSE 'class' END AS kind, CASE WHEN c_custkey % 10 = 3 THEN 'r' ELSE 's' END || CAST(c_custkey AS STRING) AS lexical_path,
    md5(c_mktsegment || CAST((CASE WHEN c_custkey % 10 = 4 THEN c_custkey + 1 ELSE c_custkey END) % 50 AS STRING)) AS sig, c_custkey AS start_line FROM customer WHERE c_custkey % 10 <> 5 UNION ALL SELECT 'p0', 'class', 'n' || CAST(c_custkey AS STRING), md5(c_name), c_custkey FROM customer WHERE c_custkey % 40 = 1"""


def snapshots(f):
    k = F.col("c_custkey")
    kind = F.when(k % 2 == 0, "function").otherwise("class").alias("kind")
    path = F.concat(F.lit("p"), F.col("c_nationkey").cast("string")).alias("path")
    rest = [F.col("c_name").alias("name"), F.lit("f(a) -> b").alias("display_name"), k.alias("start_line"), (k + 5).alias("end_line")]
    sig = lambda n: F.md5(F.concat("c_mktsegment", (n % 50).cast("string"))).alias("signature_hash")
    base = f.customer.select(path, kind, F.concat(F.lit("s"), k.cast("string")).alias("lexical_path"), sig(k), *rest)
    target = f.customer.where("c_custkey % 10 <> 5").select(path, kind, F.concat(F.when(k % 10 == 3, "r").otherwise("s"), k.cast("string")).alias("lexical_path"), sig(F.when(k % 10 == 4, k + 1).otherwise(k)), *rest)
    new = f.customer.where("c_custkey % 40 = 1").select(F.lit("p0").alias("path"), F.lit("class").alias("kind"), F.concat(F.lit("n"), k.cast("string")).alias("lexical_path"), F.md5("c_name").alias("signature_hash"), *rest)
    return base, target.unionByName(new)


DIFF = f"""
    a AS ({BASE}), b AS ({TARGET}), m AS (SELECT path, kind, lexical_path, a.sig AS o, b.sig AS n, a.start_line AS os, b.start_line AS ns, a.sig IS NOT NULL AS ha, b.sig IS NOT NULL AS hb FROM a FULL OUTER JOIN b USING (path, kind, lexical_path)),
    g AS (SELECT *, row_number() OVER (PARTITION BY path, kind, o ORDER BY os, lexical_path) AS p FROM m WHERE NOT hb), d AS (SELECT *, row_number() OVER (PARTITION BY path, kind, n ORDER BY ns, lexical_path) AS p FROM m WHERE NOT ha),
    r AS (SELECT coalesce(g.path, d.path) AS path, coalesce(g.kind, d.kind) AS kind, coalesce(d.lexical_path, g.lexical_path) AS lexical_path, CASE WHEN g.path IS NULL THEN 'added' WHEN d.path IS NULL THEN 'removed' ELSE 'renamed' END AS change,
        CASE WHEN d.path IS NOT NULL THEN g.lexical_path END AS old_path FROM g FULL OUTER JOIN d ON g.path = d.path AND g.kind = d.kind AND g.o = d.n AND g.p = d.p),
    x AS (SELECT path, kind, lexical_path, change, old_path FROM r UNION ALL SELECT path, kind, lexical_path, CASE WHEN o <> n THEN 'signature_changed' ELSE 'body_changed' END, NULL FROM m WHERE ha AND hb)"""


@query("o173_structural_diff", f"WITH {DIFF} SELECT path, kind, lexical_path, change FROM x")
def _(f):
    return diff.structural_diff(*snapshots(f)).select("path", "kind", "lexical_path", "change")


@query("o174_rename_detection", f"WITH {DIFF} SELECT path, old_path, lexical_path FROM x WHERE change = 'renamed'")
def _(f):
    return diff.structural_diff(*snapshots(f)).where("change = 'renamed'").select("path", "old_path", "lexical_path")


@query("o149_diff_summary", f"WITH {DIFF} SELECT change, count(*) AS n FROM x GROUP BY 1")
def _(f):
    return diff.summary(diff.structural_diff(*snapshots(f)))


@query("o241_diff_with_risk", f"""
    WITH {DIFF}, k AS (SELECT 's' || CAST(l_partkey AS STRING) AS lexical_path, count(*) AS refs FROM lineitem GROUP BY 1)
    SELECT path, x.lexical_path, change, coalesce(refs, 0) AS refs, CASE WHEN change = 'added' THEN 'low' WHEN change <> 'body_changed' THEN 'high' WHEN coalesce(refs, 0) > 10 THEN 'medium' ELSE 'unknown' END AS risk FROM x LEFT JOIN k USING (lexical_path)""")
def _(f):
    counts = f.lineitem.groupBy(F.concat(F.lit("s"), F.col("l_partkey").cast("string")).alias("lexical_path")).agg(F.count("*").alias("refs"))
    return diff.enrich(diff.structural_diff(*snapshots(f)), counts, "lexical_path").select("path", "lexical_path", "change", "refs", "risk")


@query("o172_reconcile", """
    WITH a AS (SELECT source || '/' || CAST(CAST(floor(doc_id / 2) AS BIGINT) AS STRING) AS path, md5(text) AS h FROM documents WHERE doc_id % 2 = 0), b AS (SELECT 'src' || CAST((doc_id - 1) % 20 AS STRING) || '/' || CAST(CAST(floor(doc_id / 2) AS BIGINT) AS STRING) AS path, md5(text) AS h FROM documents WHERE doc_id % 2 = 1 AND doc_id % 6 <> 1)
    SELECT path, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' WHEN a.h = b.h THEN 'unchanged' ELSE 'modified' END AS change FROM a FULL OUTER JOIN b USING (path)""")
def _(f):
    k = F.col("doc_id")
    half = F.floor(k / 2).cast("string")
    h = F.md5("text").alias("content_hash")
    a = f.documents.where("doc_id % 2 = 0").select(F.concat("source", F.lit("/"), half).alias("path"), h)
    b = f.documents.where("doc_id % 2 = 1 AND doc_id % 6 <> 1").select(F.concat(F.lit("src"), ((k - 1) % 20).cast("string"), F.lit("/"), half).alias("path"), h)
    return diff.reconcile(a, b)


@query("o178_remerge", """
    WITH s AS (SELECT regexp_replace(path, '[0-9]+\\.', '.') AS path, max(content_hash) AS h FROM files WHERE worktree_id = 1 GROUP BY 1), t AS (SELECT regexp_replace(path, '[0-9]+\\.', '.') AS path, max(content_hash) AS h FROM files WHERE worktree_id = 2 GROUP BY 1)
    SELECT path, CASE WHEN s.h = t.h THEN 'keep' WHEN s.h IS NULL THEN 'prune' ELSE 'clone' END AS action FROM t FULL OUTER JOIN s USING (path)""")
def _(f):
    side = lambda w: f.files.where(f"worktree_id = {w}").groupBy(F.regexp_replace("path", r"[0-9]+\.", ".").alias("path")).agg(F.max("content_hash").alias("content_hash"))
    return diff.remerge(side(1), side(2))


@query("o177_drop_worktree", "SELECT id, worktree_id FROM files WHERE worktree_id <> 2")
def _(f):
    return f.files.where("worktree_id <> 2").select("id", "worktree_id")


@query("o198_internal_variables", """
    SELECT DISTINCT v.def_uid FROM defs v JOIN defs d ON d.file_id = v.file_id AND d.kind IN ('function', 'method') AND v.start_line BETWEEN d.start_line AND d.end_line WHERE v.kind = 'variable'""")
def _(f):
    return diff.internal_variables(f.defs)


@query("o170_candidate_features", f"WITH {CANDIDATES} SELECT def_uid, coalesce(splade, 0) AS splade_score, CAST(edge IS NOT NULL AS INTEGER) AS is_graph, CASE tier WHEN 'proven' THEN 3 WHEN 'strong' THEN 2 ELSE 0 END AS tier FROM c")
def _(f):
    tier = (ranking.priority(F.col("graph_caller_max_tier"), ranking.TIERS) % 99).alias("tier")
    return candidates(f).select("def_uid", F.coalesce("splade_score", F.lit(0.0)).alias("splade_score"), F.col("graph_edge_type").isNotNull().cast("int").alias("is_graph"), tier)


@query("o162_output", f"""
    WITH {SCORED}, k AS (SELECT query_id, def_uid, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, def_uid) AS rank FROM s)
    SELECT k.query_id, k.def_uid, k.rank, CASE WHEN rank <= 5 THEN 'snippet' ELSE 'signature' END AS form, d.signature_text FROM k JOIN defs d USING (def_uid) WHERE rank <= 10""")
def _(f):
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rrf_score").desc(), "def_uid")).cast("long")
    top = ranking.fuse_candidates(candidates(f)).withColumn("rank", r).where("rank <= 10").select("query_id", "def_uid", "rank", F.when(F.col("rank") <= 5, "snippet").otherwise("signature").alias("form"))
    return top.join(f.defs.select("def_uid", "signature_text"), "def_uid")
