"""Queries of learned ranking and of the whole retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import models, ranking, search, sparse
from . import q_graph, q_ranking, q_search
from .registry import query


@query("o158_rankers_without_models", f"""
    WITH {q_ranking.CANDIDATES}, b AS (SELECT query_id, path, min(ord) AS o, bool_or(coalesce(symbol_source IN ('pin', 'agent_seed'), false)) AS pin FROM c GROUP BY 1, 2),
         k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o, path) AS p FROM b), x AS (SELECT c.query_id, def_uid, ord FROM c JOIN k USING (query_id, path) WHERE p <= 20 OR pin),
         r AS (SELECT query_id, def_uid, row_number() OVER (PARTITION BY query_id ORDER BY ord, def_uid) AS rank FROM x)
    SELECT query_id, def_uid, rank FROM r WHERE rank <= 20""")
def _(f):
    return models.model_pipeline(q_ranking.candidates(f))


def relevance():
    """A grade of each candidate that its signals tell, but for a remainder."""
    return F.when(F.col("hub_score") > 30, 2).when((F.col("term_match_count") > 2) & (F.col("retriever_hits") > 1), 1).otherwise(0)


def fitted(f):
    """The four models, from the candidates' grades; a query's gate and cutoff from its number of relevant ones."""
    rows, names = models.candidate_features(ranking.fuse_candidates(q_ranking.candidates(f)))
    graded = rows.withColumn("relevance", relevance())
    files, file_names = models.file_features(graded, names)
    of_file = graded.groupBy("query_id", "path").agg(F.max("relevance").alias("relevance"))
    queries, query_names = models.query_features(graded, names)
    good = graded.groupBy("query_id").agg(F.sum((F.col("relevance") > 0).cast("long")).alias("n_star"))
    queries = queries.join(good, "query_id").withColumn("gate_label", F.when(F.col("n_star") == 0, "UNSAT").otherwise("OK"))
    return graded, {
        "gate": models.train_gate(queries, query_names, "gate_label"), "file_ranker": models.train_regressor(files.join(of_file, ["query_id", "path"]), file_names, "relevance"),
        "ranker": models.train_regressor(graded, names, "relevance"), "cutoff": models.train_regressor(queries, query_names, "n_star"),
    }


# trees have no SQL: tests/test_models.py holds their order against the grades
@query("o159_trained_ranker")
def _(f):
    graded, made = fitted(f)
    scored = models.scored(graded, made["ranker"])
    order = Window.partitionBy("query_id").orderBy(F.col("ranker_score").desc(), "ord")
    ranked = scored.select("query_id", "def_uid", F.row_number().over(order).cast("long").alias("rank"), F.col("relevance").alias("gain"))
    return ranking.ndcg(ranked, "query_id", 20)


@query("o161_model_pipeline")
def _(f):
    return models.model_pipeline(ranking.fuse_candidates(q_ranking.candidates(f)), **fitted(f)[1])


@query("o223_retrieval_pipeline", f"""
    WITH a AS ({q_search.BM25}), b AS (WITH {q_graph.SPARSE}, s AS (SELECT item_id, doc_id, round(sum(weight), 6) AS score FROM q0 JOIN w USING (term) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score >= 1.0) SELECT * FROM k WHERE rank <= 50),
         l AS (SELECT item_id, doc_id, rank FROM a UNION ALL SELECT item_id, doc_id, rank FROM b), u AS (SELECT item_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS rrf FROM l GROUP BY 1, 2),
         s AS (SELECT item_id AS query_id, doc_id AS def_uid, rrf AS rrf_score FROM u), {q_ranking.ELBOW.replace('    n AS', '    n2 AS')}
    SELECT g.query_id AS item_id, g.def_uid AS doc_id, g.r AS rank FROM g JOIN n2 ON n2.query_id = g.query_id WHERE g.r <= n2.n""")
def _(f):
    """Every task at once: lexical and sparse retrieval, fusion, the elbow's cut."""
    lexical = search.top_k(search.bm25(f.documents, f.benchmark, "doc_id", "item_id").withColumn("score", F.round("score", 6)), "item_id", "score", "doc_id", 20)
    asked, weights = q_graph.sparse_vectors(f)
    near = sparse.retrieve(asked, weights, "item_id", "doc_id", 1.0, 50)
    lists = lexical.select("item_id", "doc_id", F.lit("term_match").alias("list"), "rank").unionByName(near.select("item_id", "doc_id", F.lit("splade").alias("list"), "rank"))
    fused = ranking.fuse(lists, "item_id", "doc_id")
    n = ranking.elbow(fused, "item_id", "rrf_score", "doc_id")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("rrf_score").desc(), "doc_id"))
    return fused.withColumn("rank", place.cast("long")).join(n, "item_id").where("rank <= n").select("item_id", "doc_id", "rank")
