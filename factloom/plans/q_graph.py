"""Queries of section 2.8: graphs and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, sparse
from .registry import query

EDGES = "SELECT DISTINCT f.path AS src, i.resolved_path AS dst FROM imports i JOIN files f ON f.id = i.file_id WHERE i.resolved_path IS NOT NULL AND f.path <> i.resolved_path"
def file_edges(f):
    return graph.cut(graph.file_edges(f.files, f.imports))


def rounded(ranks):
    return ranks.select("node", F.round("score", 9).alias("score"))


# ranks end at a tolerance: no SQL, tests/test_whole.py compares with power iteration
@query("o208_file_page_rank")
def _(f):
    return rounded(graph.page_rank(file_edges(f)))


DEF_EDGES = """SELECT DISTINCT d.def_uid AS src, r.target_def_uid AS dst FROM refs r JOIN defs d ON d.file_id = r.file_id AND r.start_line BETWEEN d.start_line AND d.end_line
    WHERE r.target_def_uid IS NOT NULL AND d.def_uid <> r.target_def_uid"""


@query("o207_def_page_rank")
def _(f):
    from ..operators import joins

    return rounded(graph.page_rank(graph.cut(joins.enclosing_refs(f.refs, f.defs))))


@query("o214_personalised_page_rank")
def _(f):
    seeds = f.files.where("id IN (1, 2, 3)").select(F.col("path").alias("node"))
    return rounded(graph.page_rank(file_edges(f), seeds=seeds))


def order_edges(f):
    """src, dst of every order, between customers."""
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    return f.orders.crossJoin(F.broadcast(f.fact_count)).select(k.alias("src"), ((k * 7 + o % 3) % F.col("nf")).alias("dst")).distinct()  # one row


# a closure over all pairs is too much for SQL: tests/test_whole.py compares with a search from each node
@query("o209_strongly_connected")
def _(f):
    return graph.strongly_connected(order_edges(f))


@query("o179_touched_cycles")
def _(f):
    changed = f.spark.createDataFrame([(1,), (50,), (100,), (200,)], "node long")
    return graph.touched_cycles(graph.strongly_connected(order_edges(f)), changed)


@query("o210_communities")
def _(f):
    return graph.communities(file_edges(f))


@query("o213_centrality_gate")
def _(f):
    changed = f.files.where("id < 200").select(F.col("path").alias("node"))  # the files of a change
    return graph.most_central(rounded(graph.page_rank(file_edges(f)))).join(changed, "node", "left_semi").select("node")


@query("o211_graph_summary", f"SELECT (SELECT count(*) FROM ({EDGES})) AS edges, (SELECT count(*) FROM (SELECT src FROM ({EDGES}) UNION SELECT dst FROM ({EDGES}))) AS nodes")
def _(f):
    e = file_edges(f)
    return e.agg(F.count("*").alias("edges")).crossJoin(graph.nodes_of(e).agg(F.count("*").alias("nodes")))  # one row each


# cycles, communities and ranks have no SQL: tests/test_whole.py looks at a small graph
@query("o211_graph_analysis")
def _(f):
    return graph.analyse(file_edges(f))


@query("o212_repo_briefing", f"""
    SELECT 'hub' AS section, def_uid AS item, CAST(n AS DOUBLE) AS value FROM (SELECT target_def_uid AS def_uid, count(DISTINCT file_id) AS n FROM refs WHERE target_def_uid IS NOT NULL GROUP BY 1 ORDER BY n DESC, def_uid LIMIT 5)
    UNION ALL SELECT 'language', language_family, CAST(count(*) AS DOUBLE) FROM files GROUP BY 2 UNION ALL SELECT 'lint', 'errors', CAST(sum(error_count) AS DOUBLE) FROM lint
    UNION ALL SELECT 'coverage', 'line_rate', round(avg(line_rate), 6) FROM coverage WHERE NOT stale UNION ALL
    SELECT 'file', path, CAST(n AS DOUBLE) FROM (SELECT dst AS path, count(*) AS n FROM ({EDGES}) GROUP BY 1 ORDER BY n DESC, path LIMIT 5)""")
def _(f):
    from ..operators import aggregates

    hubs = aggregates.caller_counts(f.defs, f.refs).orderBy(F.col("hub_score").desc(), "def_uid").limit(5).select(F.lit("hub").alias("section"), F.col("def_uid").alias("item"), F.col("hub_score").cast("double").alias("value"))
    langs = f.files.groupBy("language_family").count().select(F.lit("language").alias("section"), F.col("language_family").alias("item"), F.col("count").cast("double").alias("value"))
    lint = f.lint.agg(F.sum("error_count").cast("double").alias("value")).select(F.lit("lint").alias("section"), F.lit("errors").alias("item"), "value")
    rate = f.coverage.where("NOT stale").agg(F.round(F.avg("line_rate"), 6).alias("value")).select(F.lit("coverage").alias("section"), F.lit("line_rate").alias("item"), "value")
    read = file_edges(f).groupBy(F.col("dst").alias("item")).agg(F.count("*").cast("double").alias("value")).orderBy(F.col("value").desc(), "item").limit(5)
    files = read.select(F.lit("file").alias("section"), "item", "value")
    return hubs.unionByName(langs).unionByName(lint).unionByName(rate).unionByName(files)


TOK = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
SPARSE = f"""
    q0 AS (SELECT DISTINCT item_id, unnest({TOK}) AS term FROM benchmark), t AS (SELECT doc_id, unnest({TOK}) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q0) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    w AS (SELECT doc_id, term, (1 + ln(tf)) * ln(1 + (SELECT count(*) FROM documents) / df) AS weight FROM tf JOIN df USING (term))"""


def sparse_vectors(f):
    from ..operators.search import tokens

    asked = f.benchmark.select("item_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    return asked.withColumn("weight", F.lit(1.0)), sparse.tf_idf(f.documents, "doc_id", vocabulary=asked.select("term").distinct())


@query("o216_sparse_retrieval", f"""
    WITH {SPARSE}, s AS (SELECT item_id, doc_id, round(sum(weight), 6) AS score FROM q0 JOIN w USING (term) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score >= 1.0)
    SELECT * FROM k WHERE rank <= 50""")
def _(f):
    q, v = sparse_vectors(f)
    return sparse.retrieve(q, v, "item_id", "doc_id", 1.0, 50)


@query("o219_chunk_links", f"""
    WITH {SPARSE}, s AS (SELECT item_id, doc_id, round(sum(weight), 6) AS score FROM q0 JOIN w USING (term) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score >= 12.0)
    SELECT * FROM k WHERE rank <= 10""")
def _(f):
    q, v = sparse_vectors(f)
    return sparse.retrieve(q, v, "item_id", "doc_id", 12.0, 10)


WEIGHTS = SPARSE.replace(" WHERE term IN (SELECT term FROM q0)", "")  # of the whole vocabulary


@query("o217_sparse_encode", f"WITH {WEIGHTS} SELECT doc_id, count(*) AS terms, round(sum(weight), 4) AS mass FROM w GROUP BY 1")
def _(f):
    return sparse.tf_idf(f.documents, "doc_id").groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 4).alias("mass"))


@query("o194_sparse_dot", f"WITH {WEIGHTS} SELECT a.doc_id AS a, b.doc_id AS b, round(sum(a.weight * b.weight), 1) AS score FROM w a JOIN w b ON b.term = a.term AND b.doc_id = a.doc_id + 1 GROUP BY 1, 2")
def _(f):
    """Of each document's vector with the next one's."""
    v = sparse.tf_idf(f.documents, "doc_id")
    return sparse.pair_products(v, v, f.documents.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b")), "doc_id", 1)


@query("o224_centroid", f"""
    WITH {WEIGHTS}, k AS (SELECT count(*) AS k FROM documents WHERE lang = 'de'), m AS (SELECT term, sum(weight) / max(k) AS x FROM w JOIN documents USING (doc_id), k WHERE lang = 'de' GROUP BY 1), l AS (SELECT sqrt(sum(x * x)) AS l FROM m)
    SELECT term, round(x / l, 6) AS weight FROM m, l""")
def _(f):
    return sparse.centroid(sparse.tf_idf(f.documents, "doc_id"), f.documents.where("lang = 'de'"), "doc_id").select("term", F.round("weight", 6).alias("weight"))


@query("o224_dense_top_k", """
    WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 100 = 0), v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
         s AS (SELECT query_id, vec_id, round(list_cosine_similarity(q, v), 6) AS cosine FROM q, v WHERE query_id <> vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM s)
    SELECT * FROM k WHERE rank <= 10""")
def _(f):
    return sparse.dense_top_k(f.embeddings, f.embeddings.where("vec_id % 100 = 0"), "vec_id", "query_id", 10)


@query("o224_vector_sum", """
    WITH e AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS place FROM embeddings) SELECT label, CAST(place AS INTEGER) AS place, round(sum(CAST(v AS DOUBLE)), 5) AS total FROM e GROUP BY ALL""")
def _(f):
    return sparse.vector_sum(f.embeddings, "label")
