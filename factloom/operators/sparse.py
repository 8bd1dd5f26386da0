"""Sparse and dense vectors: weights, dot products by an inverted index, top-k, centroids, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import exploded, tokens


def tf_idf(docs: DataFrame, key: str, text: str = "text", vocabulary: DataFrame | None = None) -> DataFrame:
    """key, term, weight = (1 + ln tf) * ln(1 + n / df): stands in for a learned sparse encoder, whose weights are not at hand."""
    terms = exploded(docs, [key], tokens(F.col(text)), "term")
    if vocabulary is not None:
        terms = terms.join(vocabulary, "term", "left_semi")
    tf = terms.groupBy(key, "term").agg(F.count("*").alias("tf"))
    # needs tf, so that both readers of tf have one plan and share its exchange
    df = tf.groupBy("term").agg(F.sum(F.when(F.col("tf") > 0, 1)).alias("df"))
    n = docs.agg(F.count("*").alias("_n"))
    return tf.join(df, "term").crossJoin(F.broadcast(n)).select(key, "term", ((1 + F.log("tf")) * F.log(1 + F.col("_n") / F.col("df"))).alias("weight"))  # one row


def dot_products(a: DataFrame, b: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """a_key, b_key, score of every pair that shares a term, from two tables (key, term, weight)."""
    met = a.select(a_key, "term", F.col("weight").alias("_a")).join(b.select(b_key, "term", F.col("weight").alias("_b")), "term")
    return met.groupBy(a_key, b_key).agg(F.round(F.sum(F.col("_a") * F.col("_b")), 6).alias("score"))


def pair_products(a: DataFrame, b: DataFrame, pairs: DataFrame, key: str, digits: int = 6) -> DataFrame:
    """a, b, score of the stated pairs (a, b), each once, of rows of two tables (key, term, weight) that share a term; rounded once."""
    left = a.select(F.col(key).alias("a"), "term", F.col("weight").alias("_a")).join(pairs.select("a", "b").distinct(), "a")
    met = left.join(b.select(F.col(key).alias("b"), "term", F.col("weight").alias("_b")), ["b", "term"])
    return met.groupBy("a", "b").agg(F.round(F.sum(F.col("_a") * F.col("_b")), digits).alias("score"))


def retrieve(queries: DataFrame, vectors: DataFrame, query: str, key: str, floor: float, most: int) -> DataFrame:
    """Pairs with a score of floor or more, the best of each query."""
    scored = dot_products(queries, vectors, query, key).where(F.col("score") >= floor)
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.col("score").desc(), key))
    return scored.withColumn("rank", place.cast("long")).where(F.col("rank") <= most)


def centroid(vectors: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """term, weight: the mean of the members' vectors, of length 1."""
    n = members.select(key).distinct().agg(F.count("*").alias("_n"))
    mean = vectors.join(members.select(key).distinct(), key, "left_semi").groupBy("term").agg(F.sum("weight").alias("_s")).crossJoin(F.broadcast(n)).select("term", (F.col("_s") / F.col("_n")).alias("weight"))
    norm = mean.agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_l"))
    return mean.crossJoin(F.broadcast(norm)).select("term", (F.col("weight") / F.col("_l")).alias("weight"))  # one row


def dense_dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def dense_top_k(vectors: DataFrame, queries: DataFrame, key: str, query: str, k: int, column: str = "embedding") -> DataFrame:
    """query, key, cosine, rank of the best of all vectors for a stated, small set of queries, which every task gets."""
    unit = lambda c: F.sqrt(dense_dot(F.col(c), F.col(c)))
    q = queries.select(F.col(key).alias(query), F.col(column).alias("_q")).withColumn("_ql", unit("_q"))
    rows = vectors.select(key, F.col(column).alias("_v")).withColumn("_vl", unit("_v"))
    met = rows.join(F.broadcast(q), F.col(key) != F.col(query))
    scored = met.select(query, key, F.round(dense_dot(F.col("_v"), F.col("_q")) / (F.col("_vl") * F.col("_ql")), 6).alias("cosine"))
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.col("cosine").desc(), key))
    return scored.withColumn("rank", place.cast("long")).where(F.col("rank") <= k)


def vector_sum(vectors: DataFrame, group: str, column: str = "embedding") -> DataFrame:
    """Elementwise sum of the vectors of each group, by place, so that any number adds up."""
    places = vectors.select(group, F.posexplode(column).alias("place", "_v"))
    return places.groupBy(group, "place").agg(F.round(F.sum(F.col("_v").cast("double")), 5).alias("total"))
