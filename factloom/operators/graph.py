"""Graphs: edges, PageRank, strongly connected components, communities, bounded traversal."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir; without it, a local master's own or the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        local = re.match(r"local(\[|$)", spark.sparkContext.master)
        root = tempfile.mkdtemp(prefix="factloom-graph-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written into the shared folder and read again: a round's table, which survives lost executors."""
    spark = df.sparkSession
    uri = f"{shared_folder(spark)}/factloom-rounds/{uuid.uuid4().hex}"
    df.write.parquet(uri)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)  # with the driver's JVM
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def file_edges(files: DataFrame, imports: DataFrame) -> DataFrame:
    """src, dst: importing file and resolved file; no loops; unknown targets stay."""
    at = files.select(F.col("id").alias("file_id"), F.col("path").alias("src"))
    found = imports.where("resolved_path IS NOT NULL").join(at, "file_id").select("src", F.col("resolved_path").alias("dst"))
    return found.where("src <> dst").distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def page_rank(edges: DataFrame, rounds: int = 100, alpha: float = 0.85, tolerance: float | None = 1e-6, seeds: DataFrame | None = None, every: int = 1) -> DataFrame:
    """node, score. Rank flows along edges; ranks of nodes without edges out, and the restart, go to all nodes (or the seeds) alike.

    Each round is one join and one aggregate. A round reads the last table twice,
    so it is written every round (or every few): else the plan doubles each time.
    It ends when the ranks' changes sum to less than n * tolerance; without a tolerance, after all rounds.
    """
    nodes = cut(nodes_of(edges).join(edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out")), "node", "left"))
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("score"))
    if seeds is None:
        start = nodes.withColumn("restart", F.lit(1.0 / n))
    else:
        chosen = nodes.join(seeds.select("node").distinct(), "node", "left_semi").select("node")
        share = 1.0 / max(1, chosen.count())
        start = nodes.join(chosen.withColumn("restart", F.lit(share)), "node", "left").withColumn("restart", F.coalesce("restart", F.lit(0.0)))
    base = cut(start)
    now = base.select("node", "out", "restart", F.col("restart").alias("score"))
    for i in range(rounds):
        loose = now.where("out IS NULL").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("_loose"))
        sent = now.where("out IS NOT NULL").select(F.col("node").alias("src"), (F.col("score") / F.col("out")).alias("_s"))
        got = edges.join(sent, "src").groupBy(F.col("dst").alias("node")).agg(F.sum("_s").alias("_in"))
        score = F.lit(1 - alpha) * F.col("restart") + alpha * (F.coalesce("_in", F.lit(0.0)) + F.col("_loose") * F.col("restart"))
        new = base.join(got, "node", "left").crossJoin(F.broadcast(loose)).select("node", "out", "restart", score.alias("score"))  # one row
        if i % every == every - 1 or i == rounds - 1:
            new = cut(new)
            if tolerance is not None:
                old = now.select("node", F.col("score").alias("_old"))
                if new.join(old, "node").agg(F.sum(F.abs(F.col("score") - F.col("_old")))).first()[0] < n * tolerance:
                    now = new
                    break
        now = new
    return now.select("node", "score")


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have an edge in and one out, until none falls away; the others are components of one."""
    n = edges.count()
    while n:
        has_in, has_out = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = cut(edges.join(has_in, "src", "left_semi").join(has_out, "dst", "left_semi").select("src", "dst"))
        left = edges.count()
        if left == n:
            break
        n = left
    return edges


def strongly_connected(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of components of two or more.

    Trim, colour forward with the smallest node that reaches each, then go back
    from each colour's root within the colour: what it meets is a component.
    Repeat on the rest.
    """
    found: DataFrame | None = None
    edges = trimmed(cut(edges.where("src <> dst").select("src", "dst").distinct()))
    while edges.take(1):
        colour = cut(nodes_of(edges).withColumn("colour", F.col("node")))
        while True:
            low = edges.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("_c"))
            new = cut(colour.join(low, "node", "left").select("node", F.least("colour", F.coalesce("_c", "colour")).alias("colour"), (F.col("_c") < F.col("colour")).alias("_moved")))
            moved = new.where("_moved").take(1)
            colour = new.select("node", "colour")
            if not moved:
                break
        same = colour.withColumnRenamed("node", "src").join(edges, "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("_d")), "dst").where("colour = _d")
        inner = cut(same.select("src", "dst"))
        back = colour.where("node = colour").select("node", F.col("node").alias("component"))
        front = back
        while True:
            front = cut(inner.join(front.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "component").distinct().join(back, ["node", "component"], "left_anti"))
            if not front.take(1):
                break
            back = cut(back.unionByName(front))
        sizes = back.groupBy("component").agg(F.count("*").alias("_n")).where("_n > 1")
        part = cut(back.join(sizes, "component", "left_semi").select("node", "component"))
        found = part if found is None else found.unionByName(part)
        done = back.select("node")
        edges = cut(edges.join(done.withColumnRenamed("node", "src"), "src", "left_anti").join(done.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
        edges = trimmed(edges)
    return found if found is not None else nodes_of(edges).select("node", F.col("node").alias("component")).limit(0)


def communities(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """node, community by weighted label propagation over the undirected graph, ties to the smaller label; until none moves, or up to rounds.

    Stands in for modularity optimisation, whose result depends on the order of visits.
    """
    both = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("w")))
    labels = cut(nodes_of(both).withColumn("community", F.col("node")))
    done = 0
    while done != rounds:
        votes = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node"), "community").agg(F.sum("w").alias("_w"))
        best = votes.groupBy("node").agg(F.min_by("community", F.struct(-F.col("_w"), F.col("community"))).alias("_new"))
        joined = labels.join(best, "node", "left")
        # a smaller label is taken, a larger one isn't: this ends
        new = cut(joined.select("node", F.least("community", F.coalesce("_new", "community")).alias("community"), (F.col("_new") < F.col("community")).alias("_moved")))
        moved = new.where("_moved").take(1)
        labels, done = new.select("node", "community"), done + 1
        if not moved:
            break
    return labels


def most_central(ranks: DataFrame, share: float = 0.1) -> DataFrame:
    """The top share of nodes by score, one at least."""
    n = ranks.count()
    return ranks.orderBy(F.col("score").desc(), "node").limit(max(1, int(n * share)))


def analyse(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, cycles, in_cycles (their nodes), largest_cycle, communities, central (the node of the highest rank)."""
    edges = cut(edges.select("src", "dst").distinct())
    cycles = strongly_connected(edges).groupBy("component").agg(F.count("*").alias("n"))
    parts = [
        nodes_of(edges).agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges")),
        cycles.agg(F.count("*").alias("cycles"), F.coalesce(F.sum("n"), F.lit(0)).alias("in_cycles"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_cycle")),
        communities(edges).agg(F.countDistinct("community").alias("communities")),
        page_rank(edges).agg(F.min_by("node", F.struct(-F.round("score", 12), F.col("node"))).alias("central")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)  # one row each
    return out


def touched_cycles(components: DataFrame, changed: DataFrame) -> DataFrame:
    """Components with a changed node."""
    return components.join(changed.select("node").distinct(), "node", "left_semi").select("component").distinct()
