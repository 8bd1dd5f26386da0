"""Rank fusion, pruning, cutoffs, sampling, and ranking evaluation. Everything is by query, so many queries go through one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 60
# Priorities of evidence, best first.
SOURCES = ["agent_seed", "pin", "path_mention", "task_extracted", "auto_seed"]
DIRECTIONS = ["test_pair", "reverse", "forward", "barrel"]
TIERS = ["unknown", "anchored", "strong", "proven"]
LISTS = ["term_match", "explicit", "graph", "import", "splade", "shares_file", "coverage", "retriever_agreement", "hub_score", "callee_of_seed", "imported_by_seed"]


def priority(c: Column, values: list[str]) -> Column:
    """Place in values; 99 for others."""
    out = F.lit(99)
    for i, v in reversed(list(enumerate(values))):
        out = F.when(c == v, i).otherwise(out)
    return out


def rank_lists() -> dict[str, tuple[Column, list[Column]]]:
    """Of each named list: who is in it, and its order; ties go by ord, the candidate order."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    seed = F.when(n("graph_seed_rank") == 0, 999).otherwise(F.col("graph_seed_rank"))
    return {
        "term_match": (n("term_match_count") > 0, [n("bm25_file_score").desc(), n("term_match_count").desc()]),
        "explicit": (F.col("symbol_source").isNotNull(), [priority(F.col("symbol_source"), SOURCES)]),
        "graph": (F.col("graph_edge_type").isNotNull(), [(priority(F.col("graph_caller_max_tier"), TIERS) % 99).desc(), seed]),
        "import": (F.col("import_direction").isNotNull(), [priority(F.col("import_direction"), DIRECTIONS)]),
        "splade": (n("splade_score") > 0, [n("splade_score").desc()]),
        "shares_file": (F.col("shares_file_with_seed"), []),
        "coverage": (F.col("from_coverage"), []),
        "retriever_agreement": (n("retriever_hits") >= 2, [n("retriever_hits").desc()]),
        "hub_score": (n("hub_score") > 0, [n("hub_score").desc()]),
        "callee_of_seed": (F.col("is_callee_of_top"), []),
        "imported_by_seed": (F.col("is_imported_by_top"), []),
    }


def ranked_lists(candidates: DataFrame, query: str = "query_id", key: str = "def_uid") -> DataFrame:
    """query, key, list, rank: each list's members in its order."""
    parts = None
    for name, (member, order) in rank_lists().items():
        rank = F.row_number().over(Window.partitionBy(query).orderBy(*order, "ord", key))
        part = candidates.where(F.coalesce(member, F.lit(False))).select(query, key, F.lit(name).alias("list"), rank.cast("long").alias("rank"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def fuse(lists: DataFrame, query: str = "query_id", key: str = "def_uid", k: int = K) -> DataFrame:
    """query, key, rrf_score: the sum of 1 / (k + rank) over the lists."""
    return lists.groupBy(query, key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("rrf_score"))


def fuse_candidates(candidates: DataFrame, query: str = "query_id", key: str = "def_uid") -> DataFrame:
    """candidates with rrf_score; those in no list score 0."""
    return candidates.join(fuse(ranked_lists(candidates, query, key), query, key), [query, key], "left").withColumn("rrf_score", F.coalesce("rrf_score", F.lit(0.0)))


def prune_files(scored: DataFrame, query: str = "query_id", most: int = 20, pinned: DataFrame | None = None) -> DataFrame:
    """Candidates of the best files of a query, and of files with a pin or seed."""
    best = scored.groupBy(query, "path").agg(F.max("rrf_score").alias("_best"), F.bool_or(F.coalesce(F.col("symbol_source").isin("pin", "agent_seed"), F.lit(False))).alias("_pin"))
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.col("_best").desc(), "path"))
    kept = best.withColumn("_p", place).where((F.col("_p") <= most) | F.col("_pin")).select(query, "path")
    if pinned is not None:
        kept = kept.unionByName(pinned.select(query, "path")).distinct()
    return scored.join(kept, [query, "path"], "left_semi")


def elbow(scored: DataFrame, group: str, score: str, tie: str, least: int = 3, most: int = 30) -> DataFrame:
    """group, n: where the largest gap of the descending scores is, within [least, most]; all of 3 or fewer; the upper bound if flat."""
    order = Window.partitionBy(group).orderBy(F.col(score).desc(), tie)
    ranked = scored.withColumn("_r", F.row_number().over(order)).withColumn("_gap", F.col(score) - F.lead(score).over(order))
    size = F.count("*")
    upper = F.least(F.lit(most), size)
    g = ranked.groupBy(group).agg(size.alias("_n"), upper.alias("_u"), F.max("_gap").alias("_g"), F.min_by("_r", F.struct(-F.coalesce("_gap", F.lit(float("-inf"))), F.col("_r"))).alias("_at"))
    n = F.when(F.col("_n") <= 3, F.col("_n")).when(F.coalesce("_g", F.lit(0.0)) <= 0, F.col("_u")).otherwise(F.greatest(F.lit(least), F.least(F.col("_at"), F.col("_u"))))
    return g.select(group, n.cast("long").alias("n"))


def best_n(ranked: DataFrame, group: str, rank: str = "rank", label: str = "label", most: int = 100) -> DataFrame:
    """group, n_star, f1: the first n with the best F1 against the labels."""
    upto = Window.partitionBy(group).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    rows = ranked.withColumn("_hits", F.sum(F.col(label)).over(upto)).withColumn("_all", F.sum(F.col(label)).over(Window.partitionBy(group)))
    f1 = F.when(F.col("_all") > 0, 2 * F.col("_hits") / (F.col(rank) + F.col("_all"))).otherwise(0.0)
    return rows.where(F.col(rank) <= most).withColumn("_f", F.round(f1, 9)).groupBy(group).agg(
        F.min_by(rank, F.struct(-F.col("_f"), F.col(rank))).alias("n_star"), F.round(F.max("_f"), 6).alias("f1")
    )


def subsample_negatives(rows: DataFrame, group: str, label: str, key: str, most: int, seed: str = "s", drop_all_negative: bool = True) -> DataFrame:
    """All positives, and up to most negatives of each group by a seeded digest of the key."""
    place = F.row_number().over(Window.partitionBy(group, F.col(label) > 0).orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), key))
    out = rows.withColumn("_p", place).where((F.col(label) > 0) | (F.col("_p") <= most)).drop("_p")
    if drop_all_negative:
        out = out.join(rows.where(F.col(label) > 0).select(group).distinct(), group, "left_semi")
    return out


def ndcg(ranked: DataFrame, group: str, k: int, gain: str = "gain", rank: str = "rank") -> DataFrame:
    """group, ndcg at k: gains over log2(rank + 1), against the gains in descending order; 0 without gain."""
    ideal = F.row_number().over(Window.partitionBy(group).orderBy(F.col(gain).desc(), rank))
    rows = ranked.withColumn("_i", ideal)
    dcg = lambda r: F.sum(F.when(F.col(r) <= k, F.col(gain) / F.log2(F.col(r) + 1.0)).otherwise(0.0))
    g = rows.groupBy(group).agg(dcg(rank).alias("_d"), dcg("_i").alias("_b"))
    return g.select(group, F.round(F.when(F.col("_b") > 0, F.col("_d") / F.col("_b")).otherwise(0.0), 6).alias("ndcg"))


def precision_recall(ranked: DataFrame, group: str, cutoffs: tuple[int, ...] = (5, 10, 20), label: str = "label", rank: str = "rank") -> DataFrame:
    """group, k, precision, recall, f1, hit at each cutoff."""
    at = ranked.withColumn("k", F.explode(F.array(*[F.lit(k) for k in cutoffs])))
    inside = F.sum(F.when((F.col(rank) <= F.col("k")) & (F.col(label) > 0), 1).otherwise(0))
    g = at.groupBy(group, "k").agg(inside.alias("h"), F.sum((F.col(label) > 0).cast("long")).alias("t"), F.least(F.first("k"), F.count("*")).alias("n"))
    p, r = F.when(F.col("n") > 0, F.col("h") / F.col("n")).otherwise(0.0), F.when(F.col("t") > 0, F.col("h") / F.col("t")).otherwise(0.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return g.select(group, "k", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"), (F.col("h") > 0).alias("hit"))


def mean_reciprocal_rank(ranked: DataFrame, group: str, label: str = "label", rank: str = "rank") -> DataFrame:
    first = ranked.groupBy(group).agg(F.min(F.when(F.col(label) > 0, F.col(rank))).alias("_r"))
    return first.agg(F.round(F.avg(F.coalesce(1.0 / F.col("_r"), F.lit(0.0))), 6).alias("mrr"), F.count("*").alias("queries"))


def ablation(lists: DataFrame, labels: DataFrame, query: str = "query_id", key: str = "def_uid", k: int = 20) -> DataFrame:
    """left_out, recall at k of the fusion without each list ('none': with all).

    The names of the lists are a fixed, short table.
    """
    names = lists.select(F.col("list").alias("left_out")).distinct().unionByName(lists.sparkSession.createDataFrame([("none",)], "left_out string"))
    kept = lists.crossJoin(F.broadcast(names)).where(F.col("list") != F.col("left_out"))
    scored = kept.groupBy("left_out", query, key).agg(F.round(F.sum(1.0 / (K + F.col("rank"))), 9).alias("s"))
    place = F.row_number().over(Window.partitionBy("left_out", query).orderBy(F.col("s").desc(), key))
    top = scored.withColumn("_p", place).where(F.col("_p") <= k)
    hits = top.join(labels.select(query, key), [query, key], "left_semi").groupBy("left_out").agg(F.count("*").alias("h"))
    total = labels.agg(F.count("*").alias("t"))
    return names.join(hits, "left_out", "left").crossJoin(F.broadcast(total)).select("left_out", F.round(F.coalesce("h", F.lit(0)) / F.col("t"), 6).alias("recall"))


def merge_candidates(parts: list[DataFrame], key: str = "def_uid") -> DataFrame:
    """One row a key: flags by OR, scores by max, terms as a set, the source of the best priority, the best tier."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    return rows.groupBy(key).agg(
        F.bool_or(F.coalesce("from_term", F.lit(False))).alias("from_term"), F.bool_or(F.coalesce("from_explicit", F.lit(False))).alias("from_explicit"),
        F.max("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("terms", F.array().cast("array<string>")))))).alias("terms"),
        F.min_by("source", F.struct(priority(F.col("source"), SOURCES), F.col("source"))).alias("source"), F.max(priority(F.col("tier"), TIERS) % 99).alias("tier"),
    )


def evidence_axes() -> Column:
    """Kinds of evidence: term, explicit, graph, coverage."""
    return sum((F.coalesce(F.col(c), F.lit(False)).cast("int") for c in ("from_term", "from_explicit", "from_graph", "from_coverage")), F.lit(0))


def health_direction(snapshots: DataFrame, order: str = "epoch", band: float = 0.01) -> DataFrame:
    """Adds direction against the snapshot before."""
    w = Window.partitionBy(F.lit(0)).orderBy(order)  # one row an epoch
    d = F.col("rate") - F.lag("rate").over(w)
    return snapshots.withColumn("direction", F.when(d.isNull(), "unknown").when(d > band, "improving").when(d < -band, "degrading").otherwise("stable"))
