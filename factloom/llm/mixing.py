"""Mixing sources to target weights by capped water-filling, with DataFrame operations only.

Targets: every source gets its weight's share of a budget of words; a source
that would pass its cap (max_epochs times its size) is clamped there and the
excess is shared anew by weight among the rest, until none is above. As the
common level of the others only rises, the clamped sources of a round are those
whose weight times the last level passes their cap, so each round is one
aggregate over the table of sources and only the level reaches the driver.

Sampling: a source's target is a number of whole repetitions and a rest. The
rest takes documents in the order of a seeded hash until its words are reached.
The hash's top 12 bits make a histogram of words per source, which finds the
bucket in which the rest ends; only that bucket's documents (one of 4096 parts
of a source) are then put in order. No source is ever gathered in one task.
Rows of equal doc_id and text share a hash; where the rest ends among such
copies, they are numbered (by range and a count for each range, so that no
task gathers them) and as many are taken as fit.

Defined results: a null text has size 0; a null source is a source of its own,
ordered last; an empty table gives an empty result; a source without words has
target 0; of rows that differ in nothing, which one is taken means nothing.
Only the named columns are read, so others may be called anything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, rank_globally

SEED = 20260101
#: Source tables of up to so many rows, with names of up to 1 KB, are broadcast; larger ones are joined by shuffle.
BROADCAST_SOURCES = 20_000


def sized(docs: DataFrame, seed: int = SEED) -> list[Column]:
    """Columns: the document's size in words, and its place in the seeded order."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("_size")
    return [size, F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("_hash")]


def bucket() -> Column:
    return F.shiftrightunsigned(F.col("_hash"), 52).cast("int")


def source_sizes(docs: DataFrame) -> DataFrame:
    """(source, source_size) of a table with columns source and _size."""
    return docs.groupBy("source").agg(F.sum("_size").cast("long").alias("source_size"))


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """Adds weight: the sources by code point, null last, take the weights in turn."""
    ranked = rank_globally(sources, [F.col("source").asc_nulls_last()], "_rank", "mix-rank")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return ranked.withColumn("weight", F.get(cycle, (F.col("_rank") % len(weights)).cast("int"))).drop("_rank")


def water_fill(sources: DataFrame, budget: float, max_epochs: float = 2.0, size: str = "source_size") -> DataFrame:
    """Adds target to (source, source_size, weight): the capped shares of budget words.

    If the budget is more than all caps, every source is at its cap.
    """
    cap = F.col(size) * F.lit(float(max_epochs))
    level = 0.0
    while True:
        above = F.col("weight") * F.lit(level) > cap
        clamped, free = sources.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))
        ).first()
        if free <= 0:
            level = float("inf")
            break
        raised = max(level, (budget - clamped) / free)
        if raised == level:
            break
        level = raised
    share = cap if level == float("inf") else F.least(cap, F.col("weight") * F.lit(level))
    return sources.withColumn("target", share.cast("double"))


@dataclass
class Plan:
    """One row a source: source, source_size, weight, target, whole, cut_bucket, cut_hash, fit.

    Documents before the cut hash are taken once more, and fit of those at it.
    partly: whether anywhere some but not all of several rows at a cut hash fit.
    """

    table: DataFrame
    n: int
    longest: int
    partly: bool

    def attach(self, docs: DataFrame) -> DataFrame:
        """docs (with source, _size and _hash) with the plan's columns and repeats."""
        plan = self.table.withColumnRenamed("source", "_source")
        small = self.n <= BROADCAST_SOURCES and self.longest <= 1024
        joined = docs.join(F.broadcast(plan) if small else plan, docs["source"].eqNullSafe(plan["_source"])).drop("_source")
        early = (bucket() < F.col("cut_bucket")) | ((bucket() == F.col("cut_bucket")) & (F.col("_hash") < F.col("cut_hash")))
        early, at_cut = F.coalesce(early, F.lit(False)), F.coalesce(F.col("_hash") == F.col("cut_hash"), F.lit(False))
        if not self.partly:
            return joined.withColumn("repeats", F.col("whole") + (early | (at_cut & (F.col("fit") > 0))).cast("long"))
        others = joined.where(~at_cut).withColumn("repeats", F.col("whole") + early.cast("long"))
        at_cut = numbered(joined.where(at_cut), docs.columns)
        return others.unionByName(at_cut.withColumn("repeats", F.col("whole") + (F.col("_number") < F.col("fit")).cast("long")).drop("_number"))


def numbered(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds _number, from 0 within each source, in the order of a hash of the columns."""
    # the last key only parts rows that are equal in all columns, so that they needn't meet
    keys = [F.col("source").asc_nulls_last(), F.xxhash64(*columns), F.col("_salt")]
    ranked = rank_globally(rows.withColumn("_salt", F.monotonically_increasing_id()), keys, "_rank", "mix-copies").drop("_salt")
    begin = ranked.groupBy(F.col("source").alias("_source")).agg(F.min("_rank").alias("_first"))
    met = ranked.join(begin, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return met.withColumn("_number", F.col("_rank") - F.col("_first")).drop("_rank", "_first")


def plan(narrow: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, max_epochs: float = 2.0) -> Plan:
    """The mix of a written table (source, _size, _hash), for share times all its words."""
    histogram = materialise(
        narrow.groupBy("source", bucket().alias("_bucket")).agg(F.sum("_size").cast("long").alias("_words")), "mix-histogram"
    )
    sources = histogram.groupBy("source").agg(F.sum("_words").cast("long").alias("source_size"))
    sources = materialise(cyclic_weights(sources, weights), "mix-sources")
    n, total, longest = sources.agg(
        F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.max(F.octet_length("source")), F.lit(0))
    ).first()
    filled = water_fill(sources, share * total, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    filled = filled.withColumn("whole", epochs).withColumn("_rest", F.col("target") - F.col("whole") * F.col("source_size"))
    filled = materialise(filled, "mix-targets")

    in_order = Window.partitionBy("_s", "_null").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    key = [F.coalesce(F.col("source"), F.lit("")).alias("_s"), F.col("source").isNull().alias("_null")]
    rest = filled.select(*key, "_rest")
    reached = (
        histogram.select(*key, "_bucket", "_words")
        .withColumn("_upto", F.sum("_words").over(in_order))
        .join(rest, ["_s", "_null"])
        .where(F.col("_upto") > F.col("_rest"))
        .groupBy("_s", "_null")
        .agg(F.min(F.struct("_bucket", (F.col("_upto") - F.col("_words")).alias("_before"), "_rest")).alias("_cut"))
        .select("_s", "_null", F.col("_cut._bucket").alias("_bucket"), F.col("_cut._before").alias("_before"), F.col("_cut._rest").alias("_rest"))
    )
    cuts = materialise(reached, "mix-cuts")
    small = F.broadcast(cuts) if n <= BROADCAST_SOURCES and longest <= 1024 else cuts
    by_hash = Window.partitionBy("_s", "_null").orderBy("_hash").rowsBetween(Window.unboundedPreceding, 0)
    ends = (
        narrow.select(*key, "_size", "_hash", bucket().alias("_bucket"))
        .join(small, ["_s", "_null", "_bucket"])
        .groupBy("_s", "_null", "_hash", "_before", "_rest")
        .agg(F.sum("_size").alias("_words"), F.count("*").alias("_n"))
        .withColumn("_upto", F.col("_before") + F.sum("_words").over(by_hash))
        .where(F.col("_upto") > F.col("_rest"))
        .groupBy("_s", "_null")
        .agg(F.min(F.struct("_hash", (F.col("_rest") - (F.col("_upto") - F.col("_words"))).alias("left"), (F.col("_words") / F.col("_n")).alias("each"), "_n")).alias("_cut"))
        .select("_s", "_null", F.col("_cut._hash").alias("cut_hash"), F.round(F.col("_cut.left") / F.col("_cut.each")).cast("long").alias("fit"), F.col("_cut._n").alias("at_cut"))
    )
    table = (
        filled.select("source", *key, "source_size", "weight", "target", "whole")
        .join(cuts.select("_s", "_null", F.col("_bucket").alias("cut_bucket")), ["_s", "_null"], "left")
        .join(ends, ["_s", "_null"], "left")
        .drop("_s", "_null")
    )
    table = materialise(table, "mix-plan")
    partly = bool(table.where("fit > 0 AND fit < at_cut").take(1))
    return Plan(table.drop("at_cut"), n, longest, partly)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, max_epochs: float = 2.0, seed: int = SEED) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, weight, target, repeats, taken."""
    narrow = materialise(docs.select("doc_id", "source", *sized(docs, seed)), "mix-sizes")
    mixed = plan(narrow, weights, share, max_epochs).attach(narrow)
    return mixed.select(
        "doc_id", "source", F.col("_size").alias("size"), "source_size", "weight", "target", "repeats",
        (F.col("_size") * F.col("repeats")).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, max_epochs: float = 2.0, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of docs as often as the mix repeats it, with the columns of docs."""
    narrow = materialise(docs.select("source", *sized(docs, seed)), "mix-sizes")
    rows = docs.select(F.struct("*").alias("_row"), "source", *sized(docs, seed))
    mixed = plan(narrow, weights, share, max_epochs).attach(rows)
    copies = F.explode(F.array_repeat(F.lit(0), F.col("repeats").cast("int"))).alias("_copy")
    return mixed.where(F.col("repeats") > 0).select("_row", copies).select("_row.*")
