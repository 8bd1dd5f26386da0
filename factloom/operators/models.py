"""Learned ranking: gate, file ranker, definition ranker and cutoff, trained with Spark's own trees, and what holds without them.

Without a model the gate says OK, every score is 0 and the cutoff is DEFAULT_N;
equal scores keep the order in which candidates came.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_N, MOST_FILES = 20, 20
#: What the gate may say; the first is the label without a model.
GATE_LABELS = ["OK", "UNSAT", "BROAD", "AMBIG"]
EXPLICIT = ["pin", "agent_seed"]


def number(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def candidate_features(candidates: DataFrame) -> tuple[DataFrame, list[str]]:
    """candidates with one numeric column for each signal, and the columns' names."""
    numeric = ["term_match_count", "bm25_file_score", "splade_score", "graph_seed_rank", "retriever_hits", "hub_score", "shares_file_with_seed", "from_coverage", "is_callee_of_top", "is_imported_by_top", "rrf_score"]
    named = {f"f_{c}": number(c) for c in numeric if c in candidates.columns}
    for c, values in (("symbol_source", ["agent_seed", "pin", "auto_seed"]), ("graph_edge_type", ["callee", "caller", "sibling"]), ("graph_caller_max_tier", ["proven", "strong"]), ("import_direction", ["reverse", "forward"])):
        if c in candidates.columns:
            named |= {f"f_{c}_{v}": F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)) for v in values}
    return candidates.withColumns(named), list(named)


def file_features(candidates: DataFrame, names: list[str], query: str = "query_id") -> tuple[DataFrame, list[str]]:
    """One row a query and file: the most, sum and mean of each signal of its candidates, their number, and the first's place."""
    made = [x for n in names for x in (F.max(n).alias(f"max_{n}"), F.sum(n).alias(f"sum_{n}"), F.avg(n).alias(f"mean_{n}"))]
    pinned = F.bool_or(F.coalesce(F.col("symbol_source").isin(EXPLICIT), F.lit(False))).alias("_pin")
    files = candidates.groupBy(query, "path").agg(F.count("*").cast("double").alias("defs"), *made, F.min("ord").alias("ord"), pinned)
    return files, ["defs", *(f"{k}_{n}" for n in names for k in ("max", "sum", "mean"))]


def query_features(candidates: DataFrame, names: list[str], query: str = "query_id") -> tuple[DataFrame, list[str]]:
    """One row a query: number of candidates and files, and the most and mean of each signal."""
    made = [x for n in names for x in (F.max(n).alias(f"max_{n}"), F.avg(n).alias(f"mean_{n}"))]
    rows = candidates.groupBy(query).agg(F.count("*").cast("double").alias("candidates"), F.countDistinct("path").cast("double").alias("files"), *made)
    return rows, ["candidates", "files", *(f"{k}_{n}" for n in names for k in ("max", "mean"))]


@dataclass
class Trained:
    """A fitted model and the columns it reads."""

    model: Any
    names: list[str]

    def predict(self, rows: DataFrame, into: str) -> DataFrame:
        return self.model.transform(vectors(rows, self.names)).withColumn(into, F.col("prediction")).drop("_features", "prediction", "rawPrediction", "probability")


def vectors(rows: DataFrame, names: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=names, outputCol="_features", handleInvalid="keep").transform(rows)


def train_regressor(rows: DataFrame, names: list[str], label: str, trees: int = 20, depth: int = 4) -> Trained:
    """Boosted trees for a graded relevance or a cutoff."""
    from pyspark.ml.regression import GBTRegressor

    learner = GBTRegressor(featuresCol="_features", labelCol=label, maxIter=trees, maxDepth=depth, seed=42)
    return Trained(learner.fit(vectors(rows, names).withColumn(label, F.col(label).cast("double"))), names)


def train_gate(rows: DataFrame, names: list[str], label: str) -> Trained:
    """A forest over the places of GATE_LABELS."""
    from pyspark.ml.classification import RandomForestClassifier

    place = F.array_position(F.array(*[F.lit(x) for x in GATE_LABELS]), F.col(label)) - 1
    learner = RandomForestClassifier(featuresCol="_features", labelCol="_label", numTrees=20, maxDepth=5, seed=42)
    return Trained(learner.fit(vectors(rows, names).withColumn("_label", place.cast("double"))), names)


def classify(rows: DataFrame, gate: Trained | None = None) -> DataFrame:
    """Adds gate, one of GATE_LABELS."""
    if gate is None:
        return rows.withColumn("gate", F.lit(GATE_LABELS[0]))
    labels = F.array(*[F.lit(x) for x in GATE_LABELS])
    return gate.predict(rows, "_place").withColumn("gate", F.coalesce(F.get(labels, F.col("_place").cast("int")), F.lit(GATE_LABELS[0]))).drop("_place")


def scored(rows: DataFrame, ranker: Trained | None = None) -> DataFrame:
    """Adds ranker_score."""
    return rows.withColumn("ranker_score", F.lit(0.0)) if ranker is None else ranker.predict(rows, "ranker_score")


def cut_off(rows: DataFrame, cutoff: Trained | None = None) -> DataFrame:
    """Adds n, 1 at least."""
    if cutoff is None:
        return rows.withColumn("n", F.lit(DEFAULT_N).cast("long"))
    return cutoff.predict(rows, "_n").withColumn("n", F.greatest(F.lit(1), F.round("_n")).cast("long")).drop("_n")


def model_pipeline(candidates: DataFrame, gate: Trained | None = None, file_ranker: Trained | None = None, ranker: Trained | None = None, cutoff: Trained | None = None, query: str = "query_id") -> DataFrame:
    """query, def_uid, rank: gate, the best files with those of pins and seeds, definitions by score, cut off; all queries in one plan.

    A query that the gate doesn't call OK has no result.
    """
    rows, names = candidate_features(candidates)
    of_query, _ = query_features(rows, names, query)
    passed = classify(of_query, gate).where(F.col("gate") == GATE_LABELS[0]).select(query)
    files, _ = file_features(rows, names, query)
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.col("ranker_score").desc(), "ord", "path"))
    kept = scored(files, file_ranker).withColumn("_p", place).where((F.col("_p") <= MOST_FILES) | F.col("_pin")).select(query, "path")
    left = rows.join(passed, query, "left_semi").join(kept, [query, "path"], "left_semi")
    order = Window.partitionBy(query).orderBy(F.col("ranker_score").desc(), "ord", "def_uid")
    ranked = scored(left, ranker).withColumn("rank", F.row_number().over(order).cast("long"))
    n = cut_off(query_features(left, names, query)[0], cutoff).select(query, "n")
    return ranked.join(n, query).where(F.col("rank") <= F.col("n")).select(query, "def_uid", "rank")
