"""Toxicity by weak supervision.

1. A bounded sample of labelled texts (SAMPLE rows, those with the smallest
   seeded hash of doc_id; held-out rows never) counts how often each word and
   each word beginning stands in texts of either label. The ones that separate
   best are the voters: lexicon voters (a word) and pattern voters (a beginning
   of four to six letters), which vote toxic or abstain, and two density voters,
   which vote toxic for several different hits, clean for none, or abstain.
2. A generative label model explains the votes alone. Given the hidden label,
   votes follow a tree of dependencies (the greatest conditional mutual
   information); its parameters are the label's share, each voter's chances of
   voting and of being right, and the correlation of each pair in the tree. EM
   fits all of them and the tree. A voter is taken to be better than chance. The
   annotations choose the voters and give EM its start; they cast no vote and
   enter no later round, so noisy ones are overruled. Of features that imply one
   another (a word and its beginning) one is a voter, and voters that often vote
   together sit in one committee, which votes if any of them does: a tree can't
   hold a whole lexicon's correlations, and the largest lexicon would become the
   label.
3. A linear classifier is trained on the label model's posterior labels, over
   lexicon and pattern features, and scores every text in full.

Only texts enter a score. The hit sets are found by word beginnings, so scoring
is one pass and one small model in each task.

Defined results: null and empty texts have no hits and get the classifier's
constant; a null doc_id counts as the empty text for the split; equal texts
have equal scores; labels of no document and null labels are not used; without
labels of both kinds nothing is known and every text has the score 0; extra
columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, texts

HELD_OUT, MODULUS = 0, 5
#: Labelled texts used; features of the classifier; voters; least texts of label 1 with a feature, and its least log-likelihood ratio.
SAMPLE, FEATURES, VOTERS, SUPPORT, LEAST_WORTH = 20_000, 512, 256, 3, 6.0
STEMS = (4, 5, 6)
#: Rounds of EM at most, the change of a posterior that ends them, and the annotations' weight at its start.
ROUNDS, SETTLED, START = 60, 1e-4, 0.9
#: How often a vote is right at least; a feature with a larger share of its hits among an earlier voter's is no voter.
FLOOR, ALIKE = 0.5, 0.8
#: Least share of the texts of label 1 that a voter hits; voters that share more of the rarer one's hits sit in one committee.
VOTER_SUPPORT, TOGETHER = 0.02, 0.15
LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % MODULUS == HELD_OUT


def words_of(text: str) -> set[str]:
    return set(LETTERS.findall(text.lower()))


def features_of(words: set[str]) -> set[str]:
    """Words, and their beginnings marked with a star."""
    return {*words, *(w[:k] + "*" for w in words for k in STEMS if len(w) > k)}


@dataclass
class Model:
    """names[i] adds weights[i] if the text has it; any hit and log of hits have weights too.

    accuracies, correlations (with the parent in the tree) and tree are of the committees.
    """

    names: list[str]
    weights: np.ndarray
    any_hit: float
    log_hits: float
    constant: float
    voters: list[str] = field(default_factory=list)
    committees: list[str] = field(default_factory=list)
    accuracies: list[float] = field(default_factory=list)
    correlations: list[float] = field(default_factory=list)
    tree: list[int] = field(default_factory=list)

    def prepared(self) -> Model:
        self.place = {n: i for i, n in enumerate(self.names)}
        self.begin = {n.rstrip("*")[:3] for n in self.names}
        return self

    def hits(self, text: str) -> list[int]:
        begin, place = self.begin, self.place
        likely = {w for w in words_of(text) if w[:3] in begin}
        return [place[f] for f in features_of(likely) if f in place] if likely else []

    def score(self, text: str) -> float:
        z, found = self.constant, self.hits(text)
        if found:
            z += float(self.weights[sorted(found)].sum()) + self.any_hit + self.log_hits * float(np.log(len(found)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def tree_of(joint: np.ndarray, share: np.ndarray) -> list[int]:
    """Each voter's parent: a greatest spanning tree of the mutual information of two voters given the label.

    joint: by label, voter, vote, voter, vote: how likely the two votes come together.
    """
    m = joint.shape[1]
    alone = np.einsum("yjaja->yja", joint)
    p = joint + 1e-9
    info = np.einsum("y,yjakb->jk", share, p * np.log(p / (alone[:, :, :, None, None] * alone[:, None, None] + 1e-9)))
    parent = [-1] * m
    best, via = info[0].copy(), np.zeros(m, int)
    inside = np.zeros(m, bool)
    inside[0] = True
    for _ in range(m - 1):
        best[inside] = -np.inf
        j = int(best.argmax())
        parent[j] = int(via[j])
        inside[j] = True
        closer = info[j] > best
        best[closer], via[closer] = info[j][closer], j
    return parent


@dataclass
class Labels:
    """What the label model infers: posterior labels, and its parameters.

    accuracies: of each voter, the chance that a vote it casts is right;
    correlations: of each voter's vote with its parent's, given the label (0 for the root).
    """

    posterior: np.ndarray
    share: float
    accuracies: list[float]
    correlations: list[float]
    tree: list[int]


def better_than_chance(given: np.ndarray, share: np.ndarray) -> np.ndarray:
    """given (by label, voter, parent's vote, own vote) with votes of at least the floor's accuracy.

    What a vote lacks is taken from the other label's chance of it, so that the vote is as likely as before.
    """
    given = given.copy()
    for vote, side in ((2, 1), (0, 0)):
        for parent in (0, 1, 2):
            least = FLOOR if parent == 1 else share[side]
            chance = share[:, None] * given[:, :, parent, vote]
            total = chance.sum(0)
            short = chance[side] < least * total
            want = [np.where(short, (least if y == side else 1 - least) * total, chance[y]) / share[y] for y in (0, 1)]
            for y in (0, 1):
                now = np.minimum(want[y], 0.98)
                rest = (1 - now) / np.maximum(1 - given[y, :, parent, vote], 1e-9)
                others = [v for v in (0, 1, 2) if v != vote]
                given[y, :, parent, others] *= np.where(short, rest, 1.0)
                given[y, :, parent, vote] = np.where(short, now, given[y, :, parent, vote])
    return given


def label_model(votes: np.ndarray, start: np.ndarray, times: np.ndarray | None = None, rounds: int = ROUNDS) -> Labels:
    """Infers the labels of rows of votes (1 toxic, -1 clean, 0 abstained), each row counting times.

    start is where the posterior labels begin; nothing else is known of the labels.
    """
    n, m = votes.shape
    times = np.ones(n) if times is None else times.astype(float)
    posterior = start.astype(float)
    if not m:
        return Labels(posterior, float(posterior @ times / max(times.sum(), 1e-9)), [], [], [])
    state = votes.astype(int) + 1
    seen = (state[:, :, None] == np.arange(3)).astype(np.float32)
    flat = seen.reshape(n, 3 * m)
    every = np.arange(m)
    for _ in range(rounds):
        weight = np.stack([(1 - posterior) * times, posterior * times])
        mass = weight.sum(1)
        share = (mass + 0.5) / (mass.sum() + 1.0)
        met = np.stack([((flat * w[:, None].astype(np.float32)).T @ flat).astype(float) for w in weight]).reshape(2, m, 3, m, 3)
        single = (np.einsum("yjaja->yja", met) + 0.05) / (mass[:, None, None] + 0.15)
        tree = tree_of(met / (mass[:, None, None, None, None] + 1e-9), share)
        parent = np.maximum(tree, 0)
        # by label, voter, parent's vote, own vote; as the voter alone where the parent's vote is rare
        pair = met[:, parent, :, every].transpose(1, 0, 2, 3)
        given = (pair + single[:, :, None, :]) / (pair.sum(3, keepdims=True) + 1.0)
        root = np.array(tree) < 0
        given[:, root] = single[:, root, None, :]
        given = better_than_chance(given, share)
        log = np.log(given)
        say = np.stack([log[y][every, state[:, parent], state].sum(1) for y in (0, 1)]) + np.log(share)[:, None]
        before, posterior = posterior, 1 / (1 + np.exp(np.clip(say[0] - say[1], -30, 30)))
        if np.abs(posterior - before).max() < SETTLED:
            break
    right = share[1] * single[1, :, 2] + share[0] * single[0, :, 0]
    cast = (share[:, None] * (single[:, :, 0] + single[:, :, 2])).sum(0)
    votes_of, both = np.array([-1.0, 0.0, 1.0]), share[:, None, None, None] * pair / (mass[:, None, None, None] + 1e-9)
    mean, mean_parent = single @ votes_of, single[:, parent] @ votes_of
    moved = np.einsum("yjab,yja,yjb->j", both, votes_of - mean_parent[:, :, None], votes_of - mean[:, :, None])
    spread = np.sqrt(np.maximum(np.einsum("y,yja,yja->j", share, single, (votes_of - mean[:, :, None]) ** 2), 1e-12))
    correlations = np.where(root, 0.0, moved / (spread * spread[parent]))
    return Labels(posterior, float(share[1]), (right / cast).tolist(), np.clip(correlations, -1, 1).tolist(), tree)


def linear_classifier(x: np.ndarray, y: np.ndarray, times: np.ndarray, strength: float = 1.0, steps: int = 60) -> np.ndarray:
    """Logistic regression with an L2 penalty (not on the last column), by Newton steps; rows count times."""
    n, m = x.shape
    w = np.zeros(m)
    penalty = np.full(m, strength)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (times * (p - y)) + penalty * w
        h = (x * (times * (p * (1 - p) + 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most sample labelled rows."""
    split = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % MODULUS
    usable = labels.where(F.col("toxic").isNotNull() & (split != HELD_OUT)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
    chosen = usable.orderBy(F.xxhash64(F.col("doc_id"), F.lit("toxicity")), "doc_id").limit(sample)
    # copies of a text count once, or their words would pass for signs of the label
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy(F.xxhash64("text").alias("_hash")).agg(F.max("_toxic").alias("y"), F.first("text").alias("text")).select("y", "text")

    def counted(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos: Counter[str] = Counter()
        neg: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            names = [*pos, *(neg.keys() - pos.keys())]
            r = pa.RecordBatch.from_arrays([pa.array(names), pa.array([pos[k] for k in names]), pa.array([neg[k] for k in names])], names=["name", "pos", "neg"])
            pos.clear()
            neg.clear()
            return r

        for batch in source:
            for y, text in zip(batch.column(0).to_pylist(), texts(batch, 1), strict=True):
                (pos if y else neg).update(features_of(words_of(text)))
                if len(pos) + len(neg) > 300_000:
                    yield out()
        if pos or neg:
            yield out()

    sizes = rows.groupBy("y").count().collect()
    n = {r["y"]: r["count"] for r in sizes}
    n1, n0 = n.get(1, 0), sum(v for k, v in n.items() if k != 1)
    if not n1 or not n0:
        return Model([], np.zeros(0), 0.0, 0.0, -30.0).prepared()
    counts = rows.mapInArrow(released(counted), "name string, pos long, neg long").groupBy("name").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # log-likelihood ratio of the texts with it against the sample's share of label 1
    share, both = n1 / (n1 + n0), F.col("pos") + F.col("neg")
    worth = F.col("pos") * F.log(F.col("pos") / (both * share)) + F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / (both * (1 - share)))).otherwise(0.0)
    telling = (F.col("pos") >= SUPPORT) & (F.col("pos") > F.col("neg")) & (F.col("pos") > both * share)
    best = counts.where(telling).withColumn("worth", worth).where(F.col("worth") >= LEAST_WORTH)
    best = best.orderBy(F.col("worth").desc(), "name").limit(FEATURES)
    names = [r["name"] for r in best.select("name").collect()]  # bounded by FEATURES
    model = Model(names, np.zeros(len(names)), 0.0, 0.0, 0.0).prepared()
    width = -(-len(names) // 8)

    def marked(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(names, np.zeros(len(names)), 0.0, 0.0, 0.0).prepared()
        for batch in source:
            bits = []
            for text in texts(batch, 1):
                on = np.zeros(width * 8, np.uint8)
                on[own.hits(text)] = 1
                bits.append(np.packbits(on).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], names=["y", "bits"])

    # bounded: SAMPLE rows of FEATURES bits; equal rows in one
    table = rows.mapInArrow(released(marked), "y int, bits binary").groupBy("y", "bits").count().orderBy("y", "bits").toPandas()
    times = table["count"].to_numpy(int)
    if names:
        packed = np.frombuffer(b"".join(map(bytes, table["bits"])), np.uint8).reshape(len(table), width)
        hit = np.unpackbits(packed, axis=1)[:, : len(names)].astype(float)
    else:
        hit = np.zeros((len(table), 0))
    return trained(model, hit, table["y"].to_numpy(int), times)


def voters_of(hit: np.ndarray, y: np.ndarray, times: np.ndarray) -> list[int]:
    """The first VOTERS features of enough support, without those whose hits are nearly all hits of an earlier one."""
    chosen: list[int] = []
    size, support = times @ hit, (times * (y > 0)) @ hit
    for j in np.flatnonzero(support >= VOTER_SUPPORT * times[y > 0].sum()).tolist():
        both = (times * hit[:, j]) @ hit[:, chosen]
        if len(chosen) < VOTERS and not (both > ALIKE * size[j]).any():
            chosen.append(j)
    return chosen


def committees_of(hit: np.ndarray, voters: list[int], times: np.ndarray) -> np.ndarray:
    """Each voter's committee, from 0: those linked by pairs that often vote together."""
    own = hit[:, voters]
    both = (own * times[:, None]).T @ own
    near = both > TOGETHER * np.minimum.outer(np.diag(both), np.diag(both))
    label = np.arange(len(voters))
    while len(label):
        lower = np.where(near, label, len(voters)).min(1)
        lower = np.minimum(lower, lower[lower])
        if np.array_equal(lower, label):
            break
        label = lower
    return np.unique(label, return_inverse=True)[1]


def votes_of(hit: np.ndarray, voters: list[int], committees: np.ndarray) -> np.ndarray:
    """The committees' votes, the density voters last: 1 toxic, -1 clean, 0 abstained."""
    total = hit.sum(1)
    votes = [hit[:, np.array(voters)[committees == c]].max(1).astype(int) for c in range(committees.max(initial=-1) + 1)]
    density = [np.where(total >= most, 1, np.where(total == 0, -1, 0)) for most in (2, 4)]
    return np.column_stack([*votes, *density])


def trained(model: Model, hit: np.ndarray, y: np.ndarray, times: np.ndarray) -> Model:
    """The label model on the voters' votes, and the classifier on its posterior labels."""
    times = times.astype(float)
    total, voters = hit.sum(1), voters_of(hit, y, times)
    committees = committees_of(hit, voters, times)
    share = (y > 0) @ times / times.sum()
    labels = label_model(votes_of(hit, voters, committees), np.where(y > 0, START, (1 - START) * share / (1 - share)), times)
    some = (total > 0).astype(float)
    x = np.column_stack([hit, some, np.log(np.maximum(total, 1)), np.ones(len(hit))])
    w = linear_classifier(x, labels.posterior, times)
    m = len(model.names)
    model.weights, model.any_hit, model.log_hits, model.constant = w[:m], float(w[m]), float(w[m + 1]), float(w[m + 2])
    model.voters = [model.names[j] for j in voters]
    model.committees = [*(" ".join(model.names[j] for j, k in zip(voters, committees, strict=True) if k == c) for c in range(committees.max(initial=-1) + 1)), ">=2", ">=4"]
    model.accuracies, model.correlations, model.tree = labels.accuracies, labels.correlations, labels.tree
    return model


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every text."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.prepared()
        for batch in source:
            ids = batch.column(0).to_pylist()
            scores = [own.score(t) for t in texts(batch, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([held_out(i) for i in ids]), pa.array(scores), pa.array([int(s >= 0.5) for s in scores], pa.int32())], schema=schema
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose text scores below 0.5, with all their columns."""
    place = docs.columns.index("text")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.prepared()
        for batch in source:
            yield batch.filter(pa.array([own.score(t) < 0.5 for t in texts(batch, place)], pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)
