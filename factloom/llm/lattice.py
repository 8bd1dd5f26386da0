"""Language-model scores from a subword lattice.

A text is a sequence of words and one end. A word's lattice has an arc for each
piece of an existing vocabulary that stands at a place of it, and, since frequent
words belong into a unigram vocabulary, one arc over the whole word with the
word's discounted share of the training tokens; what the discounts leave is the
weight of spelling a word by pieces. Forward recursion in log space sums over
all segmentations: the word's marginal probability, and the sum of their
logarithms is the text's. The whole is a proper distribution over tokens.

The vocabulary's pieces are fixed. The file at hand holds merge ranks in place
of log probabilities, so ranks only start the scores (as 1 / rank). EM over the
distinct training words estimates them: each round runs forward over every
word's lattice, goes back with the posterior of each arc, and sums each piece's
expected uses, a word counting as often as its occurrences are spelled; the
rounds end when the spelled words' log likelihood moves by less than TOLERANCE.
Characters without a piece are spelled in bytes. A word of more than RUN
characters is spelled in runs of so many, which bounds a lattice's memory.

Counting and scoring: words are counted map-side in bounded tables and summed by
word; each distinct word is scored once. Documents look the most frequent words
up in a broadcast table of TOP entries; only the rest is joined by word, and
partial sums are added by document.

Defined results: a null or empty text is one end; a null doc_id counts as the
empty text for the split; repeated rows are texts of their own; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, materialise, texts

HELD_OUT, MODULUS = 2, 7
#: Words in the broadcast table; entries of a task's table before it is passed on.
TOP, FLUSH = 100_000, 300_000
#: Rounds of EM at most, and the relative gain that ends them; taken off each word's count for spelling.
ROUNDS, TOLERANCE, DISCOUNT = 12, 3e-3, 0.1
LONGEST_PIECE, RUN = 16, 4096
#: Up to so many characters, none spelled in bytes, no probability can underflow.
LINEAR = 24
#: Lattice cells worked on at a time, and words gathered for that.
CELLS, GATHER = 2_000_000, 60_000
MARK = "▁"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % MODULUS == HELD_OUT


class Pieces:
    """A trie over the pieces of a SentencePiece file; scores are given to each call."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb2

        model = pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kind = pb2.ModelProto.SentencePiece
        named = [p for p in model.pieces if p.type == kind.NORMAL and len(p.piece) <= LONGEST_PIECE and MARK not in p.piece[1:]]
        ranks = sorted(range(len(named)), key=lambda i: -named[i].score)
        self.n = len(named)
        start = np.empty(self.n + 256)
        start[ranks] = 1.0 / (np.arange(self.n) + 1.0)
        start[self.n :] = 1.0 / self.n
        self.start = np.log(start / start.sum())
        self.chars = {c: i for i, c in enumerate(sorted({c for p in named for c in p.piece}))}
        width = len(self.chars) + 1
        nodes: dict[tuple[int, int], int] = {}
        piece_at = {0: -1}
        for i, p in enumerate(named):
            at = 0
            for c in p.piece:
                key = (at, self.chars[c])
                if key not in nodes:
                    nodes[key] = len(nodes) + 1
                at = nodes[key]
            piece_at[at] = i
        self.width = width
        order = sorted((a * width + c, b) for (a, c), b in nodes.items())
        self.keys = np.array([k for k, _ in order] + [1 << 62], np.int64)
        self.next = np.array([b for _, b in order] + [-1], np.int64)
        self.piece = np.array([piece_at.get(i, -1) for i in range(len(nodes) + 1)], np.int64)
        self.codes = np.full(0x110000, -1, np.int64)
        self.codes[[ord(c) for c in self.chars]] = np.arange(len(self.chars))
        self.single = np.full(width, -1, np.int64)
        for i, p in enumerate(named):
            if len(p.piece) == 1:
                self.single[self.chars[p.piece]] = i

    def edges(self, chars: np.ndarray) -> np.ndarray:
        """Pieces by (word, end - 1, -length), -1 where there is none, of words of equal length."""
        rows, n = chars.shape
        flat = chars.ravel()
        at = np.arange(rows * n)
        node = np.zeros(rows * n, np.int64)
        room = n - at % n
        found = []
        for k in range(min(n, LONGEST_PIECE)):
            inside = room > k
            at, node, room = at[inside], node[inside], room[inside]
            c = flat[at + k]
            key = node * self.width + c
            place = np.searchsorted(self.keys, key)
            hit = (self.keys[place] == key) & (c >= 0)
            at, node, room = at[hit], self.next[place[hit]], room[hit]
            if not len(at):
                break
            found.append((at + k, self.piece[node]))
        longest = max(1, len(found))
        out = np.full((rows * n, longest), -1, np.int32)
        for k, (end, piece) in enumerate(found):
            out[end, longest - 1 - k] = piece
        return out.reshape(rows, n, longest)

    def lattices(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int, bytes]]]]:
        """(places in words, edges, spelled characters) of words, or runs of long ones, of equal length at a time."""
        by_length: dict[int, list[tuple[int, str]]] = {}
        for i, w in enumerate(words):
            w = MARK + w.replace(MARK, "\x01")  # a mark within a word begins no piece
            for k in range(0, len(w), RUN):
                run = w[k : k + RUN]
                by_length.setdefault(len(run), []).append((i, run))
        for n, runs in by_length.items():
            step = max(1, CELLS // (n * min(n, LONGEST_PIECE)))
            for k in range(0, len(runs), step):
                places = np.array([i for i, _ in runs[k : k + step]])
                text = np.array([r for _, r in runs[k : k + step]]).view(np.uint32).reshape(len(places), n)
                codes = self.codes[text]
                bare = (codes < 0) | (self.single[codes] < 0)
                odd = bare.any(1)
                for some in (np.flatnonzero(~odd), np.flatnonzero(odd)):
                    if len(some):
                        spelled = [(r, j, chr(text[some[r], j]).encode("utf-8", "surrogatepass")) for r, j in np.argwhere(bare[some]).tolist()]
                        yield places[some], self.edges(codes[some]), spelled

    def weights(self, edges: np.ndarray, spelled: list[tuple[int, int, bytes]], score: np.ndarray) -> np.ndarray:
        """The arcs' log probabilities."""
        w = np.append(score, -np.inf)[edges]
        for r, j, raw in spelled:
            w[r, j, -1] = sum(score[self.n + b] for b in raw)
        return w

    def forward(self, w: np.ndarray) -> np.ndarray:
        """Log of the summed probability of all ways to each place; before it, as many unreachable places as the longest piece has characters, less one."""
        rows, n, longest = w.shape
        alpha = np.full((rows, longest + n), -np.inf)
        alpha[:, longest - 1] = 0
        with np.errstate(divide="ignore"):
            for j in range(n):
                ways = alpha[:, j : j + longest] + w[:, j]
                top = ways.max(1)
                top[top == -np.inf] = 0
                alpha[:, j + longest] = np.log(np.exp(ways - top[:, None]).sum(1)) + top
        return alpha

    def spelled(self, words: list[str], score: np.ndarray) -> np.ndarray:
        """Log of each word's summed probability over the pieces' arcs."""
        out = np.zeros(len(words))
        for places, edges, spelled in self.lattices(words):
            np.add.at(out, places, self.forward(self.weights(edges, spelled, score))[:, -1])
        return out

    def log_probabilities(self, words: list[str], score: np.ndarray, entry: np.ndarray | float = -np.inf, spelling: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Log marginals of the words' lattices with arcs of log probability entry over the whole words, and those of the pieces alone."""
        alone = self.spelled(words, score)
        return np.logaddexp(entry, spelling + alone), alone

    def expected(self, words: list[str], score: np.ndarray, counts: np.ndarray, weight: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[float, float]:
        """Add the expected use of each piece in the words; the weighted sum of their log probabilities, and of the weights.

        weight(places, log probabilities) is how often each word counts; 1 if not given.
        """
        gain = mass = 0.0
        for places, edges, spelled in self.lattices(words):
            w = self.weights(edges, spelled, score)
            rows, n, longest = w.shape
            if n <= LINEAR and not spelled:
                w = np.exp(w)
                alpha = np.zeros((rows, longest + n))
                alpha[:, longest - 1] = 1
                for j in range(n):
                    alpha[:, j + longest] = np.einsum("rk,rk->r", alpha[:, j : j + longest], w[:, j])
                total = np.log(alpha[:, -1])
            else:
                alpha = self.forward(w)
                total = alpha[:, -1]
            times = weight(places, total) if weight else np.ones(rows)
            gain, mass = gain + float(times @ total), mass + float(times.sum())
            # back from the end: a place's posterior is dealt to the arcs that lead to it, by their share of its probability
            place = np.zeros((rows, longest + n))
            place[:, -1] = times
            for j in range(n - 1, -1, -1):
                before, here = alpha[:, j : j + longest], alpha[:, j + longest, None]
                if n <= LINEAR and not spelled:
                    w[:, j] *= before * (place[:, j + longest] / np.maximum(here[:, 0], 1e-300))[:, None]
                else:
                    share = np.where(np.isfinite(here), before + w[:, j] - np.where(np.isfinite(here), here, 0), -np.inf)
                    w[:, j] = np.exp(share) * place[:, j + longest, None]
                place[:, j : j + longest] += w[:, j]
            on = edges >= 0
            for r, j, raw in spelled:
                on[r, j, -1] = False
                for b in raw:
                    counts[self.n + b] += w[r, j, -1]
            counts += np.bincount(edges[on], w[on], len(counts))
        return gain, mass


LOADED: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in LOADED:
        LOADED[path] = Pieces(path)
    return LOADED[path]


COUNTS = pa.schema([("word", pa.binary()), ("count", pa.int64()), ("seen", pa.int64())])


def word_counts(docs: DataFrame) -> tuple[DataFrame, int]:
    """(word, count in training texts, seen: count in all texts), and the number of training texts."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained: Counter[bytes] = Counter()
        other: Counter[bytes] = Counter()

        def passed_on() -> pa.RecordBatch:
            words = [*trained, *other]
            counts = [*trained.values(), *[0] * len(other)]
            seen = [*trained.values(), *other.values()]
            trained.clear()
            other.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64()), pa.array(seen, pa.int64())], schema=COUNTS)

        for batch in source:
            for i, text in zip(batch.column(0).to_pylist(), texts(batch, 1), strict=True):
                (other if held_out(i) else trained).update(text.encode().lower().split())
                if len(trained) + len(other) > FLUSH:
                    yield passed_on()
        yield passed_on()

    known = docs.select(F.col("doc_id").cast("long"), "text")
    counts = known.mapInArrow(run, "word binary, count long, seen long").groupBy("word").agg(F.sum("count").alias("count"), F.sum("seen").alias("seen"))
    split = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % MODULUS
    texts_trained = docs.where(split != HELD_OUT).count()
    return materialise(counts, "lm-counts"), texts_trained


def gathered(source: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in source:
        held.append(batch)
        n += batch.num_rows
        if n >= GATHER:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


@dataclass
class Shares:
    """The parts of the training tokens, end included, that whole words and spelling get."""

    whole: float
    left: float

    def entry(self, count: np.ndarray) -> np.ndarray:
        """Log probability of the arc over a whole word."""
        with np.errstate(divide="ignore"):
            return np.log(np.maximum(count - DISCOUNT, 0.0) / self.whole)


def train(counts: DataFrame, path: str, shares: Shares, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the vocabulary's pieces and the 256 bytes, by EM over the training words' lattices."""
    p = pieces(path)
    score, last = p.start, -math.inf
    words = counts.where("count > 0").select("word", "count")
    schema = pa.schema([("piece", pa.int32()), ("expected", pa.float64())])
    for _ in range(rounds):

        def run(source: Iterator[pa.RecordBatch], score=score) -> Iterator[pa.RecordBatch]:
            own = pieces(path)
            total, gain, mass = np.zeros(own.n + 256), 0.0, 0.0
            for t in gathered(source):
                count = t.column(1).to_numpy().astype(float)
                entry = shares.entry(count)

                def spelled(places: np.ndarray, alone: np.ndarray, count=count, entry=entry) -> np.ndarray:
                    """Of a word's occurrences, those that the lattice's posterior gives to spelling, and the discount."""
                    other = math.log(shares.left) + alone
                    return np.minimum(count[places], DISCOUNT + count[places] * np.exp(other - np.logaddexp(other, entry[places])))

                more = own.expected(t.column(0).cast(pa.string()).to_pylist(), score, total, spelled)
                gain, mass = gain + more[0], mass + more[1]
            used = np.flatnonzero(total)
            # two more rows: the log likelihood and the number of spelled words
            yield pa.RecordBatch.from_arrays([pa.array(np.append(used, [-1, -2]).astype(np.int32)), pa.array(np.append(total[used], [gain, mass]))], schema=schema)

        found = words.mapInArrow(run, "piece int, expected double").groupBy("piece").agg(F.sum("expected").alias("expected")).toPandas()
        piece, expected = found["piece"].to_numpy(int), found["expected"].to_numpy()
        total = np.full(p.n + 256, 1e-3)  # every piece keeps some probability
        total[piece[piece >= 0]] += expected[piece >= 0]
        score = np.log(total / total.sum())
        mean = expected[piece == -1].sum() / max(expected[piece == -2].sum(), 1e-9)
        if mean - last <= TOLERANCE * abs(mean):
            break
        last = mean
    return score


def score_texts(docs: DataFrame, path: str, rounds: int = ROUNDS, top: int = TOP) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and spelled_score of every text.

    score is the marginal of the lattices; spelled_score that of the file's pieces alone, without arcs over whole words.
    """
    spark = docs.sparkSession
    counts, ends = word_counts(docs)
    total, kinds = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.when(F.col("count") > 0, 1))).first()
    n, v = total + ends, kinds + (ends > 0)
    # one token more than were seen, for spelling where there is nothing to take off
    shares = Shares(n + 1.0, (DISCOUNT * kinds + 1.0) / (n + 1.0) if ends else 0.5)
    p_end = ends / shares.whole if ends else 0.5
    score = train(counts, path, shares, rounds)

    def weigh(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for t in gathered(source):
            whole, alone = own.log_probabilities(t.column(0).cast(pa.string()).to_pylist(), score, shares.entry(t.column(1).to_numpy()), math.log(shares.left))
            columns = [*(t.column(k).combine_chunks() for k in range(3)), pa.array(whole / math.log(10)), pa.array(alone / math.log(10))]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "count", "seen", "log10_p", "log10_s"])

    weighed = materialise(counts.mapInArrow(weigh, "word binary, count long, seen long, log10_p double, log10_s double"), "lm-words")
    # the counts' logarithms in a few hundred bins give the least count of at most top words
    bin_of = F.floor(F.log2(F.col("seen")) * 8)
    room, least = top, math.inf
    for r in sorted(weighed.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min("seen").alias("low")).collect(), key=lambda r: -r["bin"]):
        if r["n"] > room:
            break
        room, least = room - r["n"], r["low"]
    common = weighed.where(F.col("seen") >= F.lit(float(least))).toPandas()  # at most top rows
    base_of = math.log10(n + v + 1)
    table = {
        w: (c, math.log10(c + 1) - base_of, p, s)
        for w, c, p, s in zip(common["word"].map(bytes), *(common[k].tolist() for k in ("count", "log10_p", "log10_s")), strict=True)
    }
    shared = spark.sparkContext.broadcast(table)
    end_known, end_base, end_score = int(ends > 0), math.log10(ends + 1) - base_of, math.log10(p_end)
    schema = pa.schema([
        ("row", pa.int64()), ("word", pa.binary()), ("n", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()),
        ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("spelled_score", pa.float64()),
    ])

    def partial(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        get = shared.value.get
        for batch in source:
            heads: list[tuple] = []
            rows: list[int] = []
            words: list[bytes] = []
            times: list[int] = []
            for i, text in zip(batch.column(0).to_pylist(), texts(batch, 1), strict=True):
                found = text.encode().lower().split()
                known, base, model, spelled = end_known, end_base, end_score, end_score
                for w, k in Counter(found).items():
                    hit = get(w)
                    if hit is None:
                        rows.append(row)
                        words.append(w)
                        times.append(k)
                    else:
                        known += k * (hit[0] > 0)
                        base += k * hit[1]
                        model += k * hit[2]
                        spelled += k * hit[3]
                # no word has a space: this key meets nothing, and is dealt evenly
                heads.append((row, b" %d" % row, 0, i, held_out(i), len(found) + 1, known, base, model, spelled))
                row += 1
                if len(rows) > 200_000:
                    yield rare(rows, words, times)
                    rows, words, times = [], [], []
            yield batches(schema, heads)
            yield rare(rows, words, times)

    def rare(rows: list[int], words: list[bytes], times: list[int]) -> pa.RecordBatch:
        none = [pa.nulls(len(rows), f.type) for f in list(schema)[3:]]
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(words, pa.binary()), pa.array(times, pa.int64()), *none], schema=schema)

    ddl = "row long, word binary, n long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, spelled_score double"
    parts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial, ddl)
    joined = parts.join(weighed.drop("seen").withColumnRenamed("count", "_c"), "word", "left")
    k = F.when(F.col("n") > 0, F.col("n")).otherwise(0)
    unit = F.log10(F.coalesce(F.col("_c"), F.lit(0)) + 1.0) - base_of
    summed = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("n_known", F.when(F.col("_c") > 0, k).otherwise(0))).cast("long").alias("n_known"),
        F.sum(F.coalesce("base_score", k * unit)).alias("base_score"),
        F.sum(F.coalesce("score", k * F.col("log10_p"))).alias("score"),
        F.sum(F.coalesce("spelled_score", k * F.col("log10_s"))).alias("spelled_score"),
    )
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", "spelled_score")
