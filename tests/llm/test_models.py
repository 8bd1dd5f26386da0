import math
import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers

from factloom.llm import lattice, toxicity

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, score string"


def texts(n=120):
    r = random.Random(4)
    syllables = ["the", "ra", "in", "on", "ti", "é", "q"]
    rows = [(i, " ".join("".join(r.choices(syllables, k=r.randint(1, 3))) for _ in range(r.randint(0, 30))), "c") for i in range(n)]
    return rows + [(500, None, None), (501, "", None), (502, "日本 İ ▁x ThE", None), (503, "z" * 30_000, None), (None, "the rain", None), (7, rows[7][1], None)]


def test_forward_sums_all_segmentations():
    p = lattice.pieces(PIECES)
    score = p.start
    names = {x.piece: i for i, x in enumerate(kept_pieces())}
    for word in ["rain", "a", "日q", "tion", "x͸y"]:
        s = "▁" + word
        total = -math.inf
        for cuts in product([0, 1], repeat=len(s) - 1):
            parts, at = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(s[at:i])
                    at = i
            parts.append(s[at:])
            logp = 0.0
            for part in parts:
                if part in names:
                    logp += score[names[part]]
                elif len(part) == 1:
                    logp += sum(score[p.n + b] for b in part.encode())
                else:
                    logp = -math.inf
                    break
            total = np.logaddexp(total, logp)
        assert abs(p.spelled([word], score)[0] - total) < 1e-9
        entry = math.log(0.01)
        whole, alone = p.log_probabilities([word], score, entry, math.log(0.25))
        assert abs(whole[0] - np.logaddexp(entry, math.log(0.25) + total)) < 1e-9 and abs(alone[0] - total) < 1e-9


def test_em_raises_the_likelihood_and_counts_every_character():
    p = lattice.pieces(PIECES)
    words = sorted({w for _, t, _ in texts() for w in (t or "").lower().split()})
    words += ["q" * 60, "日本" * 30, "z" * 9000]
    score, last = p.start, -math.inf
    length = np.array([len(x.piece) for x in kept_pieces()] + [0] * 256)
    for _ in range(3):
        now = p.spelled(words, score).sum()
        assert now > last
        last = now
        counts = np.zeros(p.n + 256)
        gain, mass = p.expected(words, score, counts)
        assert abs(gain - now) < 1e-6 * abs(now) and mass >= len(words)
        bare = sum(c not in p.chars or p.single[p.chars[c]] < 0 for w in words for c in w)
        assert abs(counts @ length - sum(len(w) + 1 for w in words) + bare) < 1e-3
        twice = np.zeros(p.n + 256)
        p.expected(words, score, twice, lambda places, alone: np.full(len(places), 2.0))
        assert np.allclose(twice, 2 * counts)
        score = np.log((counts + 1e-9) / (counts + 1e-9).sum())


def kept_pieces():
    from sentencepiece import sentencepiece_model_pb2 as pb2

    model = pb2.ModelProto()
    model.ParseFromString(open(PIECES, "rb").read())
    return [x for x in model.pieces if x.type == 1 and len(x.piece) <= 16 and "▁" not in x.piece[1:]]


def test_scaled_and_log_recursions_agree(monkeypatch):
    p = lattice.pieces(PIECES)
    words = sorted({w for _, t, _ in texts() for w in (t or "").lower().split() if len(w) < 40})
    one, other = np.zeros(p.n + 256), np.zeros(p.n + 256)
    a = p.expected(words, p.start, one)
    monkeypatch.setattr(lattice, "LINEAR", 0)
    b = p.expected(words, p.start, other)
    assert np.allclose(one, other) and abs(a[0] - b[0]) < 1e-6


def test_long_words_are_spelled_in_runs(monkeypatch):
    p = lattice.pieces(PIECES)
    monkeypatch.setattr(lattice, "RUN", 7)
    word = "therainontherain"
    runs = ["▁therai", "nonther", "ain"]
    codes = [np.array([[p.chars[c] for c in r]]) for r in runs]
    want = sum(p.forward(p.weights(p.edges(c), [], p.start))[0, -1] for c in codes)
    assert abs(p.spelled([word], p.start)[0] - want) < 1e-9


def test_scores(spark):
    rows = texts()
    got = lattice.score_texts(spark.createDataFrame(rows, SCHEMA), PIECES, top=20).collect()
    assert len(got) == len(rows)
    lower = lambda t: (t or "").encode().lower().split()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = Counter(w for i, t, _ in rows if not held(i) for w in lower(t))
    ends = sum(not held(i) for i, *_ in rows)
    n, v = sum(c.values()) + ends, len(c) + 1
    want = {}
    for i, t, _ in rows:
        ws = lower(t)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1))
        want[i] = (held(i), len(ws) + 1, sum(c[w] > 0 for w in ws) + 1, n, base)
    for r in got:
        h, tokens, known, total, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, tokens, known, total)
        assert abs(r["base_score"] - base) < 1e-6 and -math.inf < r["score"] < 0
    counts, _ = lattice.word_counts(spark.createDataFrame(rows, SCHEMA))
    assert {(bytes(r["word"]), r["count"], r["seen"]) for r in counts.collect()} == {
        (w, c[w], k) for w, k in Counter(w for _, t, _ in rows for w in lower(t)).items()
    }
    shares = lattice.Shares(n + 1.0, (lattice.DISCOUNT * len(c) + 1.0) / (n + 1.0))
    known = list(c)
    assert abs(np.exp(shares.entry(np.array([c[w] for w in known]))).sum() + shares.left + ends / (n + 1.0) - 1) < 1e-9
    pieces, trained = lattice.pieces(PIECES), lattice.train(counts, PIECES, shares)
    for i, t, _ in rows:
        ws = [w.decode() for w in lower(t)]
        whole, alone = pieces.log_probabilities(ws, trained, shares.entry(np.array([c[w.encode()] for w in ws])), math.log(shares.left))
        (r,) = [r for r in got if r["doc_id"] == i][:1]
        end = math.log(ends / (n + 1.0))
        assert abs(r["score"] - (whole.sum() + end) / math.log(10)) < 1e-6 * max(1, abs(r["score"]))
        assert abs(r["spelled_score"] - (alone.sum() + end) / math.log(10)) < 1e-6 * max(1, abs(r["score"]))
    by = {r["doc_id"]: r["score"] for r in got}
    assert abs(by[500] - by[501]) < 1e-12
    wide = {r["doc_id"]: r["score"] for r in lattice.score_texts(spark.createDataFrame(rows, SCHEMA), PIECES).collect()}
    assert all(abs(by[i] - wide[i]) < 1e-6 for i in by)
    assert lattice.score_texts(spark.createDataFrame([], SCHEMA), PIECES).count() == 0


def labelled(n=1500):
    r = random.Random(9)
    words = [f"{a}{b}" for a in ("the", "on", "ra", "ti") for b in ("in", "er", "al", "ou", "st")]
    rows, labels = [], []
    for i in range(n):
        ws = r.choices(words, k=r.randint(3, 60))
        toxic = r.random() < 0.15
        if toxic:
            for _ in range(r.randint(1, 4)):
                ws.insert(r.randint(0, len(ws)), r.choice(["Idiot", "scum", "moron.", f"lowei{r.choice(words)}", f"vequ{r.choice(words)}"]))
        rows.append((i, " ".join(ws), "c"))
        if i % 3:
            labels.append((i, int(toxic), 1))
    return rows + [(5000, None, None), (5001, "", None), (None, "idiot scum", None), (5002, "x" * 100_000, None)], labels + [(0, None, 1), (99_999, 1, 1)]


def test_toxicity(spark):
    rows, labels = labelled()
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs, marks)
    assert {"idiot", "scum", "moron"} <= set(model.names) and {"lowei*", "vequ*"} <= set(model.names)
    got = {r["doc_id"]: r for r in toxicity.score_texts(docs, model).collect()}
    assert len(got) == len(rows)
    held = [(got[i]["predicted"], t) for i, t, _ in labels if i in got and t is not None and got[i]["held_out"]]
    assert sum(p == t for p, t in held) >= 0.97 * len(held)
    assert got[5000]["score"] == got[5001]["score"] < 0.5 and got[None]["predicted"] == 1
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}
    assert max(model.accuracies) > 0.9 and len(model.accuracies) == len(model.committees) == len(model.correlations) == len(model.tree)


def test_toxicity_without_labels(spark):
    rows, _ = labelled(20)
    docs = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["predicted"] for r in toxicity.score_texts(docs, model).collect()} == {0}
    assert toxicity.score_texts(docs.limit(0), model).count() == 0


def test_label_model_finds_accuracies_and_correlations():
    r = np.random.default_rng(1)
    n = 6000
    y = r.random(n) < 0.3

    def voter(right, wrong):
        return np.where(y, r.random(n) < right, r.random(n) < wrong).astype(int)

    good, fair, other, bad = voter(0.8, 0.02), voter(0.6, 0.05), voter(0.5, 0.03), voter(0.2, 0.2)
    twin = good ^ (r.random(n) < 0.02)
    against = np.where(y, 0, -(r.random(n) < 0.7).astype(int))
    votes = np.column_stack([good, twin, fair, other, bad, against])
    for flipped in (0.0, 0.2):
        annotated = y ^ (r.random(n) < flipped)
        found = toxicity.label_model(votes, np.where(annotated, 0.99, 0.01))
        assert ((found.posterior > 0.5) == y).mean() > 0.93
        assert flipped == 0 or ((found.posterior > 0.5) == annotated).mean() < 0.85
        for j, v in enumerate([good, twin, fair, other]):
            true = (y & (v > 0)).sum() / max((v > 0).sum(), 1)
            assert abs(found.accuracies[j] - true) < 0.06, (j, found.accuracies[j], true)
        assert found.accuracies[4] < 0.45 and found.accuracies[5] > 0.85
        assert abs(found.share - 0.3) < 0.08
        assert 1 in (j for j, p in enumerate(found.tree) if p == 0) or found.tree[0] == 1
        strongest = max(range(6), key=lambda j: found.correlations[j])
        assert {strongest, found.tree[strongest]} == {0, 1} and found.correlations[strongest] > 0.8


def test_noisy_annotations_are_overruled(spark):
    rows, labels = labelled(3000)
    truth = {i: t for i, t, _ in labels if t is not None}
    r = random.Random(3)
    noisy = [(i, t if t is None else t ^ (r.random() < 0.2), q) for i, t, q in labels]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.fit(docs, spark.createDataFrame(noisy, "doc_id long, toxic int, quality int"))
    got = {x["doc_id"]: x["predicted"] for x in toxicity.score_texts(docs, model).collect()}
    agree = [got[i] == t for i, t in truth.items() if i in got]
    assert sum(agree) >= 0.97 * len(agree)
    assert sum(got[i] == t for i, t, _ in noisy if t is not None and i in got) < 0.87 * len(agree)


def test_toxicity_with_clashing_labels(spark):
    rows, labels = labelled(300)
    docs = spark.createDataFrame([(*x, 1, "s") for x in rows], SCHEMA + ", toxic int, y string")
    marks = spark.createDataFrame([(i, t, "x", "y") for i, t, _ in labels + labels[:9]] + [(None, 1, None, None)], "doc_id long, toxic int, text string, y string")
    got = toxicity.score_texts(docs, toxicity.fit(docs, marks))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == len(rows)
