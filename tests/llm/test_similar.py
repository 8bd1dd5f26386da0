import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from factloom.llm import queries, simhash, sketches

SCHEMA = "doc_id long, text string, node string"


def text(seed, n):
    r = random.Random(seed)
    return " ".join(f"w{r.randint(0, 400)}" for _ in range(n))


def corpus():
    rows = []
    for i in range(40):
        base = text(i, 60)
        rows += [(len(rows), base, "x")]
        for k in range(i % 4):
            ws = base.split()
            ws[k * 7] = f"edit{k}"
            rows += [(len(rows), " ".join(ws), "x")]
    rows += [(900 + i, t, None) for i, t in enumerate([None, "", " \n", "one", "One", "one two", text(1, 5000)])]
    return rows + [(3, rows[3][1], "x"), (None, rows[0][1], None)]


def bits_of(t, k=4):
    words = (t or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(prints, ids, d):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= d:
                parent[find(i)] = find(j)
    best = {}
    for i in range(len(prints)):
        if ids[i] is not None:
            best[find(i)] = min(best.get(find(i), ids[i]), ids[i])
    return [best.get(find(i)) for i in range(len(prints))]


def test_every_four_positions_hold_a_triple():
    assert len(simhash.TRIPLES) == 20
    assert all(simhash.FIRST[m] < 99 for m in range(256) if m.bit_count() >= 4)


def test_groups(spark):
    rows = corpus()
    prints = [bits_of(t) for _, t, _ in rows]
    want = brute(prints, [i for i, *_ in rows], 4)
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    found = sorted((str(r["doc_id"]), np.int64(r["prints"][0]).astype(np.uint64).item(), r["component_id"]) for r in got)
    assert found == sorted((str(i), p, c) for (i, *_), p, c in zip(rows, prints, want, strict=True))
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_lists_keep_every_component(spark):
    r = random.Random(2)
    centre = r.getrandbits(64)
    prints = {centre}
    for _ in range(300):
        x = centre
        for b in r.sample(range(64), r.choice([1, 2, 3, 6, 9])):
            x ^= 1 << b
        prints.add(x)
    prints = sorted(prints)
    rows = [(np.uint64(p).astype(np.int64).item(),) for p in prints]
    nodes = spark.createDataFrame(rows, "node long").withColumn("prints", F.array("node"))
    want = brute(prints, list(range(len(prints))), 4)
    for small, large in ((64, 4096), (2, 4096), (2, 20)):
        labels = {r["node"]: r["label"] for r in simhash.components(simhash.links(nodes, 1, 4, small, large)).collect()}
        groups = {}
        for i, (node,) in enumerate(rows):
            groups.setdefault(labels.get(node, node), set()).add(i)
        expected = {}
        for i, c in enumerate(want):
            expected.setdefault(c, set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values())), (small, large)


def test_copies_leave_one(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = simhash.without_copies(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {0, 900} <= set(ids) and None not in ids
    assert simhash.without_copies(docs.limit(0)).count() == 0


def edited_brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        t, u = t or "", u or ""
        half = len(t) // 2
        out[i] = (len(t), t[: len(t) - half] + u[:half], t, u)
    return out


def grams(t, k=5):
    w = [x for x in t.replace("\n", " ").split(" ") if x]
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_sketches(spark):
    rows = [(i * 3, text(i, 5 + i * 11)) for i in range(25)] + [(1, None), (2, ""), (4, "é b"), (None, text(3, 200)), (7, text(5, 60)), (8, text(5, 60))]
    got = sketches.edited(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("near", sketches.resemblance(F.col("sketch"), F.col("edited_sketch"))).withColumn("n", sketches.distinct_shingles(F.col("sketch"))).collect()
    want = edited_brute(rows)
    assert len(got) == len(rows)
    for r in got:
        n, e, t, _ = want[r["doc_id"]]
        assert (r["n_chars"], r["edited"]) == (n, e)
        a, b = grams(t), grams(e)
        if len(a) < 64 and len(b) < 64:
            assert abs(r["near"] - (len(a & b) / len(a | b) if a | b else 1.0)) < (1e-9 if len(a | b) <= 64 else 0.25)
        assert abs(r["n"] - len(a)) <= max(0, 0.5 * len(a)) if len(a) >= 64 else r["n"] == len(a)
    same = {r["doc_id"]: r["sketch"] for r in got}
    assert same[7] == same[8]
    assert sketches.edited(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    (one,) = sketches.edited(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).collect()
    assert one["edited"] == "abab"


def test_sketches_merge(spark):
    rows = [("a", text(1, 300)), ("a", text(2, 300)), ("b", text(3, 20)), ("b", "")]
    parts = spark.createDataFrame(rows, "k string, text string").withColumn("sketch", sketches.sketch(F.col("text")))
    merged = {r["k"]: r["sketch"] for r in sketches.merge_parts(parts, ["k"]).collect()}
    for k in "ab":
        own = sorted({h for r in parts.where(F.col("k") == k).collect() for h in r["sketch"]})[:64]
        assert merged[k] == own


def test_many_cells(spark, monkeypatch):
    monkeypatch.setattr(sketches, "CELL_ROWS", 3)
    rows = [(i * i, text(i, 9)) for i in range(60)] + [(None, text(i, 9)) for i in range(100, 130)]
    rows += [(10**15, "outlier"), (-(2**63), "lowest"), (2**63 - 1, "highest"), (5, "a b"), (5, "c d"), (5, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = sketches.keyed(docs)
    cells = [r["n"] for r in known.select(sketches.cell(sketches.bounds_of(known, len(rows))).alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect()]
    assert len(cells) > 15 and max(cells) < 20
    found = sketches.with_next(docs).collect()
    got = {(r["doc_id"], r["text"]): r["next_text"] for r in found}
    assert len(found) == len(rows)
    numbered = sorted([r for r in rows if r[0] is not None and r[0] != 5], key=lambda r: -r[0])
    assert numbered[0][1] == "highest" and numbered[-1][1] == "lowest"
    for a, b in zip(numbered, numbered[1:], strict=False):
        if (a[0], b[0]) != (9, 4):  # the rows of id 5 stand between
            assert got[a] == b[1]
    nulls = {t for i, t in rows if i is None}
    assert got[numbered[-1]] in nulls
    assert sum(got[(None, t)] == numbered[0][1] for t in nulls) == 1
    fives = sorted((r["text"], r["next_text"]) for r in found if r["doc_id"] == 5)
    assert sum(t == n == "a b" for t, n in fives) == 1 and [t for t, _ in fives] == ["a b", "a b", "c d"]


def test_equal_rows_everywhere(spark, monkeypatch):
    monkeypatch.setattr(sketches, "CELL_ROWS", 2)
    rows = [(None, None)] * 30 + [(3, "x")] * 30
    got = sketches.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["next_text"] for r in got) == [""] * 30 + ["x"] * 30


def test_the_query_prints_sketches(spark, tmp_path):
    rows = [(i, text(i // 2, 30 + i), "c", "l", 9) for i in range(40)] + [(100, None, None, None, None), (101, "", None, None, 0), (102, "x " * 30_000, None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, sketch string, lang string, _h long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_bottom_k"](spark, str(tmp_path)).collect()}
    want = edited_brute([r[:2] for r in rows])
    assert len(got) == len(rows)
    for i, (n, e, t, u) in want.items():
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(e.encode()).hexdigest())
        a, b = grams(t), grams(u)
        if len(a | b) <= 64:
            assert abs(r["near_next"] - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-9
            c = grams(e)
            if a and len(a | c) <= 64 and len(c) < 64:
                assert abs(r["contained_in_edited"] - len(a & c) / len(a)) < 1e-9
        assert len(r["fingerprint"]) == 16 * min(64, len(a))
    assert got[100]["fingerprint"] == got[101]["fingerprint"] == ""
    empty = spark.createDataFrame([], "doc_id long, text string").write
    empty.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.QUERIES["op7_bottom_k"](spark, f"{tmp_path}/none").count() == 0
