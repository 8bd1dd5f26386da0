import re

from factloom.llm import mixing, queries

SCHEMA = "doc_id long, text string, source string, size string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fill(sizes, weights, budget, cap):
    """Water-filling by repeated resharing."""
    target, clamped = {}, set()
    while True:
        free = [s for s in sizes if s not in clamped]
        left = budget - sum(cap * sizes[s] for s in clamped)
        w = sum(weights[s] for s in free)
        target = {s: cap * sizes[s] if s in clamped else left * weights[s] / w for s in sizes}
        over = {s for s in free if target[s] > cap * sizes[s] + 1e-9}
        if not over:
            return target
        clamped |= over


def rows():
    out = []
    for i in range(400):
        source = None if i % 10 == 0 else "ab"[i % 2] if i % 3 else "c" if i % 9 else "é"
        text = None if i % 50 == 7 else "" if i % 50 == 8 else " ".join(["w\tx"] * (1 + i * 7 % 23))
        out.append((i, text, source, "clash"))
    return out + out[:3]


def test_targets_and_takings(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = mixing.mix(docs).collect()
    assert len(got) == 403
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in rows()}
    by = {}
    for i, _, s, _ in rows():
        by[s] = by.get(s, 0) + size[i]
    order = sorted([s for s in by if s is not None], key=lambda s: [ord(c) for c in s]) + [None]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want = fill(by, weights, 1.5 * sum(by.values()), 2)
    taken = {}
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == by[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    longest = max(size.values())
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2 * longest, (s, taken[s], t)
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}


def test_documents_are_repeated(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["repeats"]
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    seen = {}
    for r in out.collect():
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
    assert seen == {k: v for k, v in taken.items() if v}


def test_empty_table_and_no_words(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mixed_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, None, None), (None, "", "a", None)], SCHEMA)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2


def test_budget_beyond_all_caps(spark):
    docs = spark.createDataFrame([(1, "a b", "s", ""), (2, "c", "t", "")], SCHEMA)
    assert {r["taken"] for r in mixing.mix(docs, share=9.0).collect()} == {4, 2}


def test_copies_at_the_cut_are_parted(spark):
    for copies in (1001, 7):
        equal = [(5, "a b c d e", "hot", None)] * copies
        docs = spark.createDataFrame(equal + [(i, "w " * (i % 9), "other", "x") for i in range(600)], SCHEMA)
        got = mixing.mix(docs).collect()
        taken = sum(r["taken"] for r in got if r["source"] == "hot")
        (target,) = {r["target"] for r in got if r["source"] == "hot"}
        assert abs(taken - target) <= 2.5, (taken, target)
        assert len(got) == copies + 600 and max(r["repeats"] for r in got) <= 2
        again = mixing.mix(docs.repartition(5)).collect()
        assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in got)
        out = mixing.mixed_documents(docs)
        assert out.columns == docs.columns and out.where("source = 'hot'").count() == taken // 5


def test_the_query(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op1_mix_sources"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[c] for c in got.columns) for r in mixing.mix(spark.createDataFrame(rows(), SCHEMA)).collect())
