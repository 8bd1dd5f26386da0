import random

import corpus_pipeline
from factloom.llm import minhash, mixing, pieces, queries, toxicity

SF = "/root/testdata/sf0.001"


def likeness(a, b):
    return len(a & b) / len(a | b)


def components(sets):
    """Smallest id of each id's component under a similarity of 0.8, by comparing all pairs."""
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if b < a and likeness(sets[a], sets[b]) >= 0.8:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def grams(text):
    return set(minhash.shingles(text or "", 5).tolist())


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "mixing", "sentencepiece"]
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = [r for r in docs.collect() if model.score(r["text"]) < 0.5]
    groups = components({r["doc_id"]: grams(r["text"]) for r in clean})
    kept = {i for i, c in groups.items() if i == c}
    assert len(kept) < len(groups)
    assert {r["doc_id"] for r in minhash.without_copies(docs.where(docs["doc_id"].isin(list(groups)))).collect()} == kept
    times = {r["doc_id"]: r["repeats"] for r in mixing.mix(docs.where(docs["doc_id"].isin(list(kept)))).collect()}
    digests = {r["doc_id"]: tuple(r) for r in pieces.round_trip(docs, queries.tokenizer(queries.PIECES)).collect()}
    assert got == sorted(digests[i] for i, n in times.items() for _ in range(n))


def near_copies(n=160):
    """Texts, and of each a copy with some words changed, at similarities on both sides of the threshold."""
    r, rows = random.Random(6), []
    for i in range(n):
        words = [f"w{r.randint(0, 5000)}" for _ in range(r.randint(80, 200))]
        rows.append((2 * i, " ".join(words)))
        for k in r.sample(range(len(words)), 1 + i % 6):
            words[k] = f"new{k}"
        rows.append((2 * i + 1, " ".join(words)))
    return rows


def test_near_copies_are_found_and_verified(spark):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    want = components({i: grams(t) for i, t in rows})
    linked = [i for i, c in want.items() if c != i]
    assert 40 < len(linked) < 160
    assert sum(got[i] == want[i] for i in linked) >= 0.99 * len(linked)
    assert all(got[i] == i for i, c in want.items() if c == i)


def written(spark, path, docs, labels, docs_schema="doc_id long, text string, lang string, source string, n_chars long", labels_schema="doc_id long, quality int, toxic int"):
    spark.createDataFrame(docs, docs_schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, labels_schema).write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path / "a", [], [])).count() == 0
    # without labels nothing is toxic
    rows = [(i, f"text number {i} of some words here", "en", "web", 9) for i in range(8)]
    found = corpus_pipeline.run(spark, written(spark, tmp_path / "b", rows, []))
    assert {r["doc_id"] for r in found.collect()} == set(range(8))


def test_nulls_ties_and_clashing_columns(spark, tmp_path):
    rows = [(i, f"document {i} " + "some words " * i, None, None if i % 3 else "web", None) for i in range(12)]
    rows += [(100, None, None, None, None), (101, "", None, None, 0), (None, None, None, None, None), (None, "only words of an unnamed text", "en", "web", 1)]
    rows += [rows[3], rows[3], (200, "word " * 60_000, "en", "web", 1)]
    extra = [(*r, "x", 1) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, node string, _hash int"
    path = written(spark, tmp_path, extra, [(0, None, None), (None, 1, 1), (5, 1, 0), (5, 1, 0)], schema)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, path)
        assert after.columns == docs.columns
        docs = spark.createDataFrame(after.collect(), docs.schema)
    kept = [r["doc_id"] for r in docs.collect()]
    # empty and null texts are copies of each other: one of them stays, without words it is never mixed in
    assert {200, 3} <= set(kept) and not {101} & set(kept)
    assert corpus_pipeline.run(spark, path).count() == len(kept)
