"""Near duplicates by SimHash, found in an inverted index of byte positions.

Two fingerprints of eight bytes that differ in at most four bits agree in at
least four bytes at the same positions. The inverted index lists fingerprints
by the values at three positions at a time: 20 triples of positions, chosen so
that any four positions include one of them, so that a list is short even where
one byte's would hold a 256th of everything. For each pair in a list the shared
positional bytes are tallied, pairs below the guaranteed number of matches go,
the rest are verified by counting bits. A pair is kept in the first list that
holds it only, so none comes twice.

Lists are cut by length, each way exact:
- up to SMALL entries: all pairs;
- up to LARGE: the list's own components, one link for each further member;
- beyond: each fingerprint is sent to all points within half the distance;
  those that meet at a point are within the whole distance of each other, and
  any two within it meet at some point. This needs no pairs at all.

Components are found by alternating large-star and small-star rounds, each a
written table of links. Equal fingerprints are one node throughout.

Defined results: null and empty texts have fingerprint zero, linked like any
other; documents of fewer words than a shingle have one shingle of them all;
a null doc_id is never the smallest; rows that are equal are linked as copies;
extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released, materialise, partitions, texts

SEED = 42
SMALL, LARGE = 64, 4096
#: Hashes whose bits are counted at a time.
CHUNK = 1 << 16


def triples() -> list[tuple[int, int, int]]:
    """Triples of eight positions of which any four positions include one: three parts, and two of a part with one of the next."""
    parts = [(0, 1, 2), (3, 4, 5), (6, 7)]
    found = [t for p in parts for t in combinations(p, 3)]
    for p, q in zip(parts, parts[1:] + parts[:1], strict=True):
        found += [tuple(sorted((*two, one))) for two in combinations(p, 2) for one in q]
    return found


TRIPLES = triples()
#: For each set of equal bytes, the first triple within it.
FIRST = np.array([next((j for j, t in enumerate(TRIPLES) if all(m >> p & 1 for p in t)), 99) for m in range(256)], np.int64)


def fingerprint(words: list[bytes], shingle: int = 4, tables: int = 1) -> list[int]:
    """SimHash of the words' shingles, in each of the tables."""
    from xxhash import xxh64_intdigest

    n = len(words)
    if not n:
        return [0] * tables
    text = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(length + 1) - 1
    k = min(shingle, n)
    begins, ends = (end - length)[: n - k + 1].tolist(), end[k - 1 :].tolist()
    hashes = np.array([xxh64_intdigest(text[a:b], SEED) for a, b in zip(begins, ends, strict=True)], np.uint64)
    out = []
    for t in range(tables):
        counts = np.zeros(64, np.int64)
        for a in range(0, len(hashes), CHUNK):
            h = hashes[a : a + CHUNK]
            if t:  # further tables mix the hash again
                h = (h + np.uint64(0x9E3779B97F4A7C15 * t & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ h >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
                h ^= h >> np.uint64(32)
            counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0]))
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, tables: int = 1) -> DataFrame:
    """doc_id, text_hash, prints (array<long>) and node: the fingerprint, or the hash of all the tables'."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found = [fingerprint(t.encode().lower().split(), shingle, tables) for t in texts(batch, 1)]
            signed = np.array(found, np.uint64).reshape(-1).view(np.int64)
            prints = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * tables), pa.array(signed))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), prints], names=["doc_id", "text_hash", "prints"])

    known = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    made = known.mapInArrow(released(run), "doc_id long, text_hash long, prints array<long>")
    return made.withColumn("node", F.get("prints", F.lit(0)) if tables == 1 else F.xxhash64("prints"))


def postings(nodes: DataFrame, tables: int) -> DataFrame:
    """key, node, print: each node in its 20 lists for each table."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            node = batch.column(0).to_numpy()
            prints = batch.column(1).flatten().to_numpy().reshape(len(node), tables)
            for t in range(tables):
                x = np.ascontiguousarray(prints[:, t])
                byte = x.view(np.uint8).reshape(-1, 8).astype(np.int64)
                for j, (a, b, c) in enumerate(TRIPLES):
                    key = (t * len(TRIPLES) + j << 24) + (byte[:, a] << 16 | byte[:, b] << 8 | byte[:, c])
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(x)], names=["key", "node", "print"])

    return nodes.select("node", "prints").mapInArrow(released(run), "key long, node long, print long")


def equal_bytes(x: np.ndarray) -> np.ndarray:
    """Sets of the zero bytes of each value."""
    return np.packbits(x.view(np.uint8).reshape(-1, 8) == 0, axis=1, bitorder="little")[:, 0]


def links_of_lists(key: np.ndarray, node: np.ndarray, prints: np.ndarray, bits: int, small_list: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """Linked nodes of whole lists of up to LARGE entries, sorted by key."""
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([begin, [len(key)]]))
    a, b = [], []
    small = np.repeat((size > 1) & (size <= small_list), size)
    k, n, f = key[small], node[small], prints[small]
    at = np.arange(len(k))
    for lag in range(1, small_list):
        at = at[: max(0, len(k) - lag)] if lag == 1 else at[at + lag < len(k)]
        at = at[k[at] == k[at + lag]]
        if not len(at):
            break
        x = f[at] ^ f[at + lag]
        shared = equal_bytes(x)
        good = (np.bitwise_count(shared) >= 8 - bits) & (FIRST[shared] == (k[at] >> 24) % len(TRIPLES))
        good &= np.bitwise_count(x) <= bits
        a.append(n[at[good]])
        b.append(n[at[good] + lag])
    for i, m in zip(begin[size > small_list].tolist(), size[size > small_list].tolist(), strict=True):
        f, n = prints[i : i + m], node[i : i + m]
        near = np.empty((m, m), bool)
        for r in range(0, m, 256):
            near[r : r + 256] = np.bitwise_count(f[r : r + 256, None] ^ f[None, :]) <= bits
        label = np.arange(m, dtype=np.int32)
        while True:
            lower = np.concatenate([np.where(near[r : r + 256], label, m).min(1) for r in range(0, m, 256)]).astype(np.int32)
            lower = np.minimum(lower, lower[lower])
            if np.array_equal(lower, label):
                break
            label = lower
        further = np.flatnonzero(label != np.arange(m))
        a.append(n[label[further]])
        b.append(n[further])
    return np.concatenate(a or [node[:0]]), np.concatenate(b or [node[:0]])


def links(nodes: DataFrame, tables: int = 1, bits: int = 4, small: int = SMALL, large: int = LARGE) -> DataFrame:
    """a, b: links between nodes whose fingerprints differ in at most bits (even, up to 4) bits in some table.

    Links that follow from others are left out of long lists; components are the same.
    """
    if bits % 2 or bits > 4:
        raise ValueError("bits must be 0, 2 or 4")
    names = ["a", "b", "far"]

    def table(a: np.ndarray, b: np.ndarray, far: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), far, np.int32))], names=names)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        over = None  # the key of a list that is too long
        for batch in source:
            now = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
            if over is not None:
                same = int(np.searchsorted(now[0], over, "right"))
                yield table(now[1][:same], now[2][:same], 1 + (over >> 24) // len(TRIPLES))
                now = [x[same:] for x in now]
                if not len(now[0]):
                    held = now
                    continue
                over = None
            yield from whole(now, cut := int(np.searchsorted(now[0], now[0][-1])))
            held = [x[cut:] for x in now]
            if len(held[0]) > large:
                over = int(held[0][0])
                yield table(held[1], held[2], 1 + (over >> 24) // len(TRIPLES))
                held = [x[:0] for x in held]
        yield from whole(held, len(held[0]))

    def whole(rows: list[np.ndarray], n: int) -> Iterator[pa.RecordBatch]:
        """The links of the first n rows, which are whole lists; the rows of too long ones as far rows."""
        key, node, prints = (x[:n] for x in rows)
        if not n:
            return
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([begin, [n]]))
        long = np.repeat(size > large, size)
        if long.any():
            for k in np.unique(key[long]):
                own = key == k
                yield table(node[own], prints[own], 1 + int(k >> 24) // len(TRIPLES))
            key, node, prints = key[~long], node[~long], prints[~long]
        if len(key):
            a, b = links_of_lists(key, node, prints.view(np.uint64), bits, small)
            if len(a):
                yield table(a, b, 0)

    dealt = postings(nodes, tables).repartition(partitions(nodes), "key").sortWithinPartitions("key")
    # links are far fewer than postings: a few files for all the tasks, not one each
    found = materialise(dealt.mapInArrow(released(run), "a long, b long, far int"), "simhash-links", rows=nodes.count())
    near = found.where("far = 0").select("a", "b")
    far = found.where("far > 0").select(F.col("far").alias("t"), F.col("a").alias("node"), F.col("b").alias("print")).distinct()
    return near.unionByName(meeting(far, bits)) if found.where("far > 0").take(1) else near


def meeting(far: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) of the nodes of (t, node, print) that share a point within bits / 2 of both, to the point's smallest."""
    flips = [0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i, j in combinations(range(64), 2))]
    flips = np.array([x for x in flips if x.bit_count() <= bits // 2], np.uint64)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            t, node, prints = (c.to_numpy() for c in batch.columns)
            for i in range(0, len(t), 256):
                p = (prints[i : i + 256].view(np.uint64)[:, None] ^ flips).ravel().view(np.int64)
                r = len(flips)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(t[i : i + 256], r)), pa.array(p), pa.array(np.repeat(node[i : i + 256], r))], names=["t", "point", "node"])

    points = far.mapInArrow(released(run), "t int, point long, node long")
    lowest = points.groupBy("t", "point").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return points.join(lowest, ["t", "point"]).where("node <> a").select("a", F.col("node").alias("b")).distinct()


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """node, label (the smallest node of its component) of every node with a link (a, b).

    rows is about how many links there are; without it they are written and counted first.
    """

    def measured(e: DataFrame) -> tuple[int, int]:
        h = F.xxhash64("a", "b").cast("decimal(20,0)")
        return e.agg(F.count("*"), F.sum(h)).first()

    if rows is None:
        edges = materialise(edges, "edges")
        rows = edges.count()
    # few links make few files; a file for each shuffle partition and round would be most of the work
    now = materialise(edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where("a <> b").distinct(), "links", rows)
    state = measured(now)
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialise(large, "links", state[0])
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = materialise(small.where("a <> b").distinct(), "links", state[0])
        before, state = state, measured(now)
        if state == before:
            break
    top = now.select(F.col("b").alias("node")).distinct().withColumn("label", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(top)


def labels_of(edges: DataFrame, rows: int, name: str) -> DataFrame:
    """components() of about rows links, written at each step."""
    edges = materialise(edges, f"{name}-edges", rows)
    n = edges.count()
    return materialise(components(edges, n), name, n)


def near_duplicates(docs: DataFrame, shingle: int = 4, tables: int = 1, bits: int = 4) -> DataFrame:
    """One row a document: doc_id, text_hash, prints, component_id and kept.

    component_id is the smallest doc_id of the documents reachable by links;
    kept has the doc_id and text_hash of the document that stands for them.
    """
    n = docs.count()
    known = materialise(fingerprints(docs, shingle, tables), "simhash", n)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "text_hash"))
    nodes = materialise(known.groupBy("node").agg(F.first("prints").alias("prints"), best.alias("best")), "simhash-nodes", n)
    labels = labels_of(links(nodes, tables, bits), n, "simhash-labels")
    labelled = nodes.select("node", "best").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # only components of several nodes need to be joined again
    several = labels.select("label").distinct()
    heads = labelled.join(several, "label", "left_semi").groupBy("label").agg(F.min("best").alias("head"))
    named = labelled.join(heads, "label", "left").select("node", F.coalesce("head", "best").alias("kept"))
    return known.join(named, "node").select(
        "doc_id", "text_hash", "prints", F.col("kept.doc_id").alias("component_id"), F.struct("kept.doc_id", "kept.text_hash").alias("kept")
    )


def without_copies(docs: DataFrame, shingle: int = 5, tables: int = 4, bits: int = 4) -> DataFrame:
    """docs with one document of each component, that with the smallest doc_id (then text hash); of equal rows one stays."""
    found = near_duplicates(docs, shingle, tables, bits)
    # three plain keys, so that the join and the removal of repeats share one exchange of the rows
    keys = ["_null", "_id", "_hash"]

    def keyed(id_: str, hash_: Column) -> list[Column]:
        return [F.col(id_).isNull().alias("_null"), F.coalesce(F.col(id_).cast("long"), F.lit(0)).alias("_id"), hash_.alias("_hash")]

    kept = found.select(*keyed("kept.doc_id", F.col("kept.text_hash"))).distinct()
    rows = docs.select(F.struct("*").alias("_row"), *keyed("doc_id", F.xxhash64("text")))
    return rows.join(kept, keys, "left_semi").dropDuplicates(keys).select("_row.*")
