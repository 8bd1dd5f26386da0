"""Token ids in binary files: frequency-ranked ids in byte-aligned variable-length coding.

The folder holds one table, ranks.tbl: the token id of each rank as uint32, the
most frequent id of the whole corpus first (ties by id). A token file holds the
documents of a range of doc_id, ascending, in blocks:

    magic b"FLTOK2\0\0", then for each block:
    uint32 documents, uint32 ids, uint32 bytes of data
    int64 doc_id for each document, uint32 ids of each document
    control bytes: two bits for each id, four to a byte, lowest first: bytes of its rank less one
    data bytes: the ranks, little-endian, in one to four bytes

All integers are little-endian. The texts are tokenised once, into a table of
ids; one pass over it counts the ids (a table bounded by the vocabulary), and
the ids, not the texts, are dealt out by doc_id. Decoding looks each control
byte up in a table of four lengths, adds them up to places, and gathers the
data bytes at those places.

Files are written through a pyarrow file system of the shared folder, under a
name of the attempt's own; only the files named in the returned manifest count,
so a task that runs twice leaves at most an unread file.

Defined results: a null text is empty and gets the end id only; a null doc_id
comes last and is read back as null; rows with equal doc_id are all kept, in
the order of a hash of their ids, and need not meet in one task; an empty table
gives no token file; extra columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, filesystem, materialise, scratch, texts
from .words import words

MAGIC, RANKS = b"FLTOK2\0\0", "ranks.tbl"
#: A block is closed at so many ids, a file at so many bytes.
BLOCK_IDS, FILE_BYTES = 1 << 20, 128 << 20
NULL_ID = -(1 << 63)
HEAD = struct.Struct("<3I")
#: For each control byte, the lengths of its four ids.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64) + 1


def encode_block(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, rank_of: np.ndarray) -> bytes:
    n = len(ids)
    ranks = rank_of[ids]
    length = np.ones(n, np.uint8)
    for k in (1, 2, 3):
        length += ranks >= 1 << 8 * k
    begin = np.cumsum(length, dtype=np.int64) - length
    data = np.empty(int(length.sum(dtype=np.int64)), np.uint8)
    data[begin] = ranks.astype(np.uint8)
    for k in (1, 2, 3):
        more = np.flatnonzero(length > k)
        if not len(more):
            break
        data[begin[more] + k] = (ranks[more] >> np.uint32(8 * k)).astype(np.uint8)
    codes = np.zeros(-(-n // 4) * 4, np.uint8)
    codes[:n] = length - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    return b"".join([HEAD.pack(len(doc_ids), n, len(data)), doc_ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), control.tobytes(), data.tobytes()])


def decode_ids(n: int, control: np.ndarray, data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The ids of a block by table lookup."""
    length = LENGTHS[control].ravel()[:n]
    at = np.cumsum(length) - length
    held = np.concatenate([data, np.zeros(3, np.uint8)])
    rank = held[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(length > k)
        if not len(more):
            break
        rank[more] |= held[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return table[rank]


def read_blocks(f, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, ids of each document, ids) for each block of an open file."""
    if f.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    while head := f.read(HEAD.size):
        docs, n, size = HEAD.unpack(head)
        doc_ids = np.frombuffer(f.read(8 * docs), "<i8")
        counts = np.frombuffer(f.read(4 * docs), "<u4")
        control = np.frombuffer(f.read(-(-n // 4)), np.uint8)
        data = np.frombuffer(f.read(size), np.uint8)
        yield doc_ids, counts, decode_ids(n, control, data, table)


def binaries(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All the ids of a column of binaries, and how many each row has."""
    wide = {pa.binary(): np.int32, pa.large_binary(): np.int64}[column.type]
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, wide)
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return np.ascontiguousarray(flat).view(kind), np.diff(ends) // np.dtype(kind).itemsize


def tokenised(docs: DataFrame, tokenizer: str, end: int) -> tuple[DataFrame, str]:
    """A written table (doc_id, tie, ids) of little-endian ids, end last, and their hash; and the kind of its integers."""
    from xxhash import xxh64_intdigest

    kind = "<u2" if max(words(tokenizer).size - 1, end) < 1 << 16 else "<u4"

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = words(tokenizer)
        tail = np.array([end], kind).tobytes()
        for batch in source:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = [x.astype(kind).tobytes() + tail for x in w.ids(list(texts(part, 1)))]
                tie = np.array([xxh64_intdigest(x) for x in ids], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tie), pa.array(ids, pa.binary())], names=["doc_id", "tie", "ids"])

    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, tie long, ids binary")
    return materialise(made, "token-ids", compression="zstd"), kind


def frequency_ranks(ids: DataFrame, kind: str, size: int) -> np.ndarray:
    """The token id of each rank, the most frequent first."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in source:
            flat, _ = binaries(batch.column(0), kind)
            total += np.bincount(flat, minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["id", "n"])

    # at most as many rows as the vocabulary has entries
    found = ids.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size, np.int64)
    counts[found["id"].to_numpy(int)] = found["n"].to_numpy()
    return np.argsort(-counts, kind="stable").astype("<u4")


def rank_table(fs, root: str) -> np.ndarray:
    with fs.open_input_stream(f"{root}/{RANKS}") as f:
        return np.frombuffer(f.read(), "<u4")


MANIFEST = pa.schema([("part", pa.int32()), ("file", pa.string()), ("number", pa.int32()), ("documents", pa.int64()), ("ids", pa.int64())])


def write_token_files(docs: DataFrame, tokenizer: str, end: int, name: str = "token-files", block_ids: int = BLOCK_IDS, file_bytes: int = FILE_BYTES) -> tuple[str, DataFrame]:
    """Write the documents' ids, each followed by end, in ascending doc_id order.

    Returns the folder and its manifest: part, file, number (of the file in its
    part), documents, ids.
    """
    spark = docs.sparkSession
    folder = scratch(spark, name)
    ids, kind = tokenised(docs, tokenizer, end)
    table = frequency_ranks(ids, kind, max(words(tokenizer).size, end + 1))
    fs, root = filesystem(folder)
    with fs.open_output_stream(f"{root}/{RANKS}") as f:
        f.write(table.tobytes())

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = filesystem(folder)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        out, file, made, number, total, documents = None, "", 0, 0, 0, 0
        rows: list[tuple] = []
        rank_of: np.ndarray | None = None

        def close() -> None:
            nonlocal out, number
            if out is not None:
                out.close()
                rows.append((part, file, number, documents, total))
                out, number = None, number + 1

        for batch in source:
            if rank_of is None:
                table = rank_table(fs, root)
                rank_of = np.empty(len(table), "<u4")
                rank_of[table] = np.arange(len(table))
            flat, counts = binaries(batch.column(2), kind)
            doc_ids = batch.column(0).fill_null(NULL_ID).to_numpy()
            ends = np.cumsum(counts, dtype=np.int64)
            a = 0
            while a < len(counts):
                before = int(ends[a] - counts[a])
                b = max(a + 1, int(np.searchsorted(ends, before + block_ids, "right")))
                if out is None:
                    file, made, total, documents = f"part-{part:06d}-{number:04d}-{attempt}.tok", 0, 0, 0
                    out = fs.open_output_stream(f"{root}/{file}")
                    out.write(MAGIC)
                block = encode_block(doc_ids[a:b], counts[a:b], flat[before : int(ends[b - 1])], rank_of)
                out.write(block)
                made, total, documents = made + len(block), total + int(ends[b - 1]) - before, documents + b - a
                if made >= file_bytes:
                    close()
                a = b
        close()
        if rows:
            yield batches(MANIFEST, rows)

    order = [F.col("doc_id").asc_nulls_last(), F.col("tie")]
    dealt = ids.repartitionByRange(*order).sortWithinPartitions(*order, "ids")
    manifest = dealt.mapInArrow(run, "part int, file string, number int, documents long, ids long")
    return folder, materialise(manifest.repartition(1), "token-manifest")  # one row a file


def with_starts(manifest: DataFrame) -> DataFrame:
    """Adds start: the ids in all files before. One row a file goes through the window."""
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files of the manifest."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        table = None
        for batch in source:
            table = rank_table(fs, root) if table is None else table
            for file, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = begin
                with fs.open_input_stream(f"{root}/{file}") as f:
                    for doc_ids, counts, ids in read_blocks(f, table):
                        ends = np.cumsum(counts, dtype=np.int64)
                        starts = ends - counts
                        raw = memoryview(ids.astype("<u4").tobytes())
                        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(doc_ids, pa.int64(), mask=doc_ids == NULL_ID), pa.array(starts + at), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64()),
                        ], schema=schema)
                        at += int(ends[-1])

    files = with_starts(manifest).select("file", "start")
    n = max(1, min(manifest.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return files.repartition(n, "file").mapInArrow(run, READ)
