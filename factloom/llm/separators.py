"""Token counts of flat, unindexed token files by a scan for the end-of-document id.

The files hold nothing but ids, two or four little-endian bytes each. A task
reads one block of a file and finds the separators with one vector comparison.
Documents that begin and end in the block are counted there; what stands before
the first separator and after the last is left over. A prefix scan over the
blocks of each file adds what earlier blocks left over to the first count, and
gives each block the number of documents before it.

Files are at most FILE_IDS ids long, so the scan over a file's blocks is small.

Defined results: a null text is an empty document, which counts its separator
only; repeated rows are documents of their own; an empty table gives no file;
ids after the last separator of a file make a last, unterminated document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, filesystem, materialise, scratch, texts
from .words import words

#: A file is closed at so many ids; a block has so many.
FILE_IDS, BLOCK_IDS = 1 << 26, 1 << 20

ORDER = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("doc_id", pa.int64()), ("file_ids", pa.int64())])


def write_flat(docs: DataFrame, tokenizer: str, end: int, width: int = 2, file_ids: int = FILE_IDS) -> tuple[str, DataFrame]:
    """Write the ids of every document and end as flat files of width bytes an id.

    Returns the folder and (file, ordinal, doc_id, file_ids): which document is
    the how-many-th of its file, without offsets; and for each file a row with
    its number of ids and no ordinal.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "flat-tokens")
    kind = {2: "<u2", 4: "<u4"}[width]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = filesystem(folder)
        w = words(tokenizer, special=False)  # the separator's string in a text is ordinary text
        if max(w.size - 1, end) >= 1 << 8 * width:
            raise ValueError("the ids need more bytes")
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        out, file, n, number, ordinal = None, "", 0, 0, 0
        tail = np.array([end], kind).tobytes()
        for batch in source:
            found, doc_ids = list(texts(batch, 1)), batch.column(0).to_pylist()
            for k in range(0, len(found), 256):
                rows: list[tuple] = []
                for i, ids in zip(doc_ids[k : k + 256], w.ids(found[k : k + 256]), strict=True):
                    if out is None:
                        file, n, ordinal = f"part-{part:06d}-{number:04d}-{attempt}.flat", 0, 0
                        out = fs.open_output_stream(f"{root}/{file}")
                    out.write(ids.astype(kind).tobytes() + tail)
                    n += len(ids) + 1
                    rows.append((file, ordinal, i, None))
                    ordinal += 1
                    if n >= file_ids:
                        out.close()
                        rows.append((file, None, None, n))
                        out, number = None, number + 1
                yield batches(ORDER, rows)
        if out is not None:
            out.close()
            yield batches(ORDER, [(file, None, None, n)])

    written = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "file string, ordinal long, doc_id long, file_ids long")
    return folder, materialise(written, "flat-order")


BLOCKS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("found", pa.int64()), ("head", pa.int64()), ("tail", pa.int64()), ("inner", pa.list_(pa.int64()))])


def count_tokens(spark: SparkSession, folder: str, files: DataFrame, end: int, width: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """file, ordinal, n_tokens (with the separator) of each document in files (file, file_ids)."""
    kind = {2: "<u2", 4: "<u4"}[width]

    def scan(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for batch in source:
            for file, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{file}") as f:
                    ids = np.frombuffer(f.read_at(block_ids * width, block * block_ids * width), kind)
                at = np.flatnonzero(ids == end)
                head = int(at[0]) + 1 if len(at) else 0
                tail = len(ids) - (int(at[-1]) + 1 if len(at) else 0)
                yield batches(BLOCKS, [(file, block, len(at), head, tail, np.diff(at))])

    blocks = files.select("file", F.explode(F.sequence(F.lit(0), F.floor((F.col("file_ids") - 1) / block_ids))).alias("block"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = blocks.repartition(n, "file", "block").mapInArrow(scan, "file string, block long, found long, head long, tail long, inner array<bigint>")

    upto = Window.partitionBy("file").orderBy("block")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    # ids since the last separator = all tails since the last block that has one
    run = F.coalesce(F.sum(F.when(F.col("found") > 0, 1).otherwise(0)).over(before), F.lit(0))
    stitched = (
        found.withColumn("ordinal", F.coalesce(F.sum("found").over(before), F.lit(0)))
        .withColumn("_run", run)
        .withColumn("_last", F.row_number().over(upto.orderBy(F.col("block").desc())) == 1)
    )
    # a block's tail belongs to the run that begins after its separators
    after = Window.partitionBy("file", "_begins").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = stitched.withColumn("_begins", F.col("_run") + F.when(F.col("found") > 0, 1).otherwise(0)).withColumn("_open", F.sum("tail").over(after))
    carried = carried.withColumn("_carry", F.coalesce(F.lag("_open").over(upto), F.lit(0)))
    first = F.when(F.col("found") > 0, F.array(F.col("_carry") + F.col("head"))).otherwise(F.array().cast("array<bigint>"))
    last = F.when(F.col("_last") & (F.col("_open") > 0), F.array(F.col("_open"))).otherwise(F.array().cast("array<bigint>"))
    counts = carried.withColumn("_counts", F.concat(first, F.when(F.col("found") > 0, F.col("inner")).otherwise(F.array().cast("array<bigint>")), last))
    return counts.select("file", "ordinal", F.posexplode("_counts").alias("_k", "n_tokens")).select(
        "file", (F.col("ordinal") + F.col("_k")).cast("long").alias("ordinal"), F.col("n_tokens").cast("long")
    )


def document_token_counts(docs: DataFrame, tokenizer: str, end: int, width: int = 2) -> DataFrame:
    """doc_id, file, ordinal, n_tokens: writes the flat files, scans them, and names the documents again."""
    spark = docs.sparkSession
    folder, order = write_flat(docs, tokenizer, end, width)
    files = order.where("ordinal IS NULL").select("file", "file_ids")
    counts = count_tokens(spark, folder, files, end, width)
    # the written order compresses so well that its size misleads the planner into a broadcast
    return order.where("ordinal IS NOT NULL").select("file", "ordinal", "doc_id").hint("merge").join(counts, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "n_tokens")
