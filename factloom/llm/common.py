"""What the operators share: scratch tables and files in the folder that all executors see, and small helpers."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than the six ASCII spaces.
WORD = r"[^\x20\x09-\x0D]+"
#: Narrow rows to a file where a table's file count is chosen by its rows.
ROWS_A_FILE = 100_000


def shared_root(spark: SparkSession) -> str:
    """URI of the folder named by spark.checkpoint.dir.

    Where the session names none, a local master gets a folder of its own and
    a cluster uses the warehouse, never a machine-local temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if re.match(r"local(\[|$)", spark.sparkContext.master):
            root = tempfile.mkdtemp(prefix="factloom-")
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    return root if "://" in root or root.startswith("file:") else f"file://{root}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh URI under the shared folder; it goes when the driver's JVM ends."""
    uri = f"{shared_root(spark).rstrip('/')}/factloom/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return uri


def materialise(df: DataFrame, name: str, rows: int | None = None, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives lost executors.

    rows, if given, is about how many narrow rows there are: they are then dealt
    to as many files as that needs, since a small file costs more than its rows.
    """
    spark = df.sparkSession
    uri = scratch(spark, name) + "/table"
    if rows is not None:
        df = df.repartition(rows // ROWS_A_FILE + 1)
    # zstd's first level is two or three times as fast as the default for a tenth more bytes
    df.write.option("compression", compression).option("parquet.compression.codec.zstd.level", 1).parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)


#: What this Python worker has learnt and another operator doesn't need: cleared where one begins.
LEARNT: list[dict] = []


def released(run: Callable, keep: bool = False) -> Callable:
    """run, a function for mapInArrow, that begins without what other operators have learnt (or keeps it) and gives free memory back at its end."""

    def held(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in () if keep else LEARNT:
            x.clear()
        yield from run(source)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # the allocator of glibc alone can be asked
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return held


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI of the shared folder, on the driver or an executor."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", uri)
    return fs.FileSystem.from_uri(uri)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def batches(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    """Rows as one record batch."""
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def texts(batch: pa.RecordBatch, column: int | str = "text") -> Iterator[str]:
    """The batch's texts one at a time; null is the empty text."""
    for x in batch.column(column):
        yield x.as_py() or ""


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def rank_globally(df: DataFrame, keys: list[Column], into: str, name: str) -> DataFrame:
    """Adds the row's place, from 0, in the order of keys, without gathering the rows in one task.

    Rows are dealt by range and written; each range's count (one row a range)
    gives the place at which it begins.
    """
    spread = materialise(df.repartitionByRange(partitions(df), *keys).withColumn("_part", F.spark_partition_id()), name)
    from pyspark.sql import Window

    begins = spread.groupBy("_part").agg(F.count("*").alias("_n")).withColumn(
        "_begin", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return (
        spread.withColumn("_local", local)
        .join(F.broadcast(begins.select("_part", "_begin")), "_part")
        .withColumn(into, (F.col("_begin") + F.col("_local") - 1).cast("long"))
        .drop("_part", "_local", "_begin")
    )
