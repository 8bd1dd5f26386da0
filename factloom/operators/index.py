"""A stored inverted index: staged, published at once, read by bucket of the term."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.events import Epochs
from .search import postings

BUCKETS = 64


def bucket_of(term) -> F.Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class LexicalIndex:
    """Postings (key, term, tf, dl, bucket) in a folder.

    A publication deletes the keys it brings before it adds them, and is seen
    whole or not at all: readers follow the pointer of the last whole epoch.
    Files hold neighbouring buckets in order, so that a look-up reads the row
    groups of its terms' buckets only.
    """

    def __init__(self, spark: SparkSession, root: str, key: str):
        self.spark, self.key, self.epochs = spark, key, Epochs(spark, root)

    def staged(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """The postings of docs (key, text), not yet to be seen."""
        return postings(docs, self.key, text).withColumn("bucket", bucket_of("term"))

    def publish(self, docs: DataFrame, removed: DataFrame | None = None, text: str = "text") -> int:
        """Put docs in place of what the index holds of their keys, without the removed keys; the new epoch."""
        now = self.epochs.current()
        every = self.staged(docs, text)
        if now is not None:
            gone = docs.select(self.key)
            if removed is not None:
                gone = gone.unionByName(removed.select(self.key))
            every = self.epochs.read(now).join(gone.distinct(), self.key, "left_anti").unionByName(every)
        n = 0 if now is None else now + 1
        self.epochs.publish(every.repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term"), n)
        return n

    def look_up(self, terms: list[str], epoch: int | None = None) -> DataFrame:
        """The postings of a stated list of terms."""
        asked = self.spark.createDataFrame([(t,) for t in terms], "term string")
        buckets = sorted(r[0] for r in asked.select(bucket_of("term")).distinct().collect())  # of the stated list
        return self.epochs.read(epoch).where(F.col("bucket").isin(buckets) & F.col("term").isin(list(terms)))
