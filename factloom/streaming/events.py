"""Streams of change events: debounce, deduplicated flushes, epochs, reconciliation by polling, and streaming aggregates."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def debounced(events: DataFrame, time_column: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    """key, start, end, events: runs of events of a key with no gap as long as gap; the same for batches and streams."""
    rows = events.withWatermark(time_column, late) if late else events
    g = rows.groupBy(key, F.session_window(time_column, gap).alias("_w")).agg(F.count("*").alias("events"))
    return g.select(key, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "events")


def debounced_with_cap(events: DataFrame, time_column: str, key: str, gap_s: float, cap_s: float) -> DataFrame:
    """As debounced, but a run is flushed after cap_s seconds too, however busy the key stays. For streams.

    State is the first and last time of the open run and its count; a timer
    flushes it after the gap.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        out = []
        first, last, n = state.get if state.exists else (None, None, 0)

        def flush() -> None:
            nonlocal first, last, n
            out.append((k[0], first / 1000, last / 1000, n))
            first, last, n = None, None, 0

        if state.hasTimedOut:
            flush()
        times = sorted(int(t.timestamp() * 1000) for b in batches for t in b[time_column])
        for t in times:
            if first is not None and (t - last > gap_s * 1000 or t - first >= cap_s * 1000):
                flush()
            first, last, n = (t if first is None else first), t, n + 1
        if first is None:
            state.remove()
        else:
            state.update((first, last, n))
            state.setTimeoutDuration(int(gap_s * 1000))
        if out:
            yield pd.DataFrame(out, columns=[key, "start", "end", "events"])

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, start double, end double, events long", "first long, last long, n long", "append", "ProcessingTimeTimeout"
    )


def windowed(events: DataFrame, time_column: str, length: str, slide: str | None, late: str, by: list[str]) -> DataFrame:
    """Counts and sums of event-time windows; late events are taken up to the watermark."""
    window = F.window(time_column, length, slide) if slide else F.window(time_column, length)
    g = events.withWatermark(time_column, late).groupBy(window.alias("_w"), *by).agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("_w.start").alias("start"), *by, "events", "total")


def flush_batches(events: DataFrame, keys: list[str], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a stream that gives sink each micro-batch with its keys once; a repeated batch has the same id."""

    def put(batch: DataFrame, batch_id: int) -> None:
        sink(batch.dropDuplicates(keys), batch_id)

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


class Epochs:
    """Versions of a table in a folder: epoch=N folders, and a pointer that names the last whole one.

    Publishing writes the folder, then replaces the pointer by a rename; readers
    see the pointer's epoch only. An epoch that was written but not pointed to
    is overwritten by the next attempt. Paths go through the session's file
    system.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> int | None:
        pointers = self.fs.globStatus(self.path(f"{self.root}/CURRENT-*"))
        numbers = [int(p.getPath().getName().split("-")[1]) for p in pointers or []]
        return max(numbers, default=None)

    def publish(self, df: DataFrame, epoch: int) -> None:
        """Idempotent: an epoch at or below the current one is left alone."""
        now = self.current()
        if now is not None and epoch <= now:
            return
        df.write.mode("overwrite").parquet(f"{self.root}/epoch={epoch}")
        out = self.fs.create(self.path(f"{self.root}/.pointer-{epoch}"), True)
        out.write(bytearray(json.dumps({"epoch": epoch, "at": time.time()}).encode()))
        out.close()
        self.fs.rename(self.path(f"{self.root}/.pointer-{epoch}"), self.path(f"{self.root}/CURRENT-{epoch:012d}"))

    def read(self, epoch: int | None = None) -> DataFrame:
        epoch = self.current() if epoch is None else epoch
        if epoch is None:
            raise ValueError("no epoch has been published")
        return self.spark.read.parquet(f"{self.root}/epoch={epoch}")

    def discard_unfinished(self) -> list[int]:
        """Recovery: folders above the pointer go."""
        now, gone = self.current(), []
        for p in self.fs.globStatus(self.path(f"{self.root}/epoch=*")) or []:
            n = int(p.getPath().getName().split("=")[1])
            if now is None or n > now:
                self.fs.delete(p.getPath(), True)
                gone.append(n)
        return sorted(gone)


def polled_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """path, kind of two listings (path, mtime): created, modified, deleted."""
    a, b = before.select("path", F.col("mtime").alias("_a")), now.select("path", F.col("mtime").alias("_b"))
    kind = F.when(F.col("_a").isNull(), "created").when(F.col("_b").isNull(), "deleted").when(F.col("_a") != F.col("_b"), "modified")
    return a.join(b, "path", "full_outer").select("path", kind.alias("kind")).where("kind IS NOT NULL")


def mark_stale(coverage: DataFrame, changed: DataFrame) -> DataFrame:
    """coverage with stale set for changed definitions (target_def_uid)."""
    c = changed.select("target_def_uid", F.lit(True).alias("_c")).distinct()
    return coverage.join(c, "target_def_uid", "left").withColumn("stale", F.col("stale") | F.coalesce("_c", F.lit(False))).drop("_c").select(*coverage.columns)


def widened(changed: DataFrame, dangling: DataFrame) -> DataFrame:
    """file_id: changed files and those whose references dangle."""
    return changed.select("file_id").unionByName(dangling.select("file_id")).distinct()
