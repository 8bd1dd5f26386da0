"""WARC archives of pages and a two-level capture index.

Archives are WARC/1.1 files whose records are gzip members of their own. Of
pages with equal payloads of at least REVISIT_BYTES bytes, the one with the
largest page_id is a response and the others are revisits (identical payload
digest), which hold its HTTP head but no payload. Smaller pages are all
responses.

The index's first level is lines of captures, sorted by reversed-host URL key
and dealt by range over index files, in compressed blocks of BLOCK_LINES lines.
The second is a sparse directory of each file: the first key, offset and length
of each block, plus one line a file in the manifest. A look-up searches the
manifest's keys and the directory's by bisection, reads the one range of the
block or blocks that can hold the key, and then the range of the record.

Files are written through a pyarrow file system of the shared folder, under
names of the attempt's own; only files in a manifest are read.

Defined results: a null html is an empty payload; a null url has the empty key;
equal URLs and repeated rows are captures of their own; a null page_id never
makes another page its revisit and is written as a response; an empty table
gives no file; extra columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, filesystem, materialise, scratch

REVISIT_BYTES = 1000
BLOCK_LINES = 1000
#: An archive is closed at so many bytes.
ARCHIVE_BYTES = 256 << 20
#: Tables of copied digests of up to so many rows (28 bytes each) are broadcast; larger ones are joined by shuffle.
BROADCAST_DIGESTS = 500_000
#: Index files a look-up may search; the manifest that every task gets has one line each.
INDEX_FILES = 4096
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """Reversed-host form of a URL, in lower case: com,example,www)/path?query."""
    if not url:
        return ""
    try:
        s = urlsplit(url.strip())
        host, port = (s.hostname or "").rstrip("."), s.port
    except ValueError:
        return url.lower()
    key = ",".join(reversed(host.split(".")))
    if port and (s.scheme, port) not in (("http", 80), ("https", 443)):
        key += f":{port}"
    return (key + ")" + (s.path or "/") + (f"?{s.query}" if s.query else "")).lower()


def payload() -> Column:
    return F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")


def decisions(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with _digest and refers_to, which is null for responses."""
    known = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha1(payload()).alias("_digest"))
    n = F.octet_length(F.coalesce(F.col("html"), F.lit("")))
    large = known.where((n >= REVISIT_BYTES) & F.col("page_id").isNotNull())
    copies = large.groupBy("_digest").agg(F.max("page_id").alias("_kept"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    copies = materialise(copies, "warc-copies")
    side = F.broadcast(copies) if copies.count() <= BROADCAST_DIGESTS else copies
    joined = known.join(side, "_digest", "left")
    return joined.withColumn("refers_to", F.when((F.col("page_id") != F.col("_kept")), F.col("_kept"))).drop("_kept")


def record(kind: str, page_id: int | None, url: str, digest: str, head: bytes, body: bytes, refers: int | None) -> bytes:
    block = head + body
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', '', url)}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


CAPTURES = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
CAPTURE_DDL = "key string, page_id long, file string, offset long, length long"


def write_archives(pages: DataFrame) -> tuple[str, DataFrame]:
    """Write one record a page; returns the folder and the captures: key, page_id, file, offset, length."""
    folder = scratch(pages.sparkSession, "warc")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = filesystem(folder)
        part, attempt, number = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], 0
        out, file, at = None, "", 0
        for batch in source:
            rows = []
            ids, urls, digests, refers = (batch.column(k).to_pylist() for k in ("page_id", "url", "_digest", "refers_to"))
            for page_id, url, html, digest, refer in zip(ids, urls, batch.column("html"), digests, refers, strict=True):
                body = (html.as_py() or "").encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                kind = "response" if refer is None else "revisit"
                packed = gzip.compress(record(kind, page_id, url or "", digest, head, body if refer is None else b"", refer), 3, mtime=0)
                if out is None:
                    file, at = f"part-{part:06d}-{number:04d}-{attempt}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{file}", compression=None)
                out.write(packed)
                rows.append((url_key(url), page_id, file, at, len(packed)))
                at += len(packed)
                if at >= ARCHIVE_BYTES:
                    out.close()
                    out, number = None, number + 1
            yield batches(CAPTURES, rows)
        if out is not None:
            out.close()

    written = decisions(pages).select("page_id", "url", "html", "_digest", "refers_to").mapInArrow(run, CAPTURE_DDL)
    return folder, materialise(written, "warc-captures")


INDEX = pa.schema([("part", pa.int32()), ("file", pa.string()), ("first", pa.string()), ("directory", pa.int64()), ("size", pa.int64()), ("lines", pa.int64())])


def write_index(captures: DataFrame, block_lines: int = BLOCK_LINES) -> tuple[str, DataFrame]:
    """Write the index files; returns the folder and one row a file: its first key and where its directory begins."""
    spark = captures.sparkSession
    folder = scratch(spark, "warc-index")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = filesystem(folder)
        part, file = TaskContext.get().partitionId(), f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.cdx"
        out, at, n, directory, held = None, 0, 0, [], []

        def flush() -> None:
            nonlocal at, held
            block = zlib.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in held).encode(), 6)
            directory.append((held[0][0], at, len(block)))
            out.write(block)
            at, held = at + len(block), []

        for batch in source:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = fs.open_output_stream(f"{root}/{file}")
                held.append(row)
                n += 1
                if len(held) >= block_lines:
                    flush()
        if out is not None:
            if held:
                flush()
            tail = zlib.compress(json.dumps(directory, ensure_ascii=False).encode())
            out.write(tail)
            out.close()
            yield batches(INDEX, [(part, file, directory[0][0], at, len(tail), n)])

    order = [F.col("key"), F.col("page_id"), F.col("file"), F.col("offset")]
    n = min(INDEX_FILES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = captures.select("key", "page_id", "file", "offset", "length").repartitionByRange(n, *order).sortWithinPartitions(*order)
    written = dealt.mapInArrow(run, "part int, file string, first string, directory long, size long, lines long")
    return folder, materialise(written, "warc-index-files")


UNITS = pa.schema([("key", pa.string()), ("file", pa.int32()), ("block", pa.int32())])
#: Blocks that are dealt to one task together.
NEIGHBOURS = 16


class CaptureIndex:
    """Look-ups in the index files; holds the directories of the file last used and the block last read."""

    def __init__(self, folder: str, manifest: list[tuple[str, str, int, int]]):
        """manifest: (first key, file, where the directory begins, its size), sorted."""
        self.fs, self.root = filesystem(folder)
        self.manifest = manifest
        self.firsts = [m[0] for m in manifest]
        self.held: dict[int, tuple[list, list[str]]] = {}
        self.block: tuple[tuple[int, int], list] = ((-1, -1), [])

    def ranged(self, file: str, at: int, n: int) -> bytes:
        with self.fs.open_input_file(f"{self.root}/{file}") as f:
            return f.read_at(n, at)

    def directory(self, i: int) -> tuple[list, list[str]]:
        if i not in self.held:
            _, file, at, n = self.manifest[i]
            entries = json.loads(zlib.decompress(self.ranged(file, at, n)))
            self.held = {i: (entries, [e[0] for e in entries])}
        return self.held[i]

    def lines(self, i: int, k: int) -> list:
        if self.block[0] != (i, k):
            _, at, n = self.directory(i)[0][k]
            self.block = (i, k), [json.loads(x) for x in zlib.decompress(self.ranged(self.manifest[i][1], at, n)).decode().split("\n")]
        return self.block[1]

    def blocks(self, key: str) -> Iterator[tuple[int, int]]:
        """(file, block) of the blocks that a key's captures may stand in, from the directories alone."""
        i = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while i < len(self.manifest) and self.firsts[i] <= key:
            entries, firsts = self.directory(i)
            k = max(0, bisect.bisect_left(firsts, key) - 1)
            while k < len(entries) and firsts[k] <= key:
                yield i, k
                k += 1
            i += 1

    def in_block(self, key: str, i: int, k: int) -> list:
        """A key's captures in a block: [key, page_id, file, offset, length]."""
        lines = self.lines(i, k)
        a = bisect.bisect_left(lines, key, key=lambda x: x[0])
        return lines[a : bisect.bisect_right(lines, key, lo=a, key=lambda x: x[0])]


def look_up(spark: SparkSession, folder: str, manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """The captures of a table of distinct keys (column key).

    The directories name the blocks to read, and the blocks are dealt out, so
    that a key with very many captures isn't one task's.
    """
    # bounded: write_index makes at most INDEX_FILES files
    rows = sorted((r["first"], r["file"], r["directory"], r["size"]) for r in manifest.limit(INDEX_FILES + 1).collect())

    def find(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CaptureIndex(folder, rows)
        for batch in source:
            found: list = []
            for key in batch.column(0).to_pylist():
                for i, k in index.blocks(key):
                    found.append((key, i, k))
                    if len(found) >= 10_000:
                        yield batches(UNITS, found)
                        found = []
            yield batches(UNITS, found)

    def read(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CaptureIndex(folder, rows)
        for batch in source:
            found: list = []
            for key, i, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found += index.in_block(key, i, k)
                if len(found) >= 10_000:
                    yield batches(CAPTURES, found)
                    found = []
            yield batches(CAPTURES, found)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    units = keys.select("key").repartitionByRange(n, "key").sortWithinPartitions("key").mapInArrow(find, "key string, file int, block int")
    # blocks that follow one another stay together, so that a directory is read once for them
    dealt = units.repartition(n, "file", (F.col("block") / NEIGHBOURS).cast("int")).sortWithinPartitions("file", "block", "key")
    return dealt.mapInArrow(read, CAPTURE_DDL)


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record's gzip member."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    block = rest[: int(warc["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return warc, dict(x.split(": ", 1) for x in http.decode("latin-1").split("\r\n")[1:]), body


RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
#: Neighbouring records with gaps of up to so many bytes are read in one range of up to so many.
GAP, RANGE = 1 << 16, 8 << 20


def read_records(spark: SparkSession, folder: str, captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read from the archives by range.

    A response's digest is computed from the payload read and must equal its
    header's; a revisit's size and digest are the headers'.
    """

    def row(raw: bytes) -> tuple:
        warc, http, body = parse(raw)
        digest = base64.b32decode(warc["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        page, refers = (re.search(r"<urn:page:(\d*|-\d+)>", warc.get(k, "<urn:page:>"))[1] for k in ("WARC-Record-ID", "WARC-Refers-To"))
        if warc["WARC-Type"] == "response" and (hashlib.sha1(body).hexdigest() != digest or len(body) != int(http["Content-Length"])):
            raise ValueError(f"the payload of page {page} is damaged")
        return int(page) if page else None, int(http["Content-Length"]), digest, warc["WARC-Type"], int(refers) if refers else None

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for batch in source:
            wanted = zip(*(batch.column(k).to_pylist() for k in ("file", "offset", "length")), strict=True)
            for file, group in groupby(wanted, lambda x: x[0]):
                spans: list[list[tuple[int, int]]] = []
                for _, at, n in group:
                    if spans and at - sum(spans[-1][-1]) <= GAP and at + n - spans[-1][0][0] <= RANGE:
                        spans[-1].append((at, n))
                    else:
                        spans.append([(at, n)])
                with fs.open_input_file(f"{root}/{file}") as f:
                    for span in spans:
                        begin = span[0][0]
                        data = f.read_at(max(a + n for a, n in span) - begin, begin)
                        yield batches(RECORDS, [row(data[a - begin : a - begin + n]) for a, n in span])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # neighbours stay together: a file is cut into stretches, which are dealt out
    stretch = (F.col("offset") / (8 << 20)).cast("long")
    dealt = captures.select("file", "offset", "length").repartition(n, "file", stretch).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write the archives and their index, look every page's URL up in it, and read the records found."""
    spark = pages.sparkSession
    folder, captures = write_archives(pages)
    index, manifest = write_index(captures, block_lines)
    keys = captures.select("key").distinct()
    return read_records(spark, folder, look_up(spark, index, manifest, keys))
