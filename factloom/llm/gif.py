"""GIF media columns: LZW code streams, palettes, disposal, transparency, timed frames and colour histograms.

decode() reads any GIF87a or GIF89a: it parses the blocks, decodes each frame's
LZW codes, applies the frame's or the global palette, keeps transparent pixels
of the canvas, and follows each frame's disposal before the next is drawn.

LZW codes between two clear codes have known widths, so they are cut out of the
stream with one numpy step, and a code's string is a copy of the output where
the code before its entry began, one longer; chains of copies are followed by
pointer doubling, so decoding loops over no single pixel; encoding takes one step
of Python for each byte.

encode() writes losslessly 8-bit samples as grey frames of one screen width.

Defined results: a null media gives no frame; a truncated or damaged one raises
ValueError; the empty text is stored as one row of spaces; equal texts give
equal bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, texts

GREY = bytes(v for i in range(256) for v in (i, i, i))
WIDTH = 192
#: Rows of a full frame, and the time it is shown, in hundredths of a second.
ROWS, DELAY = 320, 4
MAX_CODE = 4096


@lru_cache(64)
def widths(n: int, bits: int) -> np.ndarray:
    """Widths of n codes after a clear code: the second and later ones each find an entry more in the table."""
    following = np.minimum((1 << bits) + 2 + np.maximum(np.arange(n) - 1, 0), MAX_CODE - 1)
    return np.maximum(bits + 1, np.floor(np.log2(following)).astype(np.int64) + 1)


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """The GIF form of LZW: codes of growing width, low bits first; the table is cleared when it is full."""
    clear, end = 1 << bits, (1 << bits) + 1
    codes: list[int] = []
    lengths: list[int] = []  # of the runs of codes between clear codes, with the closing one
    table: dict[int, int] = {}
    get, emit = table.get, codes.append
    following, begun = end + 1, 0
    prefix = data[0]
    for c in data[1:]:
        key = prefix << 8 | c
        code = get(key)
        if code is None:
            emit(prefix)
            table[key] = following
            following += 1
            if following == MAX_CODE:
                emit(clear)
                lengths.append(len(codes) - begun)
                begun = len(codes)
                table.clear()
                following = end + 1
            prefix = c
        else:
            prefix = code
    emit(prefix)
    emit(end)
    lengths.append(len(codes) - begun)
    values = np.array([clear, *codes], np.int64)
    wide = np.concatenate([[bits + 1], *[widths(n, bits) for n in lengths]])
    raised = (values[:, None] >> np.arange(12)) & 1
    return np.packbits(raised[np.arange(12) < wide[:, None]].astype(np.uint8), bitorder="little").tobytes()


def lzw_decode(data: bytes, bits: int) -> bytes:
    """All samples of a code stream."""
    clear, end = 1 << bits, (1 << bits) + 1
    held = np.frombuffer(data + b"\0\0\0\0", np.uint8)
    total, at = 8 * len(data), 0
    out: list[np.ndarray] = []
    first = True
    while True:
        n = 4100 if not first else 1
        while True:
            wide = widths(n, bits)
            ends = at + np.cumsum(wide)
            fit = int(np.searchsorted(ends, total, "right"))
            offset = ends[:fit] - wide[:fit]
            byte = offset >> 3
            raw = held[byte].astype(np.int64) | held[byte + 1].astype(np.int64) << 8 | held[byte + 2].astype(np.int64) << 16
            codes = raw >> (offset & 7) & ((1 << wide[:fit]) - 1)
            stop = np.flatnonzero((codes == clear) | (codes == end))
            if len(stop) or fit < n:
                break
            n *= 2
        m = int(stop[0]) if len(stop) else fit
        if m:
            out.append(expand(codes[:m], bits))
        if not len(stop) or codes[m] == end:
            break
        at, first = int(ends[m]), False
    return np.concatenate(out).tobytes() if out else b""


def expand(codes: np.ndarray, bits: int) -> np.ndarray:
    """The samples of the codes between two clear codes.

    Entry k is the string of code k and the first sample of code k + 1, which
    stand side by side in the output.
    """
    n, entry = len(codes), (1 << bits) + 2
    place = np.arange(n)
    copied = codes >= entry
    origin = np.where(copied, codes - entry, place)
    if (origin[copied] >= place[copied]).any():
        raise ValueError("a code stands before its entry")
    length, link = copied.astype(np.int64), origin.copy()
    while True:
        more = length[link]
        if not more.any():
            break
        length, link = length + more, link[link]
    length += 1
    begin = np.cumsum(length) - length
    total = int(begin[-1] + length[-1])
    source = np.arange(total) + np.repeat(begin[origin] - begin, length)
    literal = np.zeros(total, np.uint8)
    literal[begin[~copied]] = codes[~copied]
    while True:
        further = source[source]
        if np.array_equal(further, source):
            return literal[source]
        source = further


def blocks_of(data: bytes) -> bytes:
    return b"".join(bytes([len(x)]) + x for x in (data[k : k + 255] for k in range(0, len(data), 255))) + b"\0"


def encode(samples: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """A GIF of 8-bit grey samples: frames of up to rows rows of width samples, each drawn over the last."""
    if not samples or len(samples) % width:
        raise ValueError("a positive multiple of the width is needed")
    height = len(samples) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(height, rows), 0xF7, 0, 0), GREY]
    for top in range(0, height, rows):
        n = min(rows, height - top)
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, delay, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, width, n, 0), b"\x08"]
        out.append(blocks_of(lzw_encode(samples[top * width : (top + n) * width])))
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    """A frame as shown: its rectangle, its time, and the whole canvas in RGBA."""

    index: int
    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    canvas: np.ndarray

    def drawn(self) -> np.ndarray:
        return self.canvas[self.top : self.top + self.height, self.left : self.left + self.width]

    def histogram(self, bins: int = 16) -> np.ndarray:
        """Counts of the opaque pixels' red, green and blue in equal bins."""
        seen = self.canvas[self.canvas[..., 3] > 0][:, :3].astype(np.int64) * bins >> 8
        return np.bincount((seen + np.arange(3) * bins).ravel(), minlength=3 * bins)


def decode(media: bytes) -> Iterator[Frame]:
    """The frames of a GIF in turn."""
    if media[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    try:
        yield from _decode(media)
    except (IndexError, struct.error) as e:
        raise ValueError("the GIF is damaged") from e


def _decode(media: bytes) -> Iterator[Frame]:
    screen_w, screen_h, flags, _, _ = struct.unpack_from("<HHBBB", media, 6)
    at = 13

    def palette(flags: int) -> np.ndarray | None:
        nonlocal at
        if not flags & 0x80:
            return None
        n = 2 << (flags & 7)
        rgb = np.frombuffer(media[at : at + 3 * n], np.uint8).reshape(n, 3)
        at += 3 * n
        return np.concatenate([rgb, np.full((n, 1), 255, np.uint8)], 1)

    def joined() -> bytes:
        nonlocal at
        parts = []
        while n := media[at]:
            parts.append(media[at + 1 : at + 1 + n])
            at += n + 1
        at += 1
        return b"".join(parts)

    shared = palette(flags)
    canvas = np.zeros((screen_h, screen_w, 4), np.uint8)
    index, delay, disposal, clear = 0, 0, 0, None
    while True:
        kind = media[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = media[at]
            at += 1
            body = joined()
            if label == 0xF9:
                packed, delay, clear = struct.unpack_from("<BHB", body)
                disposal, clear = packed >> 2 & 7, clear if packed & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", media, at)
        at += 9
        own = palette(flags)
        colours = own if own is not None else shared
        if colours is None:
            raise ValueError("a frame without palette")
        bits = media[at]
        at += 1
        samples = np.frombuffer(lzw_decode(joined(), bits), np.uint8)[: w * h]
        if len(samples) < w * h:
            raise ValueError("a frame ends early")
        samples = samples.reshape(h, w)
        if flags & 0x40:
            rows = np.concatenate([np.arange(h)[a::b] for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            samples, stored = np.empty_like(samples), samples
            samples[rows] = stored
        saved = canvas.copy() if disposal == 3 else None
        part = canvas[top : top + h, left : left + w]
        samples = samples[: part.shape[0], : part.shape[1]]
        shown = colours[samples]
        if clear is None:
            part[...] = shown
        else:
            part[...] = np.where((samples == clear)[..., None], part, shown)
        yield Frame(index, left, top, part.shape[1], part.shape[0], delay * 10, disposal, canvas.copy())
        if disposal == 2:
            part[...] = 0
        elif disposal == 3:
            canvas[...] = saved
        index, delay, disposal, clear = index + 1, 0, 0, None


def payload_of(text: str) -> tuple[int, bytes]:
    """Bytes of the text in UTF-8, and it with spaces up to a positive multiple of the width."""
    raw = text.encode()
    return len(raw), raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b" ")


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media of each text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows, size = [], 0
            for i, text in zip(batch.column(0).to_pylist(), texts(batch, 1), strict=True):
                n, payload = payload_of(text)
                rows.append((i, n, encode(payload)))
                size += len(rows[-1][2])
                if size > 8 << 20:
                    yield batches(schema, rows)
                    rows, size = [], 0
            yield batches(schema, rows)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


FRAMES = "id long, frame int, left int, top int, width int, height int, delay_ms int, disposal int, histogram array<int>, rgba binary"


def frames(media: DataFrame, id_column: str = "doc_id", media_column: str = "media") -> DataFrame:
    """One row a frame: place, size, time, disposal, the canvas's 3 x 16 colour histogram and its RGBA bytes."""
    schema = pa.schema([("id", pa.int64()), *[(k, pa.int32()) for k in ("frame", "left", "top", "width", "height", "delay_ms", "disposal")], ("histogram", pa.list_(pa.int32())), ("rgba", pa.binary())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for i, m in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for f in decode(m.as_py()) if m.is_valid else ():
                    yield batches(schema, [(i, f.index, f.left, f.top, f.width, f.height, f.delay_ms, f.disposal, f.histogram().tolist(), f.canvas.tobytes())])

    return media.select(F.col(id_column).cast("long"), media_column).mapInArrow(run, FRAMES)


def media_digests(media: DataFrame) -> DataFrame:
    """Digests and features of a table with doc_id, n_bytes and media, from the decoded frames."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
    ])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = []
            for i, n, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                m = m.as_py()
                size, tail, digest, shown, time = 0, b"", hashlib.sha256(), np.zeros(48, np.int64), 0
                for f in decode(m):
                    samples = f.drawn()[..., 0].tobytes()
                    digest.update(samples)
                    size, tail, time = size + len(samples), (tail + samples)[-16:], time + f.delay_ms
                    shown += f.histogram()
                rows.append((i, n, size, digest.hexdigest(), zlib.crc32(tail), len(m), hashlib.sha256(m).hexdigest(), f"{time}:" + ",".join(map(str, shown.tolist()))))
            yield batches(schema, rows)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
