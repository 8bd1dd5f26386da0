"""Encoding and decoding with a merge-type SentencePiece vocabulary.

Encoding keeps an agenda of adjacent symbol pairs that form a piece, ordered by
score, then from the left; the best pair is merged and the pairs on either side
enter the agenda, until it is empty. What is left outside the vocabulary falls
back to byte pieces, or to the unknown id where the vocabulary has none. A long
segment has its agenda in a heap. Short ones are merged many at a time: the
agenda is a row of pair scores for each segment, whose best entries all leave
in one numpy step.

No piece of such a vocabulary has the space mark after another character, so
merges never cross the beginning of a word. The model is searched for an
exception when it is loaded (then a text is one segment); otherwise each
distinct segment, a run of space marks with what follows, is merged once for
each Python worker and held in a bounded memo. Every newly merged segment is
checked against the sentencepiece library, whole batches at a time; a
difference raises an error. Points, commas and line feeds after letters are
segments of their own where the vocabulary has no piece across such a place.

Defined results: a null text is the empty text, which has no pieces, so only
the end id; rows and repeats are independent of each other; extra columns are
not read.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import batches, texts

SPACE = "▁"
#: A point or comma that doesn't follow a Latin letter.
UNSAFE = re.compile("(?:^|[^A-Za-zÀ-ÖØ-öø-ÿ])[.,]").search
#: The memo is emptied when it holds so many segments.
MEMO = 300_000
#: Segments of up to so many characters are merged together, so many at a time.
SHORT, TOGETHER = 48, 8192

codecs.register_error("piece_bytes", lambda e: ("�" * (e.end - e.start), e.end))


class Vocabulary:
    """A BPE SentencePiece model file: encode() and decode() in Python, library() for the check."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb2

        model = pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != pb2.TrainerSpec.BPE:
            raise ValueError("not a merge-type vocabulary")
        n = model.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix:
            raise ValueError("only identity normalisation with a dummy prefix is supported")
        kind = pb2.ModelProto.SentencePiece
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == kind.NORMAL}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kind.UNKNOWN)
        self.end = self.library.eos_id()
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        table: list[bytes] = []
        for i, p in enumerate(model.pieces):
            if p.type == kind.NORMAL:
                table.append(p.piece.replace(SPACE, " ").encode())
            elif p.type == kind.BYTE:
                table.append(bytes([int(p.piece[3:5], 16)]))
            else:
                table.append(model.trainer_spec.unk_surface.encode() if i == self.unknown else b"")
        self.table = table
        # a line feed is in no piece, and a point or comma next to a letter in none: segments may be cut there
        beside = {(a, b) for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        self.by_mark = self.by_word and not any("\n" in p or "\0" in p for p in self.ids) and not any(
            (a in ".," and b.isalpha()) or (b in ".," and a.isalpha()) for a, b in beside
        ) and len(self.bytes) == 256
        self.spaced = {i for p, i in self.ids.items() if p[0] == SPACE}
        self.controls = {i for i, b in enumerate(table) if not b or i == self.unknown}
        self.chars = {p: i for p, i in self.ids.items() if len(p) == 1}
        if any(c not in self.chars for p in self.ids for c in p):
            raise ValueError("a character of a piece is not a piece itself")
        self.by_code = np.full(0x110000, -2, np.int32)  # a character's piece by its code point
        for c, i in self.chars.items():
            self.by_code[ord(c)] = i
        self.size = len(table)
        pairs = sorted(
            (self.ids[p[:k]] * self.size + self.ids[p[k:]], i, self.scores[p])
            for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids
        )
        self.keys = np.array([k for k, _, _ in pairs] + [1 << 62], np.int64)
        self.made = np.array([i for _, i, _ in pairs] + [-1], np.int32)
        self.worth = np.array([x for _, _, x in pairs] + [-np.inf], np.float32)
        # plain dicts of atomic values, which the garbage collector doesn't walk
        self.memo: dict[str, bytes] = {}
        self.decimal: dict[str, str] = {}

    def merge(self, segment: str) -> list[int]:
        """Ids of a segment with space marks, by the agenda."""
        ids, scores = self.ids, self.scores
        whole = ids.get(segment)
        symbols = list(segment)
        n = len(symbols)
        if n == 1:
            return [whole] if whole is not None else self.fallback(segment)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = []
        for i in range(n - 1):
            s = scores.get(symbols[i] + symbols[i + 1])
            if s is not None:
                agenda.append((-s, i, i + 1, symbols[i] + symbols[i + 1]))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, piece = heapq.heappop(agenda)
            if right[i] != j or not symbols[i] or symbols[i] + symbols[j] != piece:
                continue  # one side has been merged since
            symbols[i], symbols[j] = piece, ""
            k = right[i] = right[j]
            right[j] = -1
            if k >= 0:
                left[k] = i
                s = scores.get(piece + symbols[k])
                if s is not None:
                    heapq.heappush(agenda, (-s, i, k, piece + symbols[k]))
            h = left[i]
            if h >= 0:
                s = scores.get(symbols[h] + piece)
                if s is not None:
                    heapq.heappush(agenda, (-s, h, i, symbols[h] + piece))
        out: list[int] = []
        for s in symbols:
            if s:
                x = ids.get(s)
                if x is None:
                    out += self.fallback(s)
                else:
                    out.append(x)
        return out

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the pieces that symbols a and b form; -inf where they form none."""
        key = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.keys, key)
        none = (self.keys[at] != key) | (a < 0) | (b < 0)
        return np.where(none, np.float32(-np.inf), self.worth[at]), np.where(none, -1, self.made[at])

    def merge_together(self, segments: list[str]) -> list[list[int]]:
        """merge() of segments of similar, small lengths."""
        chars, n = self.chars, max(map(len, segments))
        rows = len(segments)
        if not n:
            return [[] for _ in segments]
        symbols = np.full((rows, n + 1), -1, np.int32)  # a character outside the vocabulary is -2 and never merges
        flat = self.by_code[np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), "<u4")]
        lengths = np.fromiter(map(len, segments), np.int64, rows)
        inside = np.arange(n + 1) < lengths[:, None]
        symbols[inside] = flat
        width = n + 1
        score = np.full((rows, width), -np.inf, np.float32)
        made = np.full((rows, width), -1, np.int32)
        score[:, :-1], made[:, :-1] = self.pairs(symbols[:, :-1], symbols[:, 1:])
        # flat places of the neighbours; the last column is a stop that forms no pair
        after = np.arange(rows * width).reshape(rows, width) + 1
        after[:, -1] -= 1
        after, before = after.ravel(), np.arange(rows * width) - 1
        symbols, made, flat_score = symbols.ravel(), made.ravel(), score.ravel()
        live = np.arange(rows)
        while True:
            at = score[live].argmax(1) + live * width
            going = flat_score[at] > -np.inf
            live, at = live[going], at[going]
            if not len(live):
                break
            gone = after[at]
            follow = after[gone]
            symbols[at] = made[at]
            symbols[gone] = -3  # merged into its neighbour
            flat_score[gone] = -np.inf
            after[at] = follow
            before[follow] = at
            has_left = at > live * width
            right, left = at, before[at[has_left]]
            s, m = self.pairs(symbols[np.concatenate([right, left])], symbols[np.concatenate([follow, right[has_left]])])
            k = len(right)
            flat_score[right], made[right] = s[:k], m[:k]
            flat_score[left], made[left] = s[k:], m[k:]
        final = symbols.reshape(rows, width)
        out: list[list[int]] = []
        for ids, segment, odd in zip(final.tolist(), segments, (final == -2).any(1).tolist(), strict=True):
            ids = [x for x in ids if x != -3 and x != -1]
            if odd:
                missing = iter(c for c in segment if c not in chars)
                ids = [y for x in ids for y in ([x] if x >= 0 else self.fallback(next(missing)))]
            out.append(ids)
        return out

    def merge_all(self, segments: list[str]) -> list[list[int]]:
        order = sorted(range(len(segments)), key=lambda i: len(segments[i]))
        short = [i for i in order if len(segments[i]) <= SHORT]
        out: list[list[int]] = [[]] * len(segments)
        for k in range(0, len(short), TOGETHER):
            part = short[k : k + TOGETHER]
            for i, ids in zip(part, self.merge_together([segments[i] for i in part]), strict=True):
                out[i] = ids
        for i in order[len(short) :]:
            out[i] = self.merge(segments[i])
        return out

    def fallback(self, symbol: str) -> list[int]:
        return [self.bytes[b] for b in symbol.encode()] if self.bytes else [self.unknown]

    def segments(self, text: str) -> list[str]:
        """The text's segments, each without its first space mark; after a NUL, one that has none; two stand for a real one."""
        if not text:
            return []
        if self.by_word:
            if "\0" in text:
                found = re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))
                return ["\0" * (x[1:2] == "\0") + x[1:] for x in found]
            if self.by_mark and not UNSAFE(text):
                found = text.replace(".", " \0.").replace(",", " \0,").replace("\n", " \0\n \0").split(" ")
            else:
                found = text.split(" ")
            if "" not in found and SPACE not in text:
                return found
            return [x[1:] for x in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))]
        return [text.replace(" ", SPACE)]

    def learn(self, all_segments: list[list[str]]) -> None:
        """Merge the segments that the memo lacks, and check them against the library."""
        if len(self.memo) > MEMO:
            self.memo, self.decimal = {}, {}
        memo, decimal = self.memo, self.decimal
        seen: set[str] = set()
        for segments in all_segments:
            seen.update(segments)
        new = [s for s in seen if s not in memo]
        if not new:
            return
        bare = [s[:1] == "\0" and s[1:2] != "\0" for s in new]
        plain = [s[1:] if s[:1] == "\0" else s for s in new]
        found = self.merge_all([s if b else SPACE + s for s, b in zip(plain, bare, strict=True)])
        # the library adds the first space mark itself, but not to the empty text; a line feed stands before a segment without mark
        checked = ["\n" + s if b else s.replace(SPACE, " ") for s, b in zip(plain, bare, strict=True)]
        for s, b, ids, want in zip(new, bare, found, self.library.encode(checked, num_threads=1), strict=True):
            if ids != (want[2:] if b else want) and s:
                raise ValueError(f"the agenda's pieces of {s!r} differ from the library's: {ids}, {want}")
            memo[s], decimal[s] = np.array(ids, "<i4").tobytes(), "".join([f"{i} " for i in ids])

    def encode(self, text: str) -> list[int]:
        """Ids without the end id."""
        segments = self.segments(text)
        self.learn([segments])
        return np.frombuffer(b"".join(map(self.memo.__getitem__, segments)), "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The library's decode(ids), by table lookup."""
        while ids and not self.table[ids[-1]]:
            ids = ids[:-1]
        if self.controls.isdisjoint(ids):
            raw = b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "piece_bytes")
        else:  # byte pieces don't join across other ids
            raw, run = "", b""
            for i in ids:
                if i in self.controls:
                    raw, run = raw + run.decode("utf-8", "piece_bytes") + self.table[i].decode(), b""
                else:
                    run += self.table[i]
            raw += run.decode("utf-8", "piece_bytes")
        first = next((i for i in ids if self.table[i]), self.unknown)
        return raw[1:] if first in self.spaced else raw


VOCABULARIES: dict[str, Vocabulary] = {}
common.LEARNT.append(VOCABULARIES)


def vocabulary(path: str) -> Vocabulary:
    """One for each Python worker."""
    if path not in VOCABULARIES:
        VOCABULARIES[path] = Vocabulary(path)
    return VOCABULARIES[path]


DIGESTS = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
#: So many characters are encoded at a time.
STEP = 2_000_000


def parts(values: Iterator[tuple], step: int = STEP) -> Iterator[list[tuple]]:
    """Lists of (row, text) with about step characters each."""
    held, n = [], 0
    for x in values:
        held.append(x)
        n += len(x[-1])
        if n >= step:
            yield held
            held, n = [], 0
    if held:
        yield held


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>, with the end id at the end)."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in source:
            for part in parts(zip(batch.column(0).to_pylist(), texts(batch, 1), strict=True)):
                yield batches(schema, [(i, [*v.encode(t), v.end]) for i, t in part])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of a table with ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in source:
            ids = (x.as_py() or [] for x in batch.column(1))
            for part in parts(zip(batch.column(0).to_pylist(), ids, strict=True)):
                yield batches(schema, [(i, v.decode(x)) for i, x in part])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes in one pass, keeping only digests.

    ids_sha256 is of the decimal ids joined by one space.
    """
    schema = pa.schema([("doc_id", pa.int64()), *DIGESTS])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in source:
            for part in parts(zip(batch.column(0).to_pylist(), texts(batch, 1), strict=True)):
                split = [v.segments(t) for _, t in part]
                v.learn(split)
                rows = []
                for (i, _), segments in zip(part, split, strict=True):
                    ids = np.frombuffer(b"".join(map(v.memo.__getitem__, segments)), "<i4").tolist()
                    ids.append(v.end)
                    decimal = "".join(map(v.decimal.__getitem__, segments)) + str(v.end)
                    text = v.decode(ids)
                    rows.append((i, len(ids), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
                yield batches(schema, rows)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(common.released(run, keep=True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
