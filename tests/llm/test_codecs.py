import hashlib
import io
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import gif, pieces, queries, separators, tokenfiles, words
from factloom.llm.words import words as loaded_words

PIECES, WORDS = (public_tokenizers.path(x) for x in ("piece_bpe_32k.model", "word_bpe_49k.json"))
TEXTS = ["", None, "Hello, world.", "a.b, c.\n\nD .e", "x" * 5000, "  two  spaces ", "▁mark\0nul", "日本語 text 😀", "Same text.", "Same text.", "<|endoftext|> </s>", "é.\nÉ,"]
DOCS = "doc_id long, text string, ids string"


def docs(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "null id", None)], DOCS)


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("ab. ,\n▁é")), max_size=60))
def test_pieces_agree_with_the_library(text):
    v = pieces.vocabulary(PIECES)
    want = v.library.encode(text)
    assert v.encode(text) == want
    assert v.decode(want) == v.library.decode(want)


def test_agenda_of_long_and_short_segments_agree():
    v = pieces.vocabulary(PIECES)
    random.seed(5)
    segments = ["▁" + "".join(random.choice("theraino日q") for _ in range(random.randint(1, 40))) for _ in range(500)]
    assert v.merge_all(segments) == [v.merge(s) for s in segments]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31999)), max_size=9))
def test_decoding_agrees_with_the_library(ids):
    v = pieces.vocabulary(PIECES)
    assert v.decode(ids) == v.library.decode(ids)


def test_piece_digests(spark):
    lib = pieces.vocabulary(PIECES).library
    got = {r["doc_id"]: r for r in pieces.round_trip(docs(spark), PIECES).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, t in enumerate(TEXTS):
        ids = lib.encode(t or "", add_eos=True)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    back = pieces.decode_documents(pieces.encode_documents(docs(spark), PIECES), PIECES)
    assert {r["doc_id"]: r["text"] for r in back.collect()}[2] == "Hello, world."
    assert pieces.round_trip(docs(spark).limit(0), PIECES).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aB. ,\n'sİΣ")), max_size=60))
def test_words_agree_with_the_library(text):
    w = loaded_words(WORDS)
    assert w.ids([text])[0].tolist() == w.library.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 69_999)), max_size=40), min_size=1, max_size=8), st.integers(0, 9))
def test_blocks_round_trip(lists, seed):
    table = np.random.default_rng(seed).permutation(70_000).astype("<u4")
    doc_ids, sizes = np.arange(len(lists)), np.array([len(x) for x in lists])
    block = tokenfiles.encode_block(doc_ids, sizes, np.array([y for x in lists for y in x], "<u4"), inverse(table))
    ((ids, counts, flat),) = tokenfiles.read_blocks(io.BytesIO(tokenfiles.MAGIC + block), table)
    assert counts.tolist() == [len(x) for x in lists] and ids.tolist() == list(range(len(lists)))
    assert flat.tolist() == [y for x in lists for y in x]


def inverse(table):
    rank_of = np.empty(len(table), "<u4")
    rank_of[table] = np.arange(len(table))
    return rank_of


def test_wide_ranks():
    flat = table = np.arange((1 << 24) + 300, dtype="<u4")[::-1].copy()
    flat = flat[::991]
    block = tokenfiles.encode_block(np.array([0]), np.array([len(flat)]), flat, inverse(table))
    ((_, _, back),) = tokenfiles.read_blocks(io.BytesIO(tokenfiles.MAGIC + block), table)
    assert np.array_equal(back, flat)


def test_ranks_are_of_the_whole_corpus(spark):
    rows = [(i, t) for i, t in enumerate(["the rain", "the the in", "é " * 50, "x " * 20])]
    ids, kind = tokenfiles.tokenised(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), WORDS, 2)
    lib = loaded_words(WORDS).library
    seen = Counter(i for _, t in rows for i in [*lib.encode(t, add_special_tokens=False).ids, 2])
    table = tokenfiles.frequency_ranks(ids, kind, lib.get_vocab_size())
    assert table[: len(seen)].tolist() == sorted(seen, key=lambda i: (-seen[i], i))
    assert sorted(table.tolist()) == list(range(lib.get_vocab_size()))


def test_one_document_id_for_all_rows(spark):
    r = random.Random(8)
    rows = [(None if i % 2 else 7, " ".join(r.choices(["the", "rain", "in"], k=r.randint(0, 9)))) for i in range(400)] + [(7, "x" * 300_000)]
    folder, manifest = tokenfiles.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), WORDS, 2)
    got = tokenfiles.read_token_files(spark, folder, manifest).orderBy("start").collect()
    lib = loaded_words(WORDS).library
    want = Counter((i, zlib.crc32(np.array([*lib.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t in rows)
    assert Counter((x["doc_id"], x["ids_crc32"]) for x in got) == want
    assert [x["doc_id"] for x in got] == [7] * 201 + [None] * 200
    assert [x["start"] for x in got] == np.cumsum([0, *[x["n_tokens"] for x in got[:-1]]]).tolist()


def test_token_files(spark):
    folder, manifest = tokenfiles.write_token_files(docs(spark), WORDS, 2, block_ids=20, file_bytes=300)
    assert manifest.count() >= 2
    got = tokenfiles.read_token_files(spark, folder, manifest).collect()
    lib = loaded_words(WORDS).library
    start, want = 0, []
    for i, t in [*enumerate(TEXTS), (None, "null id")]:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == want
    folder, manifest = tokenfiles.write_token_files(docs(spark).limit(0), WORDS, 2)
    assert tokenfiles.read_token_files(spark, folder, manifest).count() == 0


def test_separator_scan(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORDS)
    lib.encode_special_tokens = True
    want = sorted(len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for t in [*TEXTS, "null id"])
    assert sorted(r["n_tokens"] for r in separators.document_token_counts(docs(spark), WORDS, 49407).collect()) == want
    w = words.Words(WORDS, special=False)
    assert sorted(len(w.ids([t or ""])[0]) + 1 for t in [*TEXTS, "null id"]) == want
    folder, order = separators.write_flat(docs(spark).coalesce(1), WORDS, 49407)
    files, order = order.where("ordinal IS NULL").select("file", "file_ids"), order.where("ordinal IS NOT NULL")
    for block in (1, 2, 3, 7, 50):
        got = separators.count_tokens(spark, folder, files, 49407, block_ids=block).orderBy("ordinal").collect()
        known = [r["doc_id"] for r in order.orderBy("ordinal").collect()]
        text = dict(enumerate(TEXTS)) | {None: "null id"}
        assert [r["n_tokens"] for r in got] == [len(w.ids([text[i] or ""])[0]) + 1 for i in known], block
    assert separators.document_token_counts(docs(spark).limit(0), WORDS, 49407).count() == 0


def frames_of(media):
    return list(gif.decode(media))


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000))
def test_lzw_round_trip(data):
    data = data or b"a"
    assert gif.lzw_decode(gif.lzw_encode(data), 8) == data


def test_lzw_full_tables():
    data = bytes(random.Random(1).choices(range(256), k=60_000)) + b"ab" * 20_000
    assert gif.lzw_decode(gif.lzw_encode(data), 8) == data


def by_hand(frames, screen=(4, 2), palette=((0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255))):
    """A GIF of frames (left, top, w, h, disposal, transparent or None, interlaced, samples)."""
    import struct

    out = b"GIF89a" + struct.pack("<HHBBB", *screen, 0x81, 0, 0) + bytes(v for c in palette for v in c)
    for left, top, w, h, disposal, clear, laced, samples in frames:
        out += b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), 7, clear or 0) + b"\0"
        out += b"\x2c" + struct.pack("<HHHHB", left, top, w, h, 0x40 if laced else 0) + b"\x02" + gif.blocks_of(gif.lzw_encode(bytes(samples), 2))
    return out + b"\x3b"


def test_disposal_and_transparency():
    m = by_hand([
        (0, 0, 4, 2, 1, None, False, [1] * 8), (0, 0, 2, 1, 2, 3, False, [2, 3]), (1, 1, 1, 1, 3, None, False, [3]), (3, 1, 1, 1, 0, None, False, [2]),
    ])
    a, b, c, d = (f.canvas for f in frames_of(m))
    red, green, blue, clear = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    assert (a == red).all()
    assert b[0, 0].tolist() == green and b[0, 1].tolist() == red  # the transparent pixel shows the canvas
    assert c[0, 0].tolist() == clear and c[0, 1].tolist() == clear and c[1, 1].tolist() == blue  # restored to background
    assert d[1, 1].tolist() == red and d[1, 3].tolist() == green  # restored to what was before
    assert [f.delay_ms for f in frames_of(m)] == [70] * 4


def test_interlaced_rows():
    rows = [0, 1, 2, 3, 0, 1, 2, 3, 1]
    order = [*range(0, 9, 8), *range(4, 9, 8), *range(2, 9, 4), *range(1, 9, 2)]
    (f,) = frames_of(by_hand([(0, 0, 1, 9, 0, None, True, [rows[i] for i in order])], (1, 9)))
    red = f.canvas[:, 0, :3].tolist()
    assert red == [[[0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]][v] for v in rows]


def test_damaged_media():
    m = gif.encode(b" " * 192)
    for bad in (b"", b"PNG", m[:500], m[:-30]):
        with pytest.raises(ValueError):
            frames_of(bad)


def test_media_digests(spark):
    long = "long " * 30_000
    data = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, long])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in gif.media_digests(gif.media_column(data)).collect()}
    for i, t in enumerate([*TEXTS, long]):
        n, payload = gif.payload_of(t or "")
        media = gif.encode(payload)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (n, len(payload), len(media)) and len(payload) % 192 == 0
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert r["media_sha256"] == hashlib.sha256(media).hexdigest()
    assert got[8]["feature"] == got[9]["feature"]
    frames = gif.frames(gif.media_column(data)).where("id = 12").collect()
    assert len(frames) == 3 and sum(frames[0]["histogram"]) == 3 * 192 * 320
    assert gif.media_digests(gif.media_column(data.limit(0))).count() == 0


def test_queries_of_codecs(spark, tmp_path):
    rows = [(i, t, "clash", i) for i, t in enumerate([*TEXTS, "long " * 60_000])] + [(None, None, None, None), (3, TEXTS[3], "c", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, file string, ordinal int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    lib, plain = loaded_words(WORDS).library, words.Words(WORDS, special=False).library

    def run(name):
        assert queries.QUERIES[name](spark, f"{tmp_path}/none").count() == 0
        return queries.QUERIES[name](spark, str(tmp_path))

    got = run("op8_separator_scan")
    assert got.columns == ["doc_id", "n_tokens"]
    assert Counter(map(tuple, got.collect())) == Counter((i, len(plain.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, *_ in rows)
    got = run("op3_token_files").collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((i, len(lib.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, *_ in rows)
    got = run("op4_gif_media").collect()
    padded = {i: (t or "").encode() + b" " * (-len((t or "").encode()) % 192 or 192 * (not t)) for i, t, *_ in rows}
    assert Counter((r["doc_id"], r["payload_sha256"]) for r in got) == Counter((i, hashlib.sha256(padded[i]).hexdigest()) for i, *_ in rows)
    got = run("op2_sentencepiece_round_trip").collect()
    own = pieces.vocabulary(PIECES).library
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((i, len(own.encode(t or "", add_eos=True))) for i, t, *_ in rows)


def plain_lzw(data, bits):
    """An LZW decoder of its own, one code at a time."""
    clear, end = 1 << bits, (1 << bits) + 1
    table, size, out, last, at, held, n = None, bits + 1, b"", None, 0, 0, 0
    while True:
        while n < size:
            held, n, at = held | data[at] << n, n + 8, at + 1
        code, held, n = held & (1 << size) - 1, held >> size, n - size
        if code == clear:
            table, size, last = {**{i: bytes([i]) for i in range(clear)}, clear: b"", end: b""}, bits + 1, None
        elif code == end:
            return out
        else:
            piece = table[code] if code in table else last + last[:1]
            if last is not None and len(table) < 4096:
                table[len(table)] = last + piece[:1]
            out, last = out + piece, piece
            if len(table) == 1 << size and size < 12:
                size += 1


@settings(max_examples=25, deadline=None)
@given(st.binary(min_size=1, max_size=4000))
def test_stored_media_by_another_decoder(data):
    """What encode writes, read by a decoder that shares nothing with it."""
    payload = data + b" " * (-len(data) % 192 or 192 * (not data))
    m = gif.encode(payload)
    assert m[:6] == b"GIF89a" and m[-1:] == b"\x3b"
    at, out = 13 + (3 << (m[10] & 7) + 1 if m[10] & 0x80 else 0), b""
    palette = m[13:at]
    while m[at] != 0x3B:
        if m[at] == 0x21:
            at += 2
        else:
            assert m[at] == 0x2C
            local = m[at + 9]
            at += 10 + (3 << (local & 7) + 1 if local & 0x80 else 0)
            bits, stream = m[at], b""
            at += 1
            while m[at]:
                stream, at = stream + m[at + 1 : at + 1 + m[at]], at + 1 + m[at]
            out += plain_lzw(stream, bits)
            at += 1
            continue
        while m[at]:
            at += 1 + m[at]
        at += 1
    assert len(palette) >= 3 and out[: len(payload)] == payload


def test_new_segments_are_looked_up_in_the_older_memo_without_a_pass_over_it():
    class Older(dict):
        def __iter__(self):
            raise AssertionError("a pass over the whole generation for each call")

    w = words.Words(WORDS, special=False)
    first = w.ids(["alpha beta"])[0].tolist()
    w.older, w.memo = Older(w.memo), {}
    got = [x.tolist() for x in w.ids(["alpha gamma", "alpha beta"])]
    assert got == [w.library.encode("alpha gamma", add_special_tokens=False).ids, first]
    assert set(w.memo) == {"alpha", "beta", "gamma"}
