import hashlib

from factloom.llm import warc

LONG = "<html>" + "x" * 1200
ROWS = [
    (1, "http://www.Example.com/a?b=1", LONG, "c"), (2, "http://example.com/", LONG, "c"), (3, None, None, None), (4, "https://a.b.example.org:8443/p\n", "short", "c"),
    (5, "http://example.com/", "short", "c"), (6, "http://example.com/", LONG + "é", "c"), (7, "not a url", "", "c"), (2, "http://example.com/", LONG, "c"), (None, "http://n/", LONG, "c"),
]
SCHEMA = "page_id long, url string, html string, _digest2 string"


def brute(rows):
    last = {}
    for i, _, h, _ in rows:
        p = (h or "").encode()
        if len(p) >= 1000 and i is not None:
            last[p] = max(last.get(p, i), i)
    out = []
    for i, _, h, _ in rows:
        p = (h or "").encode()
        refers = last[p] if p in last and i is not None and i != last[p] else None
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


def test_round_trip(spark, monkeypatch):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    assert sorted(map(tuple, warc.archive_round_trip(pages, 2).collect()), key=str) == brute(ROWS)
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    assert sorted(map(tuple, warc.archive_round_trip(pages).collect()), key=str) == brute(ROWS)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_look_ups(spark):
    rows = [(i, f"http://h{i % 7}.example.com/{i % 40}", "t", None) for i in range(300)] + [(1000 + i, "http://hot.example.com/", "t", None) for i in range(50)]
    _, captures = warc.write_archives(spark.createDataFrame(rows, SCHEMA))
    folder, manifest = warc.write_index(captures, 3)
    files = sorted((r["first"], r["file"], r["directory"], r["size"]) for r in manifest.collect())
    index = warc.CaptureIndex(folder, files)
    want = {}
    for i, u, *_ in rows:
        want.setdefault(warc.url_key(u), set()).add(i)

    def found(key):
        return [x for i, k in index.blocks(key) for x in index.in_block(key, i, k)]

    for key, ids in want.items():
        assert sorted(x[1] for x in found(key)) == sorted(ids)
    assert not found("com,example,absent)/") and not found("")
    keys = captures.select("key").distinct()
    got = warc.look_up(spark, folder, manifest, keys).select("key", "page_id").collect()
    assert sorted(map(tuple, got)) == sorted((k, i) for k, ids in want.items() for i in ids)


def test_one_url_for_all_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "NEIGHBOURS", 1)
    rows = [(i, None, f"page {i}" + "x" * (i % 2000), None) for i in range(300)]
    assert sorted(map(tuple, warc.archive_round_trip(spark.createDataFrame(rows, SCHEMA), 7).collect()), key=str) == brute(rows)


def test_keys():
    assert warc.url_key("http://www.Example.com:80/A?b") == "com,example,www)/a?b"
    assert warc.url_key("https://a.org:8443") == "org,a:8443)/" and warc.url_key(None) == ""
