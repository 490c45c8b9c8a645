"""WARC archives (exact round trip) and URL filters (brute force)."""

import base64
import hashlib
import random
import struct

import pytest
import zstandard

from riskcard.llm import urlfilter, warc

PAGES = "page_id long, url string, html string, digest string, first long, size int, host string, rule string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", 0, 1, "h", "r") for r in rows], PAGES).repartition(4)


def bodies(seed):
    rnd = random.Random(seed)
    body = lambda: "<html>" + " ".join(rnd.choice(["né", "nav", "<p>", "x" * 9]) for _ in range(rnd.randint(0, 400)))
    shared = [body(), "", body()]
    rows = [(i, f"http://a{i}.org/x", rnd.choice(shared + [body(), body()])) for i in range(150)]
    return rows + [(150, None, None), (151, "", "x" * 300_000), (152, "http://é.org/\r\nX: y z", "\r\n\r\nWARC/1.1\r\n"),
                   (3, rows[3][1], rows[3][2]), (None, "http://n", rows[0][2])]


@pytest.mark.parametrize("archive_bytes", [20_000, 1 << 24])
def test_round_trip(spark, tmp_path, archive_bytes):
    rows = bodies(1)
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_archives(pages(spark, rows), folder, archive_bytes=archive_bytes)
    got = warc.read_archives(manifest, folder).collect()
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    want = []
    for p, _, h in rows:
        b = (h or "").encode()
        f = first[h or ""]
        want.append((-1 if p is None else p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(),
                     "response" if p == f else "revisit", -1 if p == f else f))
    assert sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type,
                   -1 if r.refers_to is None else r.refers_to) for r in got) == sorted(want)
    stored = [r for r in manifest.collect()]
    assert sum(r.records for r in stored) == len(rows)
    assert archive_bytes > 1 << 20 or len(stored) > 4


def test_archive_layout_and_payloads():
    recs = [warc.record(i, f"http://x/{i}", (f"page {i} " + "the same words again " * 30).encode(), None) for i in range(400)]
    data = warc.archive(recs)
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    words = zstandard.ZstdCompressionDict(data[8: 8 + size])
    assert words.dict_id() != 0
    first = zstandard.ZstdDecompressor(dict_data=words).decompressobj().decompress(data[8 + size:])
    assert first == recs[0]                     # records are frames of their own
    import io
    blocks = [b for _, b in warc.records_of(io.BytesIO(data))]
    assert blocks == [r[r.index(b"\r\n\r\n") + 4: -4] for r in recs]
    assert len(data) < len(b"".join(zstandard.ZstdCompressor(level=3).compress(r) for r in recs))


def test_min_bytes_and_empty(spark, tmp_path):
    rows = [(1, "u", "aa"), (2, "u", "aa"), (3, "u", "a" * 50), (4, "u", "a" * 50)]
    folder = f"file://{tmp_path}/m"
    got = {r.page_id: r for r in warc.read_archives(warc.write_archives(pages(spark, rows), folder, min_bytes=10), folder).collect()}
    assert got[2].record_type == "response" and got[4].refers_to == 3
    folder = f"file://{tmp_path}/e"
    assert warc.read_archives(warc.write_archives(pages(spark, []), folder), folder).count() == 0


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("Example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
         ("a.com", "/fr/", "block"), ("a.com", "/fr/", "allow"), ("com", "", "block"), ("net", None, "block"), (None, "/", "block"),
         ("", "/", "block"), ("x.net", "/y", None)]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
        host, tail = rest[:cut].translate({c: c + 32 for c in range(65, 91)}), rest[cut:]
        path = tail[: min([tail.index(c) for c in "?#" if c in tail] + [len(tail)])]
    fits = []
    for h, p, v in RULES:
        if h and v and host:
            h, p = h.lower(), p or ""
            if (host == h or host.endswith("." + h)) and path.startswith(p):
                fits.append((-len(h + p), v != "block", h + p, v))
    best = min(fits) if fits else (0, 0, None, "allow")
    return host, path, best[2], best[3]


def test_url_filters(spark):
    urls = ["http://example.org/es/1", "https://WWW.Example.ORG/en/12?q=/es/", "http://notexample.org/es/", "x://org", "x://org/", None,
            "", "no scheme", "http://", "http:///p", "ftp://b.a.com/fr/x#y", "http://com/fr", "http://t.com?x=/fr/", "http://x.net/y",
            "http://u@h.com:80/fr/", "http://é.org/é", "http://a.b.c.d.e.com/" + "fr/" * 3000, "a://b://c.org/", "http://x.org\n/es/"]
    rows = [(i, u, "") for i, u in enumerate(urls)] + [(0, urls[0], ""), (None, urls[1], ""), (0, urls[10], "")]
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = urlfilter.judged(pages(spark, rows), rules).collect()
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted((tuple(r) for r in got), key=key) == sorted(((p, *brute(u)) for p, u, _ in rows), key=key)
    assert {r.verdict for r in urlfilter.judged(pages(spark, rows), rules.limit(0), "block").collect()} == {"block"}
    assert urlfilter.judged(pages(spark, []), rules).count() == 0


def test_archives_are_read_by_many_tasks(spark):
    """About one archive a task: at least as many tasks with rows as half the archives, or the cores."""
    pages = spark.createDataFrame([(k, f"http://h/{k}", "some html " * 40 + str(k)) for k in range(400)],
                                  "page_id long, url string, html string").repartition(4)
    folder = warc.archive_folder(spark)
    manifest = warc.write_archives(pages, folder, archive_bytes=4_000)
    archives = manifest.count()
    assert archives >= 16
    used = warc.read_archives(manifest, folder).rdd.glom().map(len).filter(bool).count()
    assert used >= min(archives // 2, spark.sparkContext.defaultParallelism)
