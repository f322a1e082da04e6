import base64
import datetime as dt
import glob
import gzip
import hashlib
import random
from collections import defaultdict

import pytest

from tests.llm import brute
from usagelens.llm import warc
from usagelens.llm.queries import QUERIES
from usagelens.session import scratch_path

SF = "/root/testdata/sf0.001"


def expected(rows):
    best = defaultdict(lambda: -1)
    data = [(i, (h or "").encode()) for i, h in rows]
    for i, b in data:
        best[b] = max(best[b], i)
    out, done = [], set()
    for i, b in data:
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        response = i == best[b] and b not in done
        if response:
            done.add(b)
        out.append((i, len(b), digest, "response" if response else "revisit", None if response else best[b]))
    return sorted(out, key=str)


def test_query_matches_brute_force(spark):
    got = sorted((tuple(r) for r in QUERIES["op10_warc_revisits"](spark, SF).collect()), key=str)
    assert got == expected([(p["page_id"], p["html"]) for p in brute.rows(spark, SF, "pages")])


HOSTILE = "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
ROWS = [(1, "x"), (5, "x"), (3, "x"), (2, None), (4, ""), (6, HOSTILE), (7, HOSTILE + "\n"), (8, "é😀" * 4000), (9, "é😀" * 4000), (9, "é😀" * 4000), (10, "\n\n lead")]


def frame(spark):
    return spark.createDataFrame([(i, f"http://h/{i}\r\nX: y", h, "k", "r") for i, h in ROWS],
                                 "page_id bigint, url string, html string, row string, record_type string")


def digest(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_edge_cases(spark):
    assert digest(warc.roundtrip(frame(spark))) == expected(ROWS)
    assert warc.roundtrip(frame(spark).limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, None, "x"), (None, None, "x"), (1, "u", "x"), (None, "v", "alone")], "page_id bigint, url string, html string")
    got = sorted(((r.page_id, r.url, r.record_type, r.refers_to) for r in warc.roundtrip(nulls).collect()), key=str)
    assert got == sorted([(1, "u", "response", None), (None, None, "revisit", 1), (None, None, "revisit", 1), (None, "v", "response", None)], key=str)


def test_small_payloads_stay(spark):
    kinds = {(r.page_id, r.record_type) for r in warc.roundtrip(frame(spark), min_bytes=2).collect()}
    assert {(1, "response"), (5, "response"), (2, "response"), (4, "response"), (8, "revisit")} <= kinds


def test_archives_hold_each_payload_once(spark):
    path = scratch_path(spark, "warc-test")
    warc.write_archives(frame(spark), path)
    files = glob.glob(path.removeprefix("file:") + "/part-*.gz")
    text = b"".join(gzip.open(f).read() for f in files)
    assert files and text.count("é😀".encode() * 4000) == 1 and text.count(b"WARC-Type: revisit") == 5
    assert text.count(b"WARC-Target-URI: http://h/6 X: y\r\n") == 1


def test_headers_name_the_response(spark):
    path = scratch_path(spark, "warc-test")
    warc.write_archives(frame(spark), path, as_of=dt.datetime(2024, 5, 1, 12))
    text = b"".join(gzip.open(f).read() for f in glob.glob(path.removeprefix("file:") + "/part-*.gz"))
    heads = [h for h in text.split(b"\r\n\r\n") if b"WARC-Record-ID" in h]
    of = lambda h, k: next((x.split(b": ", 1)[1] for x in h.split(b"\r\n") if x.startswith(k + b": ")), None)
    names = {of(h, b"WARC-Record-ID"): h for h in heads}
    assert len(names) == len(ROWS) and {of(h, b"WARC-Date") for h in heads} == {b"2024-05-01T12:00:00Z"}
    for h in heads:
        to = of(h, b"WARC-Refers-To")
        if of(h, b"WARC-Type") == b"revisit":
            assert of(names[to], b"WARC-Type") == b"response" and of(names[to], b"X-Page-Id") == of(h, b"X-Refers-To-Page")
            assert of(names[to], b"WARC-Payload-Digest") == of(h, b"WARC-Payload-Digest") and of(h, b"WARC-Refers-To-Date") == of(h, b"WARC-Date")
        else:
            assert to is None and of(h, b"WARC-Refers-To-Date") is None


def test_large_and_line_end_payloads(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choices("\r\nab", k=rng.randint(1, 60)))) for i in range(400)]
    rows += [(1000 + i, "".join(rng.choices(["\r\n", "\r", "\n", "\r\n\r\n", "é"], k=200_000))) for i in range(6)]
    rows += [(2000, "x" * 30_000_000), (2001, "\r\n\r\n"), (2002, "\r\n"), (2003, "\r")]
    df = spark.createDataFrame([(i, None, h) for i, h in rows], "page_id bigint, url string, html string").repartition(3)
    assert digest(warc.roundtrip(df)) == expected(rows)


def test_a_cut_archive_fails(spark):
    archive = warc._Archive()
    assert list(archive.feed(b"WARC/1.1\r\nContent-Length: 9")) == [] and list(archive.feed(b"abc")) == []
    assert list(archive.feed(b"de")) == [(b"WARC/1.1\r\nContent-Length: 9", b"abc\r\n\r\nde")]
    archive.close()
    list(archive.feed(b"WARC/1.1\r\nContent-Length: 9"))
    with pytest.raises(ValueError):
        archive.close()
