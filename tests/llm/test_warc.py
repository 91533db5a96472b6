"""Revisits against plain Python."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from wardlake.llm import warc
from wardlake.llm.queries import ORACLES, QUERIES

SCHEMA = (
    "record_id long, kind string, status int, url string, ts long, headers array<struct<name:string,value:string>>, "
    "digest string, body string, outcome string"
)


def first(headers, name):
    return next((v for n, v in headers or [] if n is not None and n.lower() == name), None)


def validators(row):
    tag = first(row[5], "etag")
    tag = tag[2:] if tag is not None and tag.startswith("W/") else tag
    return row[6], tag, first(row[5], "last-modified")


def brute_merge(stored, fresh):
    named = [x.strip() for x in (first(fresh, "connection") or "").lower().split(",")]
    permitted = [(n, v) for n, v in fresh or [] if n.lower() not in warc.KEPT_STORED and n.lower() not in named]
    replaced = {n.lower() for n, _ in permitted}
    return [h for h in stored or [] if h[0].lower() not in replaced] + permitted


def brute(records, address):
    full = [r for r in records if r[1] == "response" and r[2] == 200]
    out = []
    for r in (r for r in records if r[1] == "revisit"):
        url = address(r[3])
        earlier = [f for f in full if r[4] is not None and f[4] is not None and url is not None and address(f[3]) == url and f[4] < r[4]]
        found = max(earlier, key=lambda f: (f[4], f[0], [(v is not None, v or "") for v in (validators(f)[1], validators(f)[2], validators(f)[0])]), default=None)
        if found is None:
            out.append((r[0], url, r[4], "orphan", None, None, None))
            continue
        pairs = [a == b for a, b in zip(validators(r), validators(found)) if a is not None and b is not None]
        outcome = "unverified" if not pairs else "resolved" if all(pairs) else "mismatch"
        merged = (None, None) if outcome == "mismatch" else (brute_merge(found[5], r[5]), found[7])
        out.append((r[0], url, r[4], outcome, found[0], *merged))
    return Counter(map(str, out))


def plain(row):
    headers = None if row.headers is None else [tuple(h) for h in row.headers]
    return str((row.record_id, row.url, row.ts, row.outcome, row.refers_to, headers, row.body))


def address(url):
    return url.split("://", 1)[1].rstrip("/") if url and "://" in url else None


TAG = [("ETag", "t1"), ("Content-Type", "text/html"), ("X-Hop", "stored"), ("Set-Cookie", "a"), ("Set-Cookie", "b")]
RECORDS = [
    (1, "response", 200, "http://a/x", 100, TAG, "d1", "body one", "x"),
    (2, "revisit", 304, "https://a/x/", 150, [("etag", "W/t1"), ("Content-Length", "0"), ("set-cookie", "c"), ("Connection", "close, x-hop"), ("X-Hop", "1")], None, None, "x"),
    (3, "revisit", 304, "http://a/x", 100, [("etag", "t1")], None, None, "x"),
    (4, "response", 200, "http://a/x", 86_500, [("ETag", "t2"), ("Last-Modified", "day")], None, "body two", "x"),
    (5, "revisit", 304, "http://a/x", 500_000, [("ETag", "t1")], None, None, "x"),
    (6, "revisit", 304, "http://a/x", 500_001, [("Last-Modified", "day")], None, None, "x"),
    (7, "revisit", 304, "http://a/x", 86_500, None, "d1", None, "x"),
    (8, "revisit", 304, "http://a/x", 90_000, [], None, None, "x"),
    (9, "response", 404, "http://b/", 10, TAG, None, "not found", "x"), (10, "revisit", 304, "http://b/", 20, TAG, None, None, "x"),
    (11, "revisit", 304, None, 20, TAG, None, None, "x"), (12, "revisit", 304, "http://a/x", None, TAG, None, None, "x"),
    (13, "response", 200, "http://c/", 5, None, "d", None, "x"), (14, "response", 200, "http://c/", 5, TAG, "d", "y" * 100_000, "x"),
    (15, "revisit", 304, "http://c/", 6, [("ETag", "zzz")], "d", None, "x"), (16, "revisit", 304, "http://c/", 7, [("ETag", "t1")], "d", None, "x"),
    (16, "revisit", 304, "http://c/", 7, [("ETag", "t1")], "d", None, "x"), (17, "request", None, "http://c/", 7, TAG, None, None, None),
    (18, "response", 200, None, None, None, None, None, None), (19, None, None, None, None, None, None, None, None),
    (20, "revisit", 304, "no scheme", 9, None, None, None, None), (21, "response", 200, "http://neg/", -5, TAG, None, "neg", None),
    (22, "revisit", 304, "http://neg/", -4, TAG, None, None, None),
]


@pytest.mark.parametrize("bucket", [10, 86_400])
def test_odd_records(spark, bucket):
    got = warc.resolve_revisits(spark.createDataFrame(RECORDS, SCHEMA), bucket).collect()
    assert Counter(map(plain, got)) == brute(RECORDS, address)


def test_many_captures_of_one_url(spark):
    records = [(i, "response" if i % 5 == 0 else "revisit", 200, "http://a/", i * 37 % 1_000, [("ETag", str(i % 3))], None, str(i), "") for i in range(800)]
    got = warc.resolve_revisits(spark.createDataFrame(records, SCHEMA), 60).collect()
    assert Counter(map(plain, got)) == brute(records, lambda u: "a")


def test_repeated_ids_keep_their_own_headers_and_bodies(spark):
    records = [
        (1, "response", 200, "http://a/", 10, [("ETag", "a")], None, "body a", ""), (1, "response", 200, "http://b/", 10, [("ETag", "b")], None, "body b", ""),
        (1, "response", 200, "http://b/", 10, [("ETag", "a")], None, "body of another tag", ""),
        (5, "revisit", 304, "http://a/", 20, [("ETag", "a"), ("X", "first")], None, None, ""), (5, "revisit", 304, "http://b/", 20, [("ETag", "b"), ("X", "second")], None, None, ""),
        (5, "revisit", 304, "http://a/", 20, [("ETag", "a"), ("X", "third")], None, None, ""), (5, "revisit", 304, "http://a/", 20, [("ETag", "a"), ("X", "third")], None, None, ""),
    ]
    got = warc.resolve_revisits(spark.createDataFrame(records, SCHEMA)).collect()
    assert Counter(map(plain, got)) == brute(records, address)
    assert sorted((r.url, r.headers[-1].value, r.body) for r in got) == [
        ("a", "first", "body a"), ("a", "third", "body a"), ("a", "third", "body a"), ("b", "second", "body b")
    ]


def test_empty(spark):
    assert warc.resolve_revisits(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    result = db.execute(ORACLES["op10_warc_revisits"])
    names = [d[0] for d in result.description]
    got = QUERIES["op10_warc_revisits"](spark, folder).select(*names).collect()
    assert Counter(map(tuple, got)) == Counter(result.fetchall())
    assert len({r.outcome for r in got}) == 4
