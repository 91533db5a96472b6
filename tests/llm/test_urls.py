"""URL verdicts against plain Python."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import pytest

from wardlake.llm import urls
from wardlake.llm.queries import ORACLES, QUERIES


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return lower(host), re.match(r"[^?#]*", rest[len(host) :]).group()


def brute_rule(host, path):
    found = [
        (len(d + p), d + p, v) for v, d, p in urls.RULES if (host == d or host.endswith("." + d)) and path.startswith(p)
    ]
    return max(found)[1:] if found else (None, None)


def brute_canonical(url):
    if url is None or "://" not in url:
        return None
    host, path = split(url)
    host = re.sub(r":(80|443)$", "", re.sub(r"^(www|m)\.", "", host))
    path = re.sub("/+$", "", re.sub(r"(/index)?\.html$", "", path))
    before = url.split("#", 1)[0]
    query = before.split("?", 1)[1] if "?" in before else ""
    kept = sorted(p for p in query.split("&") if p and not re.match(urls.TRACKING, p))
    return host + path + ("?" + "&".join(kept) if kept else "")


PAGES = [
    (1, None), (2, ""), (3, "no scheme"), (4, "http://net"), (5, "http://net/"), (6, "HTTP://WWW.Example.NET/en/x"), (7, "https://a.example.net/en"),
    (8, "https://example.net/EN/"), (9, "x://example.com/de/?q#f"), (10, "x://sub.example.com/de/y"), (11, "x://badexample.com/de/"), (12, "x://a.org/fr/"),
    (13, "x://org/fr/#top"), (14, "x://a.org:80/fr/"), (15, "x://a.org?/fr/"), (16, "x://É.net/Ä"), (17, "http://www.list.com/a/?b=2&a=1&utm_source=x#y"),
    (18, "https://list.com:443/a?a=1&b=2"), (19, "https://list.com/a/index.html?a=1&b=2&ref=q"), (20, "https://list.com/a?a=1"), (20, "https://list.com/a?a=1"),
    (None, "https://list.com/b"), (21, "http://h/" + "p" * 50_000), (22, "://"), (23, "a://b://c/d"), (24, "x://m.list.com/b.html"), (25, "x://y.net\n/z"),
]
LISTED = [("http://list.com/a?b=2&a=1",), (None,), ("no scheme",), ("https://m.list.com/b/",), ("https://m.list.com/b/",), ("http://h/" + "p" * 50_000,)]


def compare(pages, listed, got):
    known = {brute_canonical(u) for (u,) in listed} - {None}
    want = Counter()
    for page, url in pages:
        host, path = split(url)
        rule, verdict = brute_rule(host, path)
        hit = brute_canonical(url) in known
        want[page, host, path, rule, verdict or ("block" if hit else "allow"), hit] += 1
    assert Counter(map(tuple, got)) == want


@pytest.mark.parametrize("blocks", [1, 1 << 18])
def test_odd_pages(spark, monkeypatch, blocks):
    monkeypatch.setattr(urls, "MOST_BLOCKS", blocks)
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, host string")
    compare(PAGES, LISTED, urls.judge_urls(pages, spark.createDataFrame(LISTED, "link string")).collect())


def test_full_filter_still_gives_exact_verdicts(spark, monkeypatch):
    """One block for 5,000 URLs lets nearly all pages through to the exact join."""
    monkeypatch.setattr(urls, "MOST_BLOCKS", 1)
    listed = [(f"http://l.com/{i}",) for i in range(0, 10_000, 2)]
    pages = [(i, f"http://l.com/{i}") for i in range(1_000)]
    got = urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(listed, "url string"))
    compare(pages, listed, got.collect())


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge_urls(none, none.select("url")).collect() == []
    some = spark.createDataFrame([(1, "http://a/b")], none.schema)
    assert [r.verdict for r in urls.judge_urls(some, none.select("url")).collect()] == ["allow"]


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/pages.parquet").collect()
    got = QUERIES["op6_url_filter"](spark, folder)
    compare([(r.page_id, r.url) for r in rows], [(r.url,) for r in rows if len(r.html) < 900], got.collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    result = db.execute(ORACLES["op6_url_filter"])
    names = [d[0] for d in result.description]
    assert Counter(result.fetchall()) == Counter(map(tuple, got.select(*names).collect()))
