"""Ranked search against scores of every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from wardlake.llm import lexical
from wardlake.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(docs, items, k=20):
    """Sorted (item_id, rank, doc_id, score)."""
    counted = [(i, Counter(t), len(t)) for i, text in docs if (t := brute_terms(text))]
    n_docs, n_terms = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        asked = Counter(brute_terms(text))
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in asked}
        scores = []
        for doc, c, n in counted:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = sum(weight[t] * r * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, r in asked.items() if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, n + 1, doc, -s) for n, (s, _, _, doc) in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return sorted(out, key=order)


def order(r):
    return (r[0] is None, str(r[0]), r[1], r[2] is None, r[2] or 0, r[3])


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, digest string, item int").repartition(3),
        spark.createDataFrame([(*i, 7) for i in items], "item_id string, text string, doc_id int"),
    )


def check(spark, docs, items, k=20):
    got = lexical.search(*frames(spark, docs, items), k=k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=order) == brute(docs, items, k)


def corpus(seed, n=400):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.expovariate(0.02))}"
    docs = [(i, " ".join(word() for _ in range(rng.choice([3, 20, 90, 400])))) for i in range(n)]
    items = [(f"i{i}", " ".join(word() for _ in range(rng.randrange(1, 30)))) for i in range(12)]
    return docs, items


@pytest.mark.parametrize("k", [1, 20])
def test_random_corpus(spark, k):
    check(spark, *corpus(1), k=k)


def test_small_blocks_and_full_signatures(spark, monkeypatch):
    """Bounds that exclude little, many blocks of documents and of items: the same result."""
    for name, value in (("BLOCK_DOCS", 5), ("WIDEST", 128), ("ITEM_TERMS", 40)):
        monkeypatch.setattr(lexical, name, value)
    check(spark, *corpus(2, 150))


def test_terms_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", 3)
    monkeypatch.setattr(lexical, "_CACHE_TERMS", 10)
    check(spark, *corpus(3, 150))


def test_odd_rows(spark):
    rng = random.Random(4)
    docs = [(1, None), (2, ""), (3, " .,! \n"), (4, "Ärger ärger ÄRGER straße"), (5, "İstanbul K k ſ"), (6, "漢字 漢字,漢字"), (7, "a" * 200_000), (8, "zzz " * 50_000)]
    docs += [(9, " ".join(f"long{rng.randrange(10**9)}" for _ in range(60_000)) + " needle"), (None, "needle in hay"), (None, "needle in hay"), (10, "needle in hay")]
    docs += [(20, "needle copy"), (20, "needle copy"), *[(100 + i, "the same text many times") for i in range(60)], *[(7, "the same text")] * 40]
    items = [("a", "needle"), ("a", "needle needle hay"), (None, "the same"), ("b", "Ärger İstanbul k"), ("c", None), ("d", ""), ("e", "absent words"), ("f", "漢字 zzz " + "a" * 200_000), ("g", "times, times; The")]
    check(spark, docs, items)


@pytest.mark.parametrize("docs,items", [([], [("a", "x")]), ([(1, "x")], []), ([(1, None)], [("a", "x")]), ([(1, "x")], [("a", "x x")])])
def test_few_rows(spark, docs, items):
    check(spark, docs, items)


def test_bounds_hold_and_exclude():
    """No bound is below the score, and few documents reach the k-th score."""
    docs, items = corpus(5, 3_000)
    counted = [Counter(t.encode() for t in brute_terms(x)) for _, x in docs]
    df = Counter(t for c in counted for t in c)
    queries = lexical.Queries(items, df, len(docs), sum(c.total() for c in counted))
    writer, blocks = lexical.BlockWriter(), []
    for (i, _), c in zip(docs, counted):
        hashes = np.array([lexical._Hashes()[t] for t in c], np.uint64)
        blocks += writer.add((i, b"", c.total()), hashes, np.array(list(c.values())))
    blocks += writer.rest()
    assert sum(len(b[2]) for b in blocks) == len(docs)
    reached = 0
    scores = np.array([queries.scores(x, list(range(len(items)))) for _, x in docs])
    least = np.sort(scores, axis=0)[-20]
    for width, slices, members in blocks:
        bound = queries.bounds(width, slices, np.array([m[2] for m in members]), np.array([m[3] for m in members]))
        assert (bound.T >= scores[[m[0] for m in members]]).all()
        reached += (bound.T >= least).sum()
    assert reached < 0.1 * scores.size


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op11_lexical_search"](spark, folder).collect()), key=order) == brute(docs, items)
