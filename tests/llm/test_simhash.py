"""SimHash groups against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from wardlake.llm import simhash
from wardlake.llm.components import components
from wardlake.llm.queries import QUERIES


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows, bits=2):
    """doc_id lists by smallest reachable id, of (doc_id, fp) rows."""
    forest = simhash.Forest(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= bits:
                forest.add(i, j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        root = forest.root(i)
        known = [x for x in (least.get(root), doc) if x is not None]
        least[root] = min(known) if known else None
    return [least[forest.root(i)] for i in range(len(rows))]


def compare(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string, fp string")
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    rows = [(d, brute_fingerprint(t)) for d, t, _ in texts]
    want = sorted((str(d), f"{fp:016x}", c) for (d, fp), c in zip(rows, brute_groups(rows)))
    assert got == want


def test_odd_rows(spark):
    compare(spark, [
        (3, None, "x"), (1, "", "x"), (2, " \t\n", None), (9, "One two", "x"), (8, "one two", "x"), (8, "one two", "x"),
        (None, "lone null id", "x"), (5, "A b c d", "x"), (4, "a B C D", "x"), (7, "word " * 70_000, "x"), (6, "É é x y", "x"),
    ])


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_trie_pairs(bits):
    rng = random.Random(bits)
    base = [rng.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]
    values = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1 for b in base for _ in range(20)}
    ordered = np.array(sorted(values), np.uint64)
    got = [(i, j) for left, right in simhash.trie_pairs(ordered, bits, leaf=2) for i, j in zip(left.tolist(), right.tolist())]
    assert len(got) == len(set(got))
    want = {(i, j) for j in range(len(ordered)) for i in range(j) if (int(ordered[i]) ^ int(ordered[j])).bit_count() <= bits}
    assert {(min(p), max(p)) for p in got} == want


@pytest.mark.parametrize("most", [3, 20_000])
def test_hot_subtrees_are_cut_without_loss(spark, most):
    rng = random.Random(7)
    values = {0x1234567890ABCDEF ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(64)) for _ in range(400)}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    links = simhash.trie_links(spark.createDataFrame([(v,) for v in values], "fp long"), most=most)
    labels = {r.node: r.component for r in components(links).collect()}
    unsigned = [(v, v % (1 << 64)) for v in values]
    want = brute_groups(unsigned)
    assert [labels.get(v, v) for v in values] == want


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = sorted((d, f"{fp:016x}", c) for (d, fp), c in zip(rows, brute_groups(rows)))
    assert sorted(map(tuple, QUERIES["op5_simhash_near_dedup"](spark, folder).collect())) == want
