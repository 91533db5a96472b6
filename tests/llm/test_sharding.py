"""Placement against the written-out permutations."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest

from wardlake.llm import sharding
from wardlake.llm.queries import QUERIES, SHARDS


def digest(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def brute_table(shards, slots):
    preference = {
        s: iter([(digest(f"offset:{s}") % slots + j * (digest(f"stride:{s}") % (slots - 1) + 1)) % slots for j in range(slots)]) for s in shards
    }
    table = {}
    while len(table) < slots:
        for shard, weight in shards.items():
            for _ in range(weight):
                if len(table) < slots:
                    table[next(x for x in preference[shard] if x not in table)] = shard
    return [table[i] for i in range(slots)]


@pytest.mark.parametrize("shards, slots", [({"a": 1}, 7), ({"a": 1, "b": 1, "c": 2}, 101), ({f"s{i}": i % 3 + 1 for i in range(20)}, 1_009)])
def test_table(shards, slots):
    names = list(shards)
    assert [names[i] for i in sharding.lookup_table(shards, slots)] == brute_table(shards, slots)


def test_even_and_stable():
    shards = {f"s{i}": 1 for i in range(40)}
    before = sharding.lookup_table(shards)
    share = Counter(before)
    assert max(share.values()) - min(share.values()) <= 1
    fewer = {s: w for s, w in shards.items() if s != "s7"}
    names, left = list(shards), list(fewer)
    moved = sum(names[a] != left[b] for a, b in zip(before, sharding.lookup_table(fewer)) if names[a] != "s7")
    assert moved / len(before) < 0.05


@pytest.mark.parametrize("shards, slots", [({}, 7), ({"a": 0}, 7), ({"a": 1}, 8), ({"a": 9}, 7)])
def test_unusable(shards, slots):
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, slots)


def test_odd_keys(spark):
    keys = [None, "", "a", "a", "é漢", "x" * 100_000]
    rows = spark.createDataFrame([(k, i, "old") for i, k in enumerate(keys)], "key string, slot int, Shard string")
    table = brute_table({"a": 1, "b": 2}, 101)
    got = sharding.place(rows, "key", {"a": 1, "b": 2}, 101).collect()
    want = Counter((k, digest(k or "") % 101, table[digest(k or "") % 101]) for k in keys)
    assert Counter((r.key, r.slot, r.shard) for r in got) == want


def test_key_named_like_a_result(spark):
    got = sharding.place(spark.createDataFrame([(5,)], "slot long"), "slot", {"a": 1}, 7).collect()
    assert [(r.slot, r.shard) for r in got] == [(digest("5") % 7, "a")]


def test_empty(spark):
    assert sharding.place(spark.createDataFrame([], "key long"), "key", {"a": 1}, 7).collect() == []


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    table = brute_table(SHARDS, sharding.SLOTS)
    ids = [r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = {(i, digest(str(i)) % sharding.SLOTS, table[digest(str(i)) % sharding.SLOTS]) for i in ids}
    assert {(r.doc_id, r.slot, r.shard) for r in QUERIES["op2_shard_placement"](spark, folder).collect()} == want
