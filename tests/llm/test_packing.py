"""Packing against a naive best fit and its own promises."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from wardlake.llm import packing
from wardlake.llm.queries import QUERIES


def naive(sizes, permitted, preferred):
    """Best fit by looking at every open bin."""
    bins, out, left = [], [], sum(sizes)
    for size in sizes:
        fits = [b for b in range(len(bins)) if bins[b][0] - bins[b][1] >= size]
        if fits:
            room = min(bins[b][0] - bins[b][1] for b in fits)
            b = max((b for b in fits if bins[b][0] - bins[b][1] == room), key=lambda b: bins[b][2])
        else:
            allowed = [c for c in permitted if c >= size]
            if preferred is None:
                length = min(allowed, key=lambda c: (packing.cost(c) / min(c, left), c))
            else:
                length = preferred if preferred in allowed else allowed[0]
            b = len(bins)
            bins.append([length, 0, 0])
        out.append((b, bins[b][1]))
        bins[b][1] += size
        bins[b][2] = len(out)  # of equal rooms, the bin touched last
        left -= size
    return out, [b[1] for b in bins]


@pytest.mark.parametrize("seed", range(5))
def test_best_fit(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randint(1, 64) for _ in range(300)), reverse=True)
    totals = []
    for preferred in (None, 16, 32, 64):
        bins, offsets, filled = packing._pack(sizes, (16, 32, 64), preferred)
        assert (list(zip(bins, offsets)), filled) == naive(sizes, (16, 32, 64), preferred)
        totals.append(sum(packing.cost(next(c for c in (16, 32, 64) if c >= f)) for f in filled))
    assert sum(map(packing.cost, packing.pack_pool(sizes, (16, 32, 64))[2])) == pytest.approx(min(totals))


def check(lengths, got, permitted):
    """lengths: (doc_id, length) rows."""
    longest = permitted[-1]
    want = []
    for doc, length in lengths:
        length = length or 0
        pieces = max(1, -(-length // longest))
        want += [(str(doc), i, i * longest, min(longest, length - i * longest)) for i in range(pieces)]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length) for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        if r.length:
            bins[r.bin_id, r.bin_length].append((r.offset, r.length))
        else:
            assert (r.bin_id, r.bin_length, r.offset) == (None, None, None)
    assert len({b for b, _ in bins}) == len(bins)
    for (_, length), parts in bins.items():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert length == next(c for c in permitted if c >= at)


ODD = [(1, None), (2, 0), (3, 5), (3, 5), (None, 70), (4, 1_000), (5, 64), (6, 65)] + [(i, i % 63 + 1) for i in range(100, 400)]


@pytest.mark.parametrize("pool", [7, 100, 32_768])
def test_odd_rows(spark, pool):
    docs = spark.createDataFrame([(d, n, "x") for d, n in ODD], "doc_id long, length long, bin_id string")
    check(ODD, packing.pack(docs, (16, 32, 64), pool).collect(), (16, 32, 64))


def test_a_repeated_row_is_dealt_evenly(spark):
    docs = spark.createDataFrame([(1, 10)] * 2_000, "doc_id long, length long")
    packed = packing.pack(docs, (16, 32, 64), 500).collect()
    check([(1, 10)] * 2_000, packed, (16, 32, 64))


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, length long")).collect() == []


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    lengths = [(r.doc_id, len(r.text.split())) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = QUERIES["op8_best_fit_packing"](spark, folder).collect()
    check(lengths, got, packing.LENGTHS)
    placed = {r.bin_id: r.bin_length for r in got if r.length}
    assert sum(n for _, n in lengths) > 0.9 * sum(placed.values())
