"""The approval queue in segments against a loop over each gateway."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from test_streaming import simulate

from wardlake.operators.admission import admissions
from wardlake.streaming.holds import HOLD_INPUT_SCHEMA

BASE = datetime(2026, 1, 1)


def events(seed, count, step_seconds, gateways):
    rng = random.Random(seed)
    rows, at = [], 0
    for i in range(count):
        at += rng.choice([0, 1, step_seconds, 3 * step_seconds])
        kind = rng.choice(["pause", "pause", "pause", "approve", "reject", "disconnect"])
        request = i - i % 3 if kind == "pause" else rng.randrange(max(0, i - 12), i + 3)
        rows.append((rng.choice(gateways), BASE + timedelta(seconds=at), i, kind, request))
    return rows


def wanted(rows, cap, timeout_seconds):
    ms = lambda t: int(t.replace(tzinfo=None).timestamp() * 1000)
    end = max(ms(r[1]) for r in rows)
    out = []
    for gateway in {r[0] for r in rows}:
        out += [(gateway, *o) for o in simulate([(ms(t), seq, kind, request) for g, t, seq, kind, request in rows if g == gateway], cap, timeout_seconds * 1000, end)]
    return sorted(out, key=str)


@pytest.mark.parametrize("cap,segment", [(1, 120), (3, 120), (3, 10_000_000), (40, 300)])
def test_same_as_a_loop(spark, cap, segment):
    rows = events(cap, 400, 20, ["hot", "hot", "hot", "cold", "é"])
    frame = spark.createDataFrame(rows, HOLD_INPUT_SCHEMA).repartition(5)
    out, rounds = admissions(frame, cap, segment, 300)
    assert sorted(map(tuple, out.collect()), key=str) == wanted(rows, cap, 300)
    assert rounds == 1 if segment > 1_000_000 else 1 < rounds < 40


def test_few_segments_run_again(spark):
    """A saturated gateway of many segments settles in a few rounds."""
    rows = events(5, 3_000, 10, ["hot"])
    out, rounds = admissions(spark.createDataFrame(rows, HOLD_INPUT_SCHEMA), 2, 1_200, 60)
    assert sorted(map(tuple, out.collect()), key=str) == wanted(rows, 2, 60)
    assert rounds <= 5


def test_no_events(spark):
    out, rounds = admissions(spark.createDataFrame([], HOLD_INPUT_SCHEMA), 2, 60)
    assert out.collect() == [] and rounds == 0
