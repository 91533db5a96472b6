"""Merged sketches against exact ranks."""

from __future__ import annotations

import bisect
import random

from pyspark.sql import functions as F

from wardlake.operators.run_metrics import daily_sketches, exact_quantiles, latency_report, merged


def test_ranks_of_merged_days(spark):
    rng = random.Random(1)
    rows = [(f"r{i % 2}", i % 7, rng.lognormvariate(0, 1)) for i in range(30_000)] + [("r0", 1, None), ("empty", 1, None)]
    frame = spark.createDataFrame(rows, "run string, day int, ms double").repartition(6)
    k = 400
    report = latency_report(merged(daily_sketches(frame, "ms", ["run", "day"], k), ["run"], k), ["run"], {"p50": 0.5, "p99": 0.99})
    got = {r.run: r for r in report.collect()}
    assert set(got) == {"r0", "r1"}
    for run, r in got.items():
        values = sorted(v for n, _, v in rows if n == run and v is not None)
        assert r.documents == len(values) and abs(r.mean - sum(values) / len(values)) < 1e-9
        assert abs(r.documents_per_second - 1000 / r.mean) < 1e-6
        for q, value in ((0.5, r.p50), (0.99, r.p99)):
            assert abs(bisect.bisect(values, value) / len(values) - q) < 1.7 / k + 1 / len(values)


def test_small_sketches_are_exact(spark):
    rows = [("r", i % 3, float(i)) for i in range(1, 101)]
    frame = spark.createDataFrame(rows, "run string, day int, ms double")
    r = latency_report(merged(daily_sketches(frame, "ms", ["run", "day"]), ["run"]), ["run"], {"p99": 0.99, "low": 0.0, "high": 1.0}).first()
    assert (r.p99, r.low, r.high, r.mean) == (99.0, 1.0, 100.0, 50.5)


def test_exact_quantiles_of_any_sketch(spark):
    """Also where the sketch is too small, is one of other values, or values are equal."""
    rng = random.Random(2)
    rows = [("a", round(rng.lognormvariate(0, 1), 1)) for _ in range(20_001)] + [("b", float(i)) for i in range(100)] + [(None, 7.0)] * 500 + [("a", None)]
    frame = spark.createDataFrame(rows, "run string, ms double").repartition(5)
    asked = {"p99": 0.99, "p50": 0.5, "least": 0.0, "most": 1.0, "p07": 0.07}

    def want(run):
        values = sorted(v for r, v in rows if r == run and v is not None)
        n = len(values)
        return [values[max(1, n - n * (100 - q) // 100) - 1] for q in (99, 50, 0, 100, 7)]

    for k, shifted in ((8, 0), (8_192, 0), (64, 50)):
        sketches = daily_sketches(frame.withColumn("ms", F.col("ms") + shifted), "ms", ["run"], k)
        got = {r.run: [r[c] for c in asked] for r in exact_quantiles(frame, "ms", sketches, ["run"], asked, k).collect()}
        assert got == {run: want(run) for run in ("a", "b", None)}
