"""Whitened components against exact sums and a dense eigensolver."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from wardlake.llm import whitening
from wardlake.llm.queries import QUERIES

NAN, INF = float("nan"), float("inf")


def brute(rows, most=4):
    """{(vec_id, component): (n, deviation, whitened)}, shares and the covariance of the fit list."""
    kept = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(x) for _, x in kept]
    size = max(set(lengths), key=lambda n: (lengths.count(n), n))
    kept = [r for r in kept if len(r[1]) == size]
    fit = sorted({x for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for x in fit])
    v = y.T @ y / n
    values, vectors = np.linalg.eigh(v)
    order = [k for k in np.argsort(-values)[:most] if values[k] > 1e-11 * max(values.max(), 1e-300)]
    out = []
    for i, x in kept:
        centred = np.array([float(Fraction(n * c - s, n)) for c, s in zip(x, sums)])
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        out += [(i, c + 1, n, deviation, abs(centred @ vectors[:, k]) / math.sqrt(values[k])) for c, k in enumerate(order)]
    return out, [values[k] / np.trace(v) for k in order]


def key(r):
    return (r[0] is None, r[0] or 0, r[1], r[3], r[4])


def check(frame, rows):
    want, shares = brute(rows)
    got = [tuple(r) for r in frame.collect()]
    assert len(got) == len(want)
    for g, w in zip(sorted(((*r[:4], abs(r[4])) for r in got), key=key), sorted(want, key=key)):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], abs=1e-7)
    assert {r[1]: r[5] for r in got} == pytest.approx({i + 1: s for i, s in enumerate(shares)}, rel=1e-9)
    assert len({r[6] for r in got}) == 1 and got[0][6] < 1e-8


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, n string, w int")


def test_factor_signs():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = rng.normal(size=(d := rng.integers(1, 30), d))
        a = a + a.T
        if rng.integers(2):
            np.fill_diagonal(a, 0)  # needs 2 x 2 blocks
        values = np.linalg.eigvalsh(a)
        if np.abs(values).min() > 1e-9:
            assert whitening.factor_signs(a) == (values > 0).sum()


def test_close_and_equal_eigenvalues():
    rng = np.random.default_rng(1)
    for values in ([3, 3, 3, 3, 3], [1, 1, 1 - 1e-9, 1 - 2e-9, 0.5], [5, 1e-3, 1e-3, 1e-9, 1e-9], [2, 1, 0, 0], [0, 0], [1e-300], []):
        d = len(values)
        q = np.linalg.qr(rng.normal(size=(d, d)))[0] if d else np.zeros((0, 0))
        v = q @ np.diag(values) @ q.T
        v = (v + v.T) / 2
        pairs = whitening.leading_pairs(v)
        assert [e for e, _ in pairs] == pytest.approx([x for x in values[:4] if x > 0], abs=1e-14 * d * max(values, default=0))
        for e, u in pairs:
            assert np.linalg.norm(v @ u - e * u) <= 1e-13 * d * max(values)
        if pairs:
            u = np.array([u for _, u in pairs])
            assert np.abs(u @ u.T - np.eye(len(pairs))).max() < 1e-9


def test_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=6) * [9, 5, 3, 2, 1, 0.5] + 40).tolist()) for i in range(60)]
    rows += [(100, None), (101, []), (102, [NAN] * 6), (103, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (104, [INF] + [0.0] * 5), (105, [1.0, 2.0]), (107, [-0.0] * 6)]
    rows += [(None, rows[3][1]), (None, rows[4][1]), *[(5, rows[5][1])] * 300]
    check(whitening.whiten(frame(spark, rows).repartition(5)), rows)


def test_large_components(spark):
    """Deviations beyond 64 bits are null; a component that no bigint holds takes no part."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.integers(-(10**14), 10**14, 3)]) for i in range(20)]
    got = whitening.whiten(frame(spark, [*rows, (99, [1e300, 0.0, 0.0])])).collect()
    assert {r.vec_id for r in got} == set(range(20)) and all(r.deviation is None for r in got) and got[0].identity_error < 1e-9
    rows = [(i, [float(c) for c in rng.integers(-(10**5), 10**5, 3) + 10**12]) for i in range(20)]
    check(whitening.whiten(frame(spark, rows)), rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_no_components(spark, rows):
    out = whitening.whiten(frame(spark, rows))
    assert out.collect() == []
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_line_and_plane(spark):
    check(whitening.whiten(frame(spark, rows := [(1, [1.0, 2.0]), (2, [3.0, 1.0])])), rows)
    rows = [(i, [float(i), float(i * i % 7), float(i + i * i % 7)]) for i in range(9)]
    assert {r.component for r in whitening.whiten(frame(spark, rows)).collect()} == {1, 2}


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(QUERIES["op13_embedding_whitening"](spark, folder), rows)
