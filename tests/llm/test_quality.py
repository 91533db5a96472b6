"""Statistics and robust estimates against plain Python and numpy."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np

from wardlake.llm import quality
from wardlake.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_statistics(text):
    text = text or ""
    found = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(zip(found, found[1:], found[2:]))
    covered = set()
    for i in range(len(found) - 2):
        if windows[tuple(found[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(found), sum(map(len, found)), symbols, len(lines) - len(set(lines)), len(covered), len(lines)


def brute_vector(s):
    n, chars = max(s[0], 1), max(s[1], 1)
    return [math.log(chars / n), math.sqrt(s[2] / chars), math.sqrt(s[3] / max(s[5], 1)), math.sqrt(s[4] / n)]


def nth(values, share):
    return sorted(values)[max(0, math.ceil(share * len(values)) - 1)]


def brute_model(x):
    """Centre and covariance of an (n, P) array by the same steps."""
    floor = np.diag(np.square(quality.FLOORS))
    centre = np.array([nth(x[:, i], 0.5) for i in range(quality.P)])
    spread = np.array([1.4826 * nth(np.abs(x[:, i] - centre[i]), 0.5) for i in range(quality.P)])
    covariance = np.diag(spread**2) + floor
    for step in range(quality.STEPS + 1):
        off = x - centre
        d2 = np.einsum("ni,ij,nj->n", off, np.linalg.inv(covariance), off)
        last = step == quality.STEPS
        cut = max(quality._REWEIGHT_CUT, nth(d2, 0.5)) if last else nth(d2, quality.CORE)
        core = x[d2 <= cut]
        centre = core.mean(0)
        covariance = np.cov(core.T, bias=True) * (1 if last else quality._CORE_FACTOR) + floor
    return centre, covariance


def brute(rows):
    """(statistics, base_failed, d2) per (doc_id, text, lang, source) row."""
    stats = [brute_statistics(t) for _, t, *_ in rows]
    failed = [s[0] < 50 or 100 * s[4] > 50 * s[0] for s in stats]
    members = defaultdict(list)
    for i, row in enumerate(rows):
        if not failed[i]:
            members[row[2:4]].append(i)
    vectors = np.array([brute_vector(s) for s in stats])
    pool = [i for m in members.values() if len(m) < quality.LEAST_ROWS for i in m]
    models = {g: brute_model(vectors[m if len(m) >= quality.LEAST_ROWS else pool]) for g, m in members.items()}
    out = []
    for i, row in enumerate(rows):
        model = models.get(row[2:4])
        off = vectors[i] - model[0] if model else None
        out.append((stats[i], failed[i], off @ np.linalg.inv(model[1]) @ off if model else None))
    return out


def compare(rows, got):
    want = sorted(((r[0] is None, r[0] or 0, s[:5], f), d) for r, (s, f, d) in zip(rows, brute(rows)))
    have = sorted(((r.doc_id is None, r.doc_id or 0, tuple(r[1:6]), r.base_failed), r.d2, r.kept) for r in got)
    assert [w[0] for w in want] == [h[0] for h in have]
    for (_, d2), (_, found, kept), w in zip(want, have, want):
        assert (found is None) == (d2 is None)
        if d2 is not None:
            assert math.isclose(found, d2, rel_tol=1e-6, abs_tol=1e-6)
        assert kept == (not w[0][3] and (d2 or 0) <= quality.LIMIT)


SOUND = " ".join(f"word{i} and more" for i in range(40))
ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t\n ", None, None), (4, "x " * 60, "en", "a"), (5, SOUND, None, "a"), (5, SOUND, None, "a"),
    (6, "a b c\na b c\n\n a b c\n" + SOUND, "en", None), (None, SOUND + " # | <>$%&*", "en", "a"), (7, "aa bb aa bb aa\r\nbb\x0baa " + SOUND, "de", "a"),
    (8, "word" * 50_000 + " " + SOUND, "en", "a"), (9, "é漢 " * 30 + SOUND, "en", "a"), (10, SOUND + "\n" + "p q r s t u v w " * 20_000, "en", "a"),
    (11, "one two three four " * 30, "en", "a"),
]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(*r, 1) for r in ODD], "doc_id long, text string, lang string, source string, n_words int")
    compare(ODD, quality.quality(docs).collect())


def test_keep_sound(spark):
    docs = spark.createDataFrame([(*r, 1) for r in ODD], "doc_id long, text string, lang string, source string, d2 int")
    kept = quality.keep_sound(docs)
    assert kept.columns == docs.columns
    want = [r for r, (_, f, d) in zip(ODD, brute(ODD)) if not f and (d or 0) <= quality.LIMIT]
    assert sorted(map(str, (tuple(r)[:4] for r in kept.collect()))) == sorted(map(str, want))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert quality.quality(docs).collect() == [] and quality.keep_sound(docs).collect() == []


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = QUERIES["op9_quality_rules"](spark, folder).collect()
    compare(rows, got)


def test_large_groups_have_their_own_estimate(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(quality, "LEAST_ROWS", 3)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    compare([(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()], quality.quality(docs).collect())
