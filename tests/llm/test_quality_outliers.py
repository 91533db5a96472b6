"""Planted outliers among clean texts."""

from __future__ import annotations

import random

import pytest

from wardlake.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string"


def clean(rng, n=120):
    """Lines of distinct words."""
    found = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(n)]
    return "\n".join(" ".join(found[i : i + 10]) for i in range(0, n, 10))


def judged(spark, rows):
    return {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.mark.parametrize("share", [0.6, 0.8, 0.95])
def test_repeated_lines_alone_reject(spark, share):
    """Repeated lines of one or two short words each repeat few windows."""
    rng = random.Random(1)
    rows = [(i, clean(rng), "en", "a") for i in range(200)]
    for i in range(200, 204):
        lines = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(round(200 * (1 - share)))]
        lines += [rng.choice(lines) for _ in range(200 - len(lines))]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), "en", "a"))
    got = judged(spark, rows)
    assert all(got[i].kept for i in range(200))
    assert not any(got[i].base_failed or got[i].kept for i in range(200, 204))


def test_repeated_windows_alone_reject(spark):
    rng = random.Random(2)
    rows = [(i, clean(rng), "en", "a") for i in range(200)]
    for i in range(200, 204):
        words = clean(rng, 200).split()
        rows.append((i, " ".join(words + words[:62]), "en", "a"))
    got = judged(spark, rows)
    assert all(got[i].kept for i in range(200))
    assert not any(got[i].base_failed or got[i].kept for i in range(200, 204))


@pytest.mark.parametrize("kind", ["long words", "symbols", "one copied text"])
def test_much_junk_in_one_source(spark, kind):
    rng = random.Random(3)
    rows = [(i, clean(rng), "en", "a") for i in range(180)]
    copied = " ".join("".join(rng.choice("abcdefghij") for _ in range(15)) for _ in range(100))
    for i in range(180, 300):
        if kind == "long words":
            text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(10, 18))) for _ in range(120))
        elif kind == "symbols":
            text = " ".join(w + "#" * rng.randrange(1, 4) for w in clean(rng).split())
        else:
            text = copied
        rows.append((i, text, "en", "a"))
    got = judged(spark, rows)
    assert all(got[i].kept for i in range(180))
    assert not any(got[i].kept for i in range(180, 300))
