"""Near copies against brute-force Jaccard similarity."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from wardlake.llm import near_copies
from wardlake.llm.simhash import Forest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_shingles(text):
    found = (text or "").lower().split()
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))}


def brute_kept(rows):
    """Smallest id of each group, of (doc_id, text) rows with distinct ids."""
    sets = [brute_shingles(t) for _, t in rows]
    forest = Forest(len(rows))
    for i, s in enumerate(sets):
        for j in range(i):
            common = len(s & sets[j])
            if 5 * common >= 4 * (len(s) + len(sets[j]) - common):
                forest.add(i, j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[forest.root(i)] = min(doc, least.get(forest.root(i), doc))
    return sorted(least.values())


def planted():
    """Texts, copies of them with up to a tenth of the shingles changed, and chains of copies."""
    rng = random.Random(3)
    texts = []
    for _ in range(25):
        text = [f"w{rng.randrange(5_000)}" for _ in range(rng.randrange(60, 300))]
        texts.append(text)
        for _ in range(rng.randrange(6)):
            copy = list(rng.choice(texts[-3:]))
            for _ in range(rng.randrange(1, 2 + len(copy) // 40)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(5_000)}"
            texts.append(copy)
    texts += [[], ["a", "b"], ["A", "B"], ["a", "b", "c"]]
    return [(i, " ".join(t)) for i, t in enumerate(texts)] + [(len(texts), None), (len(texts) + 1, " \n ")]


def test_stage_drops_planted_copies(spark):
    rows = planted()
    docs = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], SCHEMA)
    got = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == brute_kept(rows)


def half_alike(count):
    """Texts that share half of their words with all others, and with some of them a little more."""
    rng = random.Random(7)
    common = [f"c{i}" for i in range(120)]
    texts = []
    for i in range(count):
        own = [f"o{i}x{j}" for j in range(60)]
        shared = [f"s{i % 40}x{j}" for j in range(rng.randrange(50, 70))]
        texts.append(" ".join(common + shared + own))
    return texts


def test_many_half_alike_texts(spark, monkeypatch):
    """A group that shares keys but is not similar makes few candidates; its near copies are found."""
    texts = half_alike(2_000)
    rows = list(enumerate([*texts, *(t + " and one more" for t in texts[:50])]))
    docs = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], SCHEMA).repartition(8)
    made = []
    plain = near_copies.similar
    monkeypatch.setattr(near_copies, "similar", lambda d, pairs, t: made.append(pairs.count()) or plain(d, pairs, t))
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == list(range(2_000))
    assert sum(made) < 30 * len(rows)


def test_edits_of_one_text(spark):
    """Similarities on both sides of the limit, with chains: groups are those of brute force."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(400):
        text = list(base[: rng.randrange(120, 151)])
        for _ in range(rng.randrange(1, 8)):
            text[rng.randrange(len(text))] = f"e{rng.randrange(60)}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], SCHEMA).repartition(8)
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == brute_kept(rows)


def test_prefixes_lose_no_pair(spark):
    """Every similar pair of different groups is a candidate, whatever the sizes."""
    rng = random.Random(11)
    sets = {}
    for i in range(300):
        universe = range(1, 12) if i % 3 else range(20, 140)
        sets[i] = sorted(rng.sample(universe, rng.randrange(1, 10) if i % 3 else rng.randrange(90, 115)))
    frame = spark.createDataFrame([(i, s) for i, s in sets.items()], "node long, s array<bigint>")
    nodes = spark.createDataFrame([(i, len(s), i) for i, s in sets.items()], "node long, n long, group long")
    got = {(r.a, r.b) for r in near_copies.prefix_pairs(frame, nodes).collect()}
    for i in sets:
        for j in range(i):
            k = len(set(sets[i]) & set(sets[j]))
            if 5 * k >= 4 * (len(sets[i]) + len(sets[j]) - k):
                assert (j, i) in got
    assert len(got) < 300 * 299 / 4


def test_components_with_hubs(spark, monkeypatch):
    from wardlake.llm import components

    monkeypatch.setattr(components, "HUB", 4)
    rng = random.Random(13)
    pairs = [(0, i) for i in range(50, 90)] + [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    forest = Forest(400)
    for a, b in pairs:
        forest.add(a, b)
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    want = {x: min(y for y in nodes if forest.root(y) == forest.root(x)) for x in nodes}
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == brute_kept(rows)
