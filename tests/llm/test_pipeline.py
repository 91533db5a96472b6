"""Every stage of the pipeline against a plain version over its own input."""

from __future__ import annotations

from collections import Counter

import pytest
from test_mixing import WORD, brute_targets
from test_near_copies import brute_kept
from test_packing import check as check_packing
from test_quality import brute as brute_quality
from test_secret_scan import brute_base

import corpus_pipeline
from wardlake.llm import packing, quality
from wardlake.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Rows before the first stage and after each one."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        folder = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, FOLDER).write.parquet(folder)
        docs = spark.read.parquet(folder)
        out.append(docs.collect())
    return out


def test_stage_columns(steps):
    assert all(list(rows[0].asDict()) == COLUMNS for rows in steps[:-1])


def test_quality(steps):
    before, after = steps[0], steps[1]
    judged = brute_quality([tuple(r)[:4] for r in before])
    want = [r for r, (_, failed, d2) in zip(before, judged) if not failed and d2 <= quality.LIMIT]
    assert sorted(map(tuple, after)) == sorted(map(tuple, want)) and len(want) < len(before)


def test_one_of_each_group_stays(steps):
    before, after = steps[1], steps[2]
    kept = set(brute_kept([(r.doc_id, r.text) for r in before]))
    want = [r for r in before if r.doc_id in kept]
    assert sorted(map(tuple, after)) == sorted(map(tuple, want)) and len(want) < len(before)


def test_secrets_are_masked(steps):
    before, after = ({r.doc_id: r for r in rows} for rows in steps[2:4])
    assert before.keys() == after.keys()
    for i, row in after.items():
        *counts, _, _ = brute_base(row.text)
        assert sum(counts) == 0 and row.n_chars == len(row.text)
        if not any(brute_base(before[i].text)[:3]) and "[SECRET]" not in row.text:
            assert row.text == before[i].text
        assert (row.lang, row.source) == (before[i].lang, before[i].source)


def test_sources_come_near_their_targets(steps):
    before, after = steps[3], steps[4]
    known = {tuple(r): len(WORD.findall(r.text)) for r in before}
    times = Counter(map(tuple, after))
    assert times.keys() <= known.keys() and max(times.values()) <= 3
    sizes, taken, largest = Counter(), Counter(), Counter()
    for row, size in known.items():
        sizes[row[3]] += size
        taken[row[3]] += times[row] * size
        largest[row[3]] = max(largest[row[3]], size)
    targets = brute_targets(sizes)
    assert all(abs(taken[s] - targets[s]) <= largest[s] for s in sizes)


def test_packing(steps):
    check_packing([(r.doc_id, len(WORD.findall(r.text))) for r in steps[4]], steps[5], packing.LENGTHS)


def test_query_runs_all_stages(spark, steps):
    got = QUERIES["pipeline"](spark, FOLDER).collect()
    assert Counter((r.doc_id, r.piece, r.length) for r in got) == Counter((r.doc_id, r.piece, r.length) for r in steps[-1])


ODD = [
    (1, None, None, None, None), (None, "a b c " * 40, "en", "a", 1), (None, "a b c " * 40, "en", "a", 1), (2, "", "en", "a", 0),
    (3, " ".join(f"w{i}" for i in range(80)), "en", "a", 9), (3, " ".join(f"w{i}" for i in range(80)), "en", "a", 9),
    (3, " ".join(f"v{i}" for i in range(80)), "en", None, 9), (4, "token = abcdefgh12 " + " ".join(f"u{i}" for i in range(80)), "en", "a", 9),
    (None, " ".join(f"t{i}" for i in range(80)), "en", "b", 9), (5, " ".join(f"t{i}" for i in range(90_000)), "en", "b", 9),
]


def test_odd_rows(spark):
    """Null ids, repeated rows, extra columns with names that the stages use themselves."""
    extra = "doc_id long, text string, lang string, source string, n_chars long, size string, fp string, row string, n_words string"
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in ODD], extra)
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, FOLDER)
        if name != "best_fit_packing":
            assert after.columns == docs.columns
        docs = spark.createDataFrame(after.collect(), after.schema)
        if name == "quality_rules":
            assert Counter(r.doc_id for r in docs.collect()) == {3: 3, 4: 1, None: 1}
        if name == "simhash_near_dedup":
            assert Counter(r.doc_id for r in docs.collect()) == {3: 2, 4: 1, None: 1}
        if name == "secret_scans":
            assert [r.text.split(" ")[0] for r in docs.where("doc_id = 4").collect()] == ["[SECRET]"]
    assert docs.count()


@pytest.mark.parametrize("name", STAGE)
def test_empty(spark, name):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert STAGE[name](spark, docs, FOLDER).collect() == []
