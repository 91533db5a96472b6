"""Generators, corpora, contracts, scoring and gates."""

from __future__ import annotations

import random

import pytest
from conftest import results, texts
from pyspark.sql import functions as F

from wardlake.functions import synth
from wardlake.labels import LABELS
from wardlake.operators import corpus, scoring
from wardlake.schemas import EVAL_SCHEMA, KDPII_SCHEMA
from wardlake.sources.files import read_kdpii, read_records, write_records

M = 0xFFFFFFFF


def stream(seed):
    a = seed
    while True:
        a = (a + 0x6D2B79F5) & M
        t = ((a ^ (a >> 15)) * (a | 1)) & M
        t = ((t + (((t ^ (t >> 7)) * (t | 61)) & M)) & M) ^ t
        yield t ^ (t >> 14)


def test_draws_match_the_sequential_generator(spark):
    source = stream(42)
    want = [next(source) for _ in range(500)]
    df = spark.range(1, 501).select("id", synth.draw(42, F.col("id")).alias("u")).orderBy("id")
    assert [r.u for r in df.collect()] == want
    assert spark.range(1).select(synth.draw(42, F.lit((1 << 32) + 1))).first()[0] == want[0]


def below(u, n):
    return u * n >> 32


def test_first_positives_by_hand(spark):
    u = stream(42)
    first = corpus.positives(spark, 2, 42).where("id = 'synthetic-00000'").first()
    yy, mm, dd, s = below(next(u), 100), below(next(u), 12) + 1, below(next(u), 28) + 1, below(next(u), 4) + 1
    body = f"{yy:02d}{mm:02d}{dd:02d}{s}" + "".join(str(below(next(u), 10)) for _ in range(5))
    check = (11 - sum(int(x) * w for x, w in zip(body, [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5])) % 11) % 10
    value = f"{body[:6]}-{body[6:]}{check}"
    assert first.text == f"제 주민등록번호는 {value} 입니다."
    assert first.spans[0].text == value and first.meta.split == "dev"


@pytest.fixture(scope="module")
def positives(spark):
    return corpus.positives(spark).cache()


@pytest.fixture(scope="module")
def negatives(spark):
    return corpus.negatives(spark).cache()


def test_standard_sets(spark, positives, negatives):
    labels, _ = corpus.label_tables(spark, LABELS)
    assert positives.count() == 1260 and positives.select("id").distinct().count() == 1260
    assert negatives.count() == 2000 and negatives.select("id").distinct().count() == 2000
    for records in (positives, negatives):
        assert corpus.span_violations(records, labels).count() == 0
        assert corpus.record_violations(records).count() == 0
    assert positives.repartition(7).exceptAll(positives).count() == 0


def test_gates_pass(spark, positives, negatives):
    scores = scoring.score(positives, scoring.predict(positives))
    assert scoring.gate_synth(scoring.gated_scores(spark, scores)).count() == 0
    by_label = {r.label: r for r in scores.collect()}
    assert by_label["ACCOUNT"].f1 == 0.0
    assert all(by_label[label].f1 == 1.0 for label in ("RRN", "CREDIT_CARD", "PHONE", "EMAIL", "IP"))
    gate = scoring.gate_negative(scoring.document_counts(negatives, scoring.predict(negatives))).first()
    assert gate.passed, gate


def test_gate_reports_offenders(spark, positives):
    broken = scoring.predict(positives).where("surface <> 'sql'")
    offenders = scoring.gate_synth(scoring.gated_scores(spark, scoring.score(positives, broken))).collect()
    assert {(o.label, o.measure) for o in offenders} >= {("TIER1", "f1")}


def overlap(a, b):
    x, y = a.strip().lower(), b.strip().lower()
    return bool(x and y) and (x in y or y in x)


def greedy(gold, predicted):
    used = set()
    for p in predicted:
        for i, g in enumerate(gold):
            if i not in used and overlap(p, g):
                used.add(i)
                break
    return len(used)


def test_greedy_matching_against_a_loop(spark):
    rng = random.Random(9)
    words = ["a", "ab", " AB ", "b", "", "abc", "c", "  "]
    cases = [([rng.choice(words) for _ in range(rng.randrange(6))], [rng.choice(words) for _ in range(rng.randrange(6))]) for _ in range(300)]
    df = spark.createDataFrame([(i, g, p) for i, (g, p) in enumerate(cases)], "i int, g array<string>, p array<string>")
    got = results(df.select("i", scoring.greedy_matches(F.col("g"), F.col("p")).alias("n")), "n")
    assert got == [greedy(g, p) for g, p in cases]


def record(id, *spans):
    found = [{"start": 0, "end": len(t), "label": label, "text": t, "tier": 1} for label, t in spans]
    return {"id": id, "source": "synthetic", "surface": "prose", "lang": "ko", "text": "x", "spans": found, "meta": None}


def test_scores(spark):
    gold = spark.createDataFrame([record("a", ("EMAIL", "A@b.co"), ("PERSON", "ab")), record("b", ("IP", "1.1.1.1")), record("c")], EVAL_SCHEMA)
    predicted = spark.createDataFrame([record("a", ("EMAIL", "a@b.co "), ("EMAIL", "z@z.z")), record("d", ("IP", "2.2.2.2"))], EVAL_SCHEMA)
    rows = {r.label: r for r in scoring.score(gold, predicted).collect()}
    assert set(rows) == {"EMAIL", "IP", None}
    assert [(rows[k].tp, rows[k].fp, rows[k].fn) for k in ("EMAIL", "IP", None)] == [(1, 1, 0), (0, 1, 1), (1, 2, 1)]
    assert rows["IP"].f1 == 0.0 and rows["EMAIL"].precision == 0.5 and rows["EMAIL"].recall == 1.0
    assert scoring.best_first(scoring.score(gold, predicted)).first().label == "EMAIL"
    tables = {r.label: r.row for r in scoring.markdown_rows(scoring.score(gold, predicted)).collect()}
    assert tables["IP"] == "| IP | 0.000 | 0.000 | 0.000 | 0 | 1 | 1 |"


def test_duplicate_ids_fail(spark):
    gold = spark.createDataFrame([record("a"), record("a")], EVAL_SCHEMA)
    with pytest.raises(Exception, match="duplicate gold id: a"):
        scoring.score(gold, gold.limit(1)).collect()
    assert [r.id for r in scoring.duplicate_ids(gold).collect()] == ["a"]


def test_label_tables(spark):
    labels, label_map = corpus.label_tables(spark, LABELS)
    assert labels.count() == 33
    phone = {(r.source, r.code) for r in label_map.where("key = 'PHONE'").collect()}
    assert phone == {("ko_pii", "PHONE"), ("presidio", "PHONE_NUMBER"), ("kdpii", "QT_PHONE"), ("kdpii", "QT_MOBILE")}
    one = {"X": {"tier": 1, "severity": "low", "method": "m", "default_action": "audit", "map": {"a": "c", "b": None, "d": ["e", "f"]}}}
    assert corpus.label_tables(spark, one)[1].count() == 3
    with pytest.raises(TypeError):
        corpus.label_tables(spark, {"X": {**one["X"], "map": {"a": [1]}}})


def test_corpus_normalization(spark, tmp_path):
    (tmp_path / "c.json").write_text(
        '[{"sent_idx": "7", "sentence": "call 010-1234-5678 now", "PII_set": [{"form": "x", "label": "QT_MOBILE", "begin": 5, "end": 18}, {"form": "now", "label": "??", "begin": 19, "end": 22}]},'
        ' {"sent_idx": "8", "sentence": "clean"}]'
    )
    raw = read_kdpii(spark, str(tmp_path / "c.json"))
    labels, label_map = corpus.label_tables(spark, LABELS)
    rows = corpus.normalize_kdpii(raw, labels, label_map, "valid").orderBy("id").collect()
    assert rows[0].id == "kdpii-valid-00007" and rows[0].meta.split == "dev" and rows[0].dropped == 1
    assert [(s.start, s.end, s.label, s.text, s.tier) for s in rows[0].spans] == [(5, 18, "PHONE", "010-1234-5678", 1)]
    assert rows[1].spans == []
    with pytest.raises(ValueError):
        corpus.normalize_kdpii(raw, labels, label_map, "train")
    assert "begin" in KDPII_SCHEMA


def test_records_round_trip(spark, tmp_path, positives):
    path = str(tmp_path / "records")
    write_records(positives.limit(20), path)
    back = read_records(spark, path)
    assert back.count() == 20 and back.exceptAll(positives).count() == 0


def test_slices_are_utf16(spark):
    df = texts(spark, ["a😀한b"] * 4).withColumn("s", F.col("i").cast("bigint"))
    same = corpus.slice_equals(F.col("t"), F.col("s"), F.col("s") + 2, F.lit("😀"))
    assert results(df.select("i", same.alias("x")), "x") == [False, True, False, False]


def test_record_numbers_are_never_cut(spark):
    df = spark.range(1).select(*[corpus.record_number(F.lit(n)).alias(f"n{n}") for n in (7, 99999, 1234567)])
    assert tuple(df.first()) == ("00007", "99999", "1234567")
