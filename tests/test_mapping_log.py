"""The appended store against the one that is rewritten."""

from __future__ import annotations

import random

import pytest

from wardlake.schemas import MAPPING_SCHEMA
from wardlake.streaming import mapping_log, mapping_store


@pytest.mark.parametrize("caps", [{"max_entries": 6, "max_bytes": 60}, {"max_bytes": 25}, {}])
def test_same_as_rewritten(spark, tmp_path, caps):
    rng = random.Random(len(caps))
    at = 0
    for version in range(9):
        rows = []
        for _ in range(rng.choice([0, 1, 3, 12])):
            at += 1
            name = f"p{rng.randrange(20)}"
            rows.append((rng.choice("st"), name, name * rng.randrange(1, 5) if name != "p7" else "x" * 90, at))
        batch = spark.createDataFrame(rows, MAPPING_SCHEMA)
        mapping_store.record_batch(batch, version, f"{tmp_path}/a", **caps)
        for _ in range(1 + (version == 4)):  # a retried batch changes nothing
            mapping_log.record_batch(batch, version, f"{tmp_path}/b", compact_every=3, part_sequences=4, **caps)
        want = sorted(map(tuple, mapping_store.read_store(spark, f"{tmp_path}/a", version).collect()))
        assert sorted(map(tuple, mapping_log.read_store(spark, f"{tmp_path}/b", version, 3).collect())) == want
        state = {r.salt_id: (r.entries, r.bytes) for r in mapping_log.read_state(spark, f"{tmp_path}/b", version).collect()}
        for salt in "st":
            mine = [r for r in want if r[0] == salt]
            assert state.get(salt, (0, 0)) == (len(mine), sum(len(r[2]) for r in mine))
    assert sorted(map(tuple, mapping_log.latest_store(spark, f"{tmp_path}/b", 3).collect())) == want


def test_a_batch_writes_its_own_rows(spark, tmp_path):
    for version in range(4):
        rows = [("s", f"p{version}-{i}", "secret", 1_000 * version + i) for i in range(200 if version == 0 else 3)]
        mapping_log.record_batch(spark.createDataFrame(rows, MAPPING_SCHEMA), version, str(tmp_path), max_entries=100)
    history = {r.version: (r.written, r.entries, r.evicted) for r in mapping_log.read_history(spark, str(tmp_path)).collect()}
    assert history == {0: (200, 100, 100), 1: (3, 100, 3), 2: (3, 100, 3), 3: (3, 100, 3)}
