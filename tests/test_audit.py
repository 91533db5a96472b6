"""Audit queries, holds, running values, and the log's source and sink."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardlake.operators import approvals, audit, timeline
from wardlake.operators.tunnels import authorize_inner
from wardlake.schemas import AUDIT_SCHEMA
from wardlake.sources.audit_log import append_audit_log, read_audit_log, read_rejected_lines

BASE = datetime(2026, 1, 1)


def event(id, decision, minutes=0, domain=None, approval=None, seconds=0):
    return {
        "id": id, "timestamp": BASE + timedelta(minutes=minutes, seconds=seconds), "decision": decision, "verdict": "allow", "rule": None,
        "facts": {"domain": domain}, "approval_id": approval,
    }


@pytest.fixture(scope="module")
def log(spark):
    rows = [event(1, "allowed", 0, "github.com"), event(2, "denied", 10, "evil.com"), event(3, "allowed", 20, "api.Internal.corp")]
    return spark.createDataFrame(rows, AUDIT_SCHEMA)


def ids(df):
    return [r.id for r in df.collect()]


def test_queries(log):
    assert ids(audit.query_audit(log)) == [3, 2, 1]
    assert ids(audit.query_audit(log, decision="denied")) == [2]
    assert ids(audit.query_audit(log, domain="INTERNAL")) == [3]
    assert ids(audit.query_audit(log, since="2026-01-01T00:10:00Z")) == [3, 2]
    assert ids(audit.query_audit(log, since="whenever", decision="odd")) == [3, 2, 1]
    assert ids(audit.query_audit(log, limit=1)) == [3]
    assert ids(audit.query_audit(log, limit=0)) == ids(audit.query_audit(log, limit=None)) == [3, 2, 1]
    assert ids(audit.live_recent(log, 2)) == [3, 2]


def test_equal_times_fall_back_to_ids(spark):
    rows = [event(1, "allowed"), event(2, "allowed"), {**event(3, "allowed"), "timestamp": None}]
    assert ids(audit.query_audit(spark.createDataFrame(rows, AUDIT_SCHEMA))) == [2, 1, 3]


def test_params():
    assert audit.query_from_params({"limit": "5", "decision": "denied", "since": "", "domain": "x"}) == {"limit": 5, "decision": "denied", "domain": "x"}
    assert audit.query_from_params({"limit": "many", "decision": "odd"}) == {"limit": 0}


def test_stats_and_overview(log):
    stats = {r.decision: r.n for r in audit.audit_stats(log).collect()}
    assert stats == {"allowed": 2, "denied": 1, "paused": 0, "approved": 0, "rejected": 0}
    assert tuple(audit.overview(log, approvals.pending(log)).first()) == (0, 2, 1, 3)


def test_ring(spark):
    df = spark.createDataFrame([event(i, "allowed") for i in range(1, 11)], AUDIT_SCHEMA)
    assert ids(audit.ring(df, capacity=3)) == [10, 9, 8]
    logs = df.withColumn("log", F.col("id") % 2)
    assert sorted(ids(audit.ring(logs, 2, ["log"]))) == [7, 8, 9, 10]


def test_log_files(spark, tmp_path, log):
    path = str(tmp_path / "log")
    append_audit_log(log, path)
    append_audit_log(log.where("id = 1"), path)
    assert sorted(ids(read_audit_log(spark, path))) == [1, 1, 2, 3]
    assert read_audit_log(spark, path).where("id = 3").first() == log.where("id = 3").first()
    lines = [r.value for r in spark.read.text(path).collect()]
    assert all("approval_id" not in x and "null" not in x for x in lines)
    (tmp_path / "mixed.jsonl").write_text(lines[0] + "\n\n  \n{\"id\": 9, \"timest\n" + lines[1] + "\n")
    mixed = str(tmp_path / "mixed.jsonl")
    assert read_audit_log(spark, mixed).count() == 2
    assert [r.line for r in read_rejected_lines(spark, mixed).collect()] == ['{"id": 9, "timest']
    assert read_audit_log(spark, str(tmp_path / "absent")).count() == 0


def test_lifecycle_and_pending(spark):
    rows = [
        event(1, "paused", 0, approval=1), event(2, "approved", 1, approval=1), event(3, "paused", 0, approval=2), event(4, "rejected", 5, approval=2, seconds=1),
        event(5, "paused", 9, "d", approval=3), event(6, "rejected", 3), event(7, "paused", 8, approval=4), event(8, "rejected", 13, approval=4),
    ]
    df = spark.createDataFrame(rows, AUDIT_SCHEMA)
    got = {r.approval_id: (r.resolution, r.resolved_at) for r in approvals.lifecycle(df).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "approved", 2: None, 3: None, 4: "rejected"}
    assert [r.approval_id for r in approvals.oldest_first(approvals.pending(df)).collect()] == [3]
    assert approvals.find_pending(df, 3).count() == 1 and approvals.find_pending(df, 1).count() == 0
    assert approvals.holds_pending(df).first().pending == 1
    steps = approvals.concurrency(approvals.lifecycle(df).withColumn("gw", F.lit("g")), ["gw"]).orderBy("at", "change", "hold").collect()
    assert [s.open for s in steps] == [1, 2, 1, 0, 1, 2, 1, 0]


@pytest.mark.parametrize("seconds", [1, 60, 10**9])
def test_running_values_against_loops(spark, seconds):
    rng = random.Random(seconds)
    rows = [(k, BASE + timedelta(seconds=rng.randrange(600)), i, rng.choice([None, None, f"v{i}"])) for i in range(400) for k in [rng.choice([1, 1, 1, 2, None])]]
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz, id bigint, v string")
    last = {r.id: r.out for r in timeline.last_value(df, ["k"], "ts", "id", F.col("v"), "out", seconds).collect()}
    following = {r.id: r.out for r in timeline.next_value(df, ["k"], "ts", "id", F.col("v"), "out", seconds).collect()}
    number = {r.id: r.out for r in timeline.row_numbers(df, ["k"], "ts", "id", "out", seconds).collect()}
    for key in (1, 2, None):
        ordered = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        seen = None
        for position, (_, _, id, v) in enumerate(ordered, start=1):
            seen = v if v is not None else seen
            assert last[id] == seen and number[id] == position
        seen = None
        for _, _, id, v in reversed(ordered):
            seen = v if v is not None else seen
            assert following[id] == seen


def test_time_bucket_with_zone(spark):
    df = spark.sql("SELECT timestamp'1969-12-31 23:59:59.5Z' AS a, timestamp_ntz'1969-12-31 23:59:59.5' AS b")
    assert tuple(df.select(timeline.time_bucket(df, "a", 60), timeline.time_bucket(df, "b", 60)).first()) == (-1, -1)


def test_tunnels(spark):
    rows = [
        (1, "c", "a", True, True), (2, "c", "a", False, True), (3, "c", "b", False, True), (4, "c", "b", True, False), (5, "c", "b", False, True),
        (6, "c", "b", True, True), (7, "c", "a", False, True), (8, "d", "a", False, True),
    ]
    df = spark.createDataFrame([(i, BASE + timedelta(minutes=i), *r) for i, *r in rows], "event_id bigint, ts timestamp, client string, host string, is_connect boolean, allowed boolean")
    assert {r.event_id: r.authorized for r in authorize_inner(df).collect()} == {2: True, 3: False, 5: False, 7: False, 8: False}
