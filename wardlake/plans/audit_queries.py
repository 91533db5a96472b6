"""Queries over the audit log, holds and approvals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.constants import AUDIT_RING_CAPACITY
from wardlake.operators.approvals import concurrency, find_pending, holds_pending, lifecycle, oldest_first, pending
from wardlake.operators.audit import (
    audit_stats,
    events_held,
    filter_audit,
    live_recent,
    newest_first,
    number_events,
    overview,
    query_audit,
    query_from_params,
    ring,
)
from wardlake.plans.registry import query
from wardlake.plans.tables import AUDIT_SQL, audit_events
from wardlake.runtime import shared_dir
from wardlake.sources.audit_log import append_audit_log, read_audit_log

_SHOWN = ["id", "timestamp", "decision", "domain"]


def _shown(events: DataFrame) -> DataFrame:
    return events.select("id", "timestamp", "decision", F.col("facts.domain").alias("domain"))


@query(
    f"""SELECT d.decision, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (VALUES ('allowed'), ('denied'), ('paused'), ('approved'), ('rejected')) d(decision)
LEFT JOIN (SELECT decision, count(*) AS n FROM ({AUDIT_SQL}) GROUP BY 1) USING (decision)"""
)
def audit_decision_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per decision, zeros included."""
    return audit_stats(audit_events(spark, sf_dir))


@query(f"SELECT id, timestamp, decision, domain FROM ({AUDIT_SQL}) ORDER BY timestamp DESC NULLS LAST, id DESC LIMIT 200")
def audit_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest events; a page of default size, as the limit is unusable."""
    return _shown(query_audit(audit_events(spark, sf_dir), **query_from_params({"limit": "-1"})))


@query(
    f"""SELECT id, timestamp, decision, domain FROM ({AUDIT_SQL})
WHERE decision = 'denied' AND timestamp >= TIMESTAMP '2024-01-10 12:00:00' AND contains(lower(domain), 'internal')"""
)
def audit_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Denied events on internal hosts since a moment."""
    return _shown(filter_audit(audit_events(spark, sf_dir), "denied", "2024-01-10 12:00:00", "INTERNAL"))


@query(
    f"""SELECT id, timestamp, decision, domain FROM ({AUDIT_SQL}) WHERE contains(lower(domain), 'host3')
ORDER BY timestamp DESC NULLS LAST, id DESC LIMIT 50"""
)
def audit_by_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search from text parameters; the unusable ones are ignored."""
    params = {"limit": "50", "decision": "unknown", "since": "not a time", "domain": "host3"}
    return _shown(query_audit(audit_events(spark, sf_dir), **query_from_params(params)))


@query(
    f"""WITH a AS ({AUDIT_SQL}) SELECT CAST(count(*) FILTER (decision = 'paused' AND approval_id NOT IN (SELECT approval_id FROM a WHERE decision IN ('approved', 'rejected'))) AS BIGINT) AS pending,
  count(*) FILTER (decision IN ('allowed', 'approved')) AS allowed, count(*) FILTER (decision IN ('denied', 'rejected')) AS denied, count(*) AS events
FROM a"""
)
def audit_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dashboard numbers."""
    events = audit_events(spark, sf_dir)
    return overview(events, pending(events))


@query(f"SELECT id, timestamp, decision, domain FROM ({AUDIT_SQL}) ORDER BY id DESC LIMIT 5000")
def audit_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 5,000 events by id."""
    return _shown(live_recent(audit_events(spark, sf_dir), limit=5000))


@query(f"SELECT id, timestamp, decision, domain FROM ({AUDIT_SQL}) ORDER BY timestamp DESC NULLS LAST, id DESC LIMIT 8")
def audit_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest eight decisions."""
    return _shown(newest_first(audit_events(spark, sf_dir), 8))


@query(f"SELECT log_id, id AS event_id, row_number() OVER (PARTITION BY log_id ORDER BY timestamp, id) AS id FROM ({AUDIT_SQL})")
def audit_event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids per log in time order."""
    events = audit_events(spark, sf_dir).withColumnRenamed("id", "event_id")
    return number_events(events, ["log_id"]).select("log_id", "event_id", "id")


@query(
    f"""SELECT log_id, id FROM (SELECT log_id, id, row_number() OVER (PARTITION BY log_id ORDER BY id DESC) AS r FROM ({AUDIT_SQL})) WHERE r <= 64"""
)
def audit_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 64 events of each log."""
    return ring(audit_events(spark, sf_dir), 64, ["log_id"]).select("log_id", "id")


@query(f"SELECT least(count(*), 1024) AS events FROM ({AUDIT_SQL})")
def audit_ring_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events a full ring holds."""
    return events_held(ring(audit_events(spark, sf_dir), AUDIT_RING_CAPACITY))


@query(f"SELECT id, timestamp, decision, verdict, rule, domain, approval_id FROM ({AUDIT_SQL})")
def audit_log_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written as JSON lines and read back."""
    path = shared_dir(spark, "audit-log")
    kind = audit_events(spark, sf_dir)
    append_audit_log(kind.withColumn("timestamp", F.col("timestamp").cast("timestamp")), path)
    return read_audit_log(spark, path).select(
        "id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "decision", "verdict", "rule",
        F.col("facts.domain").alias("domain"), "approval_id",
    )


_NEXT = f"""SELECT *, first_value(CASE WHEN decision <> 'paused' THEN decision END IGNORE NULLS) OVER w AS next_decision,
  first_value(CASE WHEN decision <> 'paused' THEN timestamp END IGNORE NULLS) OVER w AS next_at
FROM ({AUDIT_SQL}) WHERE approval_id IS NOT NULL
WINDOW w AS (PARTITION BY approval_id ORDER BY timestamp, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""
_LIFECYCLE = f"""SELECT id, timestamp, approval_id, log_id, CASE WHEN next_at <= timestamp + INTERVAL 300 SECOND THEN next_decision END AS resolution,
  CASE WHEN next_at <= timestamp + INTERVAL 300 SECOND THEN next_at END AS resolved_at FROM ({_NEXT}) WHERE decision = 'paused'"""


@query(f"SELECT id, approval_id, timestamp AS paused_at, resolution, resolved_at FROM ({_LIFECYCLE})")
def approval_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holds with their resolution within five minutes."""
    return lifecycle(audit_events(spark, sf_dir)).select(
        "id", "approval_id", F.col("timestamp").alias("paused_at"), "resolution", "resolved_at"
    )


_PENDING = f"""WITH a AS ({AUDIT_SQL}) SELECT id, approval_id, timestamp, domain FROM a WHERE decision = 'paused'
AND approval_id NOT IN (SELECT approval_id FROM a WHERE decision IN ('approved', 'rejected'))"""


@query(_PENDING)
def approval_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holds that nobody resolved, oldest first."""
    return oldest_first(pending(audit_events(spark, sf_dir))).select(
        "id", "approval_id", "timestamp", F.col("facts.domain").alias("domain")
    )


@query(f"SELECT id, approval_id FROM ({_PENDING}) WHERE approval_id = 96")
def approval_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pending hold by id."""
    return find_pending(audit_events(spark, sf_dir), 96).select("id", "approval_id")


@query(f"SELECT count(*) AS pending FROM ({_PENDING})")
def approval_pending_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many holds are pending."""
    return holds_pending(audit_events(spark, sf_dir))


@query(
    f"""SELECT log_id, "at", hold, change, CAST(sum(change) OVER (PARTITION BY log_id ORDER BY "at", change, hold ROWS UNBOUNDED PRECEDING) AS BIGINT) AS open FROM (
SELECT log_id, timestamp AS "at", id AS hold, 1 AS change FROM ({_LIFECYCLE})
UNION ALL SELECT log_id, coalesce(resolved_at, timestamp + INTERVAL 300 SECOND), id, -1 FROM ({_LIFECYCLE}))"""
)
def hold_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open holds of each gateway over time."""
    holds = lifecycle(audit_events(spark, sf_dir))
    return concurrency(holds, ["log_id"]).select("log_id", "at", "hold", "change", "open")
