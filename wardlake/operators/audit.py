"""Queries over an audit log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.constants import (
    DECISIONS,
    DEFAULT_AUDIT_LIMIT,
)
from wardlake.operators.sizing import top_per_group
from wardlake.operators.timeline import row_numbers


def filter_audit(
    events: DataFrame,
    decision: str | None = None,
    since: str | None = None,
    domain: str | None = None,
) -> DataFrame:
    """Keep events by decision, start time and domain substring.

    Unknown decisions, empty values and a start time that does not parse are ignored.
    """
    if decision in DECISIONS:
        events = events.where(F.col("decision") == decision)
    if since:
        bound = F.try_to_timestamp(F.lit(since))
        # Folds to a plain, pushed-down comparison, or to nothing.
        events = events.where(bound.isNull() | (F.col("timestamp") >= bound))
    if domain:
        events = events.where(F.lower("facts.domain").contains(domain.lower()))
    return events


def newest_first(events: DataFrame, limit: int | None = DEFAULT_AUDIT_LIMIT) -> DataFrame:
    """Events, newest first: all for None, a page of default size for a limit of 0 or less."""
    ordered = events.orderBy(F.col("timestamp").desc_nulls_last(), F.col("id").desc())
    return ordered if limit is None else ordered.limit(limit if limit > 0 else DEFAULT_AUDIT_LIMIT)


def query_audit(
    events: DataFrame,
    limit: int | None = DEFAULT_AUDIT_LIMIT,
    decision: str | None = None,
    since: str | None = None,
    domain: str | None = None,
) -> DataFrame:
    """Filter, then newest first."""
    return newest_first(filter_audit(events, decision, since, domain), limit)


def query_from_params(params: Mapping[str, str]) -> dict:
    """`query_audit` arguments from text parameters; bad ones are dropped."""
    query: dict = {}
    limit = params.get("limit")
    if limit:
        try:
            wanted = int(float(limit))
        except (ValueError, OverflowError):
            wanted = 0
        query["limit"] = wanted
    if params.get("decision") in DECISIONS:
        query["decision"] = params["decision"]
    for name in ("since", "domain"):
        if params.get(name):
            query[name] = params[name]
    return query


def live_recent(events: DataFrame, limit: int = DEFAULT_AUDIT_LIMIT) -> DataFrame:
    """Newest events of one log by id, as many as asked for."""
    return events.orderBy(F.col("id").desc()).limit(max(0, limit))


def decision_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d,) for d in DECISIONS], "decision string")


def audit_stats(events: DataFrame) -> DataFrame:
    """Events per decision, with a row for each of the five decisions."""
    counts = events.groupBy("decision").agg(F.count("*").alias("n"))
    # Both sides have at most one row per decision value, whatever the log's size.
    return decision_dimension(events.sparkSession).join(counts, "decision", "left").select(
        "decision", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def overview(events: DataFrame, pending: DataFrame) -> DataFrame:
    """Dashboard numbers: pending holds, allowed, denied, events."""
    decision = F.col("decision")
    totals = events.agg(
        F.count_if(decision.isin("allowed", "approved")).alias("allowed"),
        F.count_if(decision.isin("denied", "rejected")).alias("denied"),
        F.count("*").alias("events"),
    )
    held = pending.agg(F.count("*"))
    return totals.select(held.scalar().alias("pending"), "allowed", "denied", "events")


def number_events(
    events: DataFrame, log: Sequence[str], ts: str = "timestamp", tie: str = "event_id"
) -> DataFrame:
    """Give each log's events ids 1, 2, 3, … in time order."""
    return row_numbers(events, log, ts, tie, "id")


def ring(events: DataFrame, capacity: int, log: Sequence[str] = ()) -> DataFrame:
    """The newest `capacity` events of each log.

    A log is cut down in hashed parts before its final ranking, so a very large log
    does not pass through one task.
    """
    if not log:
        return events.orderBy(F.col("id").desc()).limit(capacity)
    return top_per_group(events, log, [F.col("id").desc()], capacity, ["id"], "_rank").drop("_rank")


def events_held(events: DataFrame) -> DataFrame:
    """How many events a log (or ring) holds."""
    return events.agg(F.count("*").alias("events"))
