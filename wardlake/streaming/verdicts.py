"""Stateless verdicts over a request stream, rolling counts, and de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.operators.enforcement import audit_drafts, enforce, inspected
from wardlake.operators.policy import Policy


def stream_verdicts(requests: DataFrame, policy: Policy, mode: str = "block") -> DataFrame:
    """Audit drafts of a request stream: facts, findings, verdict, decision.

    A projection and a filter, with no state; the same plan serves a batch.
    """
    return audit_drafts(enforce(inspected(requests), policy, mode))


def rolling_counts(
    events: DataFrame, width: str = "1 minute", lateness: str = "10 minutes", ts: str = "timestamp"
) -> DataFrame:
    """Events per decision and time window, for `update` mode."""
    return (
        events.withWatermark(ts, lateness)
        .groupBy(F.window(ts, width).alias("window"), "decision")
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), "decision", "n")
    )


def deduplicated(events: DataFrame, lateness: str = "10 minutes", log: str = "log_id") -> DataFrame:
    """Drop repeated lines of a log. Ids restart, so the time is part of the identity."""
    return events.withWatermark("timestamp", lateness).dropDuplicatesWithinWatermark([log, "id", "timestamp"])
