"""Holds and their resolution, from the audit log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.constants import HOLD_TIMEOUT_SECONDS
from wardlake.operators.timeline import next_value, running_sum

RESOLUTIONS = ["approved", "rejected"]


def lifecycle(
    events: DataFrame,
    timeout_seconds: int = HOLD_TIMEOUT_SECONDS,
    ts: str = "timestamp",
    tie: str = "id",
) -> DataFrame:
    """Each hold with its first resolution within the timeout.

    Adds `resolution` (approved or rejected, NULL when it timed out) and
    `resolved_at`. A hold finds its resolution by looking forward along its approval
    id, so no pairs of holds and resolutions are formed.
    """
    linked = events.where(F.col("approval_id").isNotNull() & F.col("decision").isin("paused", *RESOLUTIONS))
    resolution = F.when(
        F.col("decision").isin(RESOLUTIONS),
        F.struct(F.col("decision").alias("decision"), F.col(ts).alias("at")),
    )
    paired = next_value(linked, ["approval_id"], ts, tie, resolution, "_next")
    in_time = F.col("_next.at") <= F.col(ts) + F.expr(f"INTERVAL '{timeout_seconds}' SECOND")
    return (
        paired.where(F.col("decision") == "paused")
        .withColumns(
            {
                "resolution": F.when(in_time, F.col("_next.decision")),
                "resolved_at": F.when(in_time, F.col("_next.at")),
            }
        )
        .drop("_next")
    )


def pending(events: DataFrame) -> DataFrame:
    """Holds whose approval id was never resolved, oldest first by id."""
    resolved = events.where(F.col("decision").isin(RESOLUTIONS)).select("approval_id").distinct()
    held = events.where((F.col("decision") == "paused") & F.col("approval_id").isNotNull())
    return held.join(resolved, "approval_id", "left_anti")


def oldest_first(holds: DataFrame) -> DataFrame:
    return holds.orderBy("approval_id")


def find_pending(events: DataFrame, approval_id: int) -> DataFrame:
    """One pending hold by id; the id filter reaches both sides of the anti join."""
    return pending(events.where(F.col("approval_id") == approval_id))


def concurrency(
    holds: DataFrame,
    gateway: Sequence[str],
    timeout_seconds: int = HOLD_TIMEOUT_SECONDS,
    ts: str = "timestamp",
    tie: str = "id",
) -> DataFrame:
    """How many holds were open after each hold began or ended.

    `holds` is the output of `lifecycle`; an unresolved hold ends at its timeout.
    Returns gateway, `at`, `tie`, `change` (+1 or -1) and `open`. Ends sort before
    starts at the same moment.
    """
    end = F.coalesce(F.col("resolved_at"), F.col(ts) + F.expr(f"INTERVAL '{timeout_seconds}' SECOND"))
    steps = holds.select(
        *gateway,
        F.explode(
            F.array(
                F.struct(F.col(ts).alias("at"), F.lit(1).alias("change"), F.col(tie).alias("hold")),
                F.struct(end.alias("at"), F.lit(-1).alias("change"), F.col(tie).alias("hold")),
            )
        ).alias("step"),
    ).select(*gateway, "step.*").withColumn("tie", F.struct("change", "hold"))
    return running_sum(steps, gateway, "at", "tie", F.col("change"), "open").drop("tie")


def holds_pending(events: DataFrame) -> DataFrame:
    """How many holds are pending."""
    return pending(events).agg(F.count("*").alias("pending"))
