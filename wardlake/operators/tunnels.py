"""Which inner requests belong to an authorized tunnel (an as-of join)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.operators.timeline import last_value


def authorize_inner(traffic: DataFrame, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Add `tunnel_host` and `authorized` to inner requests.

    `traffic` holds CONNECT and inner rows of all clients: `client`, `host`,
    `is_connect`, `allowed`. An inner request is authorized when the client's latest
    allowed CONNECT went to the same host.
    """
    opened = F.when(F.col("is_connect") & F.col("allowed"), F.col("host"))
    return (
        last_value(traffic, ["client"], ts, tie, opened, "tunnel_host")
        .where(~F.col("is_connect"))
        .withColumn("authorized", F.coalesce(F.col("tunnel_host") == F.col("host"), F.lit(False)))
    )
