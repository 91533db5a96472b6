"""Exact running values along time that survive hot keys.

A plain window over one key sorts all of its rows in one task. Here rows are cut
by key *and* time bucket. A small summary per key and bucket is carried forward
(one row per bucket, however many events it holds), and each row only looks at its
own bucket. A key with a third of all events is spread over its buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET_SECONDS = 60
_BUCKET, _CARRY = "_bucket", "_carry"


def time_bucket(df: DataFrame, ts: str, seconds: int = BUCKET_SECONDS) -> Column:
    """Bucket number of a timestamp; grows with time in every session time zone."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        day = F.datediff(F.col(ts).cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
        moment = day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    else:
        moment = F.unix_seconds(F.col(ts).cast("timestamp"))
    return F.floor(moment / seconds).cast("bigint")


def _with_carry(bucketed: DataFrame, keys: Sequence[str], summary: Column, carry: Column) -> DataFrame:
    buckets = (
        bucketed.groupBy(*keys, _BUCKET).agg(summary.alias("_summary")).withColumn(_CARRY, carry)
        .select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(_BUCKET).alias("_k_bucket"), _CARRY)
    )
    same = F.col(_BUCKET) == F.col("_k_bucket")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return bucketed.join(buckets, same, "left").drop("_k_bucket", *[f"_k_{k}" for k in keys])


def _latest(
    df: DataFrame, keys: Sequence[str], ts: str, tie: str, value: Column, output: str,
    seconds: int, forward: bool,
) -> DataFrame:
    def directed(name: str) -> Column:
        return F.col(name).desc() if forward else F.col(name).asc()

    bucketed = df.withColumns({_BUCKET: time_bucket(df, ts, seconds), "_value": value})
    moment = F.when(F.col("_value").isNotNull(), F.struct(ts, tie))
    summary = (F.min_by if forward else F.max_by)("_value", moment)
    earlier = Window.partitionBy(*keys).orderBy(directed(_BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    carried = _with_carry(bucketed, keys, summary, F.last("_summary", ignorenulls=True).over(earlier))
    within = (
        Window.partitionBy(*keys, _BUCKET).orderBy(directed(ts), directed(tie))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    nearest = F.coalesce(F.last("_value", ignorenulls=True).over(within), F.col(_CARRY))
    return carried.withColumn(output, nearest).drop(_BUCKET, _CARRY, "_value")


def last_value(
    df: DataFrame, keys: Sequence[str], ts: str, tie: str, value: Column, output: str,
    seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Latest non-NULL `value` at or before each row, in `(ts, tie)` order per key."""
    return _latest(df, keys, ts, tie, value, output, seconds, forward=False)


def next_value(
    df: DataFrame, keys: Sequence[str], ts: str, tie: str, value: Column, output: str,
    seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """First non-NULL `value` at or after each row, in `(ts, tie)` order per key."""
    return _latest(df, keys, ts, tie, value, output, seconds, forward=True)


def running_sum(
    df: DataFrame, keys: Sequence[str], ts: str, tie: str, amount: Column, output: str,
    seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Sum of `amount` over all rows up to each row, in `(ts, tie)` order per key."""
    bucketed = df.withColumns({_BUCKET: time_bucket(df, ts, seconds), "_value": amount.cast("bigint")})
    earlier = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = _with_carry(bucketed, keys, F.sum("_value"), F.sum("_summary").over(earlier))
    within = (
        Window.partitionBy(*keys, _BUCKET).orderBy(ts, tie)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    total = F.coalesce(F.col(_CARRY), F.lit(0)) + F.sum("_value").over(within)
    return carried.withColumn(output, total).drop(_BUCKET, _CARRY, "_value")


def row_numbers(
    df: DataFrame, keys: Sequence[str], ts: str, tie: str, output: str, seconds: int = BUCKET_SECONDS
) -> DataFrame:
    """1-based position of each row in `(ts, tie)` order per key."""
    return running_sum(df, keys, ts, tie, F.lit(1), output, seconds)
