"""Ranks that survive a hot group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Parts a group is split into before its final ranking.
RANK_PARTS = 64


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, spread_by: Sequence[str], rank: str
) -> DataFrame:
    """The first `n` rows of each group in `order`, with their `rank`.

    A group is first cut down in hashed parts, so that even one that holds most of the
    table sends at most `n` rows per part to the task that ranks it.
    """
    part = F.pmod(F.hash(*spread_by), F.lit(RANK_PARTS))
    in_part = Window.partitionBy(*group, "_part").orderBy(*order)
    candidates = (
        df.withColumn("_part", part).withColumn(rank, F.row_number().over(in_part)).where(F.col(rank) <= n).drop("_part")
    )
    return candidates.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(
        F.col(rank) <= n
    )
