"""Latency of runs over a table of measurements, with sketches that merge.

Measurements are rows of (run, day, latency). Each day is sketched once; sketches are rows
that can be kept and merged into any longer span, so a new day costs one day's scan. A
quantile's rank is off by about 1.7 / k of all rows at most (99 times of 100); up to k rows
it is exact. `exact_quantiles` reads the measurements again and has no error: sketches only
say where to look.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SKETCH_SIZE = 8_192
# Values are sorted between the sketch's quantiles this far to either side, in errors of a sketch.
_MARGIN = 3 * 1.7


def daily_sketches(measured: DataFrame, latency: str, by: list[str], k: int = SKETCH_SIZE) -> DataFrame:
    """(by..., documents, total, sketch): one row per group, null measurements left out."""
    value = F.col(latency).cast("double")
    return measured.where(value.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("documents"), F.sum(value).alias("total"), F.kll_sketch_agg_double(value, k).alias("sketch")
    )


def merged(sketches: DataFrame, by: list[str], k: int = SKETCH_SIZE) -> DataFrame:
    """The same rows for longer spans."""
    return sketches.groupBy(*by).agg(
        F.sum("documents").alias("documents"), F.sum("total").alias("total"), F.kll_merge_agg_double("sketch", k).alias("sketch")
    )


def latency_report(sketches: DataFrame, by: list[str], quantiles: dict[str, float]) -> DataFrame:
    """(by..., documents, mean, quantiles..., documents_per_second) of sketches of milliseconds.

    Documents per second is what one worker that does nothing else gets through.
    """
    picked = [F.kll_sketch_get_quantile_double("sketch", F.lit(q).cast("double")).alias(name) for name, q in quantiles.items()]
    rate = F.when(F.col("total") > 0, 1000 * F.col("documents") / F.col("total")).alias("documents_per_second")
    return sketches.select(*by, "documents", (F.col("total") / F.col("documents")).alias("mean"), *picked, rate)


def exact_quantiles(measured: DataFrame, latency: str, sketches: DataFrame, by: list[str], quantiles: dict[str, float], k: int = SKETCH_SIZE) -> DataFrame:
    """(by..., quantiles...) by rank: the smallest value that a share of at least q of the rows does not exceed.

    `sketches` are those of all of `measured`, one row per group. Their quantiles on both sides
    cut the values into three zones, which are counted; the rank lies in one of them, most likely
    the narrow one between, and only its values are counted and sorted. A sketch that is wrong
    makes that zone longer and changes no result.
    """
    value = F.col(latency).cast("double")

    def bound(q: float):
        return F.kll_sketch_get_quantile_double("sketch", F.lit(min(max(q, 0.0), 1.0)).cast("double"))

    def rank(q: float):
        above = F.floor(F.col("documents").cast("decimal(19,0)") * F.lit(1 - Decimal(str(q)))).cast("bigint")
        return F.greatest(F.col("documents") - above, F.lit(1))

    asked = F.array(
        *(F.struct(F.lit(name).alias("name"), rank(q).alias("rank"), bound(q - _MARGIN / k).alias("low"), bound(q + _MARGIN / k).alias("high")) for name, q in quantiles.items())
    )
    bounds = sketches.select(*by, F.explode(asked).alias("a")).select(*by, "a.*")

    def zoned(bounds: DataFrame) -> DataFrame:
        renamed = bounds.withColumnsRenamed({c: f"_{c}" for c in by})
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
        rows = measured.where(value.isNotNull()).select(*by, value.alias("value")).join(renamed, same)
        return rows.withColumn("zone", F.when(F.col("value") < F.col("low"), 0).when(F.col("value") <= F.col("high"), 1).otherwise(2))

    below, up_to = F.col("below"), F.col("below") + F.col("between")
    counted = zoned(bounds).groupBy(*by, "name", "rank", "low", "high").agg(
        F.count_if(F.col("zone") == 0).alias("below"), F.count_if(F.col("zone") == 1).alias("between")
    )
    chosen = counted.select(
        *by, "name", "low", "high",
        F.when(F.col("rank") <= below, 0).when(F.col("rank") <= up_to, 1).otherwise(2).alias("chosen"),
        F.when(F.col("rank") <= below, F.col("rank")).when(F.col("rank") <= up_to, F.col("rank") - below).otherwise(F.col("rank") - up_to).alias("rank"),
    )
    within = zoned(chosen).where(F.col("zone") == F.col("chosen")).groupBy(*by, "name", "rank", "value").agg(F.count("*").alias("n"))
    reached = F.sum("n").over(Window.partitionBy(*by, "name").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    found = within.withColumn("reached", reached).where(F.col("reached") >= F.col("rank")).groupBy(*by, "name").agg(F.min("value").alias("value"))
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in quantiles))
