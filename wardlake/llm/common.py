"""Helpers that several training-data operators share.

Words are maximal runs of characters other than the six ASCII white-space characters.
Everything here is a built-in expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The six ASCII white-space characters, as a regex class body.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share.

    Only a single-machine session without one (tests) gets a temporary folder; a cluster
    without one is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        base = context.getConf().get("spark.checkpoint.dir")
        if not base:
            if not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            base = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(base)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Write a frame to the shared checkpoint folder and cut its lineage there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def is_small(df: DataFrame, most_rows: int = 100_000) -> bool:
    """Whether a written frame of narrow rows may be broadcast."""
    return df.count() <= most_rows


def joinable(df: DataFrame) -> DataFrame:
    """A written frame of one narrow row per group: broadcast if small, else joined by shuffle."""
    return F.broadcast(df) if is_small(df) else df


def words(text: Column) -> Column:
    """The words of a text, in order; none for a null, empty or blank text."""
    inner = F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")
    return F.when(
        F.length(F.coalesce(inner, F.lit(""))) > 0, F.split(inner, f"[{SPACE}]+", -1)
    ).otherwise(F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    """Number of words (bigint); 0 for a null text."""
    return F.size(words(text)).cast("bigint")


def unit_random(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone, so that reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


def rows(part: float, size: int) -> int:
    """How many parts of a given size hold so many rows; at least one."""
    return max(1, -(-int(part) // size))
