"""A live mapping store that is not rewritten: batches append, what is evicted lies behind a frontier.

A batch writes its own rows and one row of state per salt: how much is kept, and the newest
entry that was evicted. Entries only move to the newest end and only the oldest are evicted,
so everything at or behind that frontier is gone for good, and the store is the merge of what
was written, in front of it. Every `compact_every` batches the store is written anew, which
costs each batch that share of it, and the space of rows before is used again: a secret that
was evicted stays on disk for twice as many batches at most.

The caps are found from a histogram of the entries' places in time and, where it crosses
them, the rows of that one part; no task sorts a store.

A batch that is retried writes the same files again. Rows that come in older than what was
evicted before are evicted at once. Batches are numbered without gaps, as Spark does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardlake.operators.mappings import merge
from wardlake.schemas import MAPPING_COLUMNS, MAPPING_SCHEMA

COMPACT_EVERY = 16
# Sequence numbers that one part of the histogram spans.
PART_SEQUENCES = 100_000
STATE_SCHEMA = (
    "salt_id string, entries bigint, bytes bigint, evicted bigint, frontier_seq bigint, frontier_placeholder string, version bigint, written bigint"
)


def _delta(path: str, version: int, compact_every: int) -> str:
    return f"{path}/deltas/slot-{version % (2 * compact_every)}"


def _base(path: str, generation: int, compact_every: int) -> str:
    return f"{path}/base/slot-{generation // compact_every % 2}"


def _written(spark: SparkSession, path: str, version: int, compact_every: int) -> DataFrame:
    """The last compacted store and the batches since, merged."""
    generation = version // compact_every * compact_every - 1
    paths = [_delta(path, v, compact_every) for v in range(generation + 1, version + 1)]
    if generation >= 0:
        paths.append(_base(path, generation, compact_every))
    return merge(spark.read.schema(MAPPING_SCHEMA).parquet(*paths))


def read_state(spark: SparkSession, path: str, version: int) -> DataFrame:
    """State per salt after a batch; empty before the first one."""
    if version < 0:
        return spark.createDataFrame([], STATE_SCHEMA)
    return spark.read.schema(STATE_SCHEMA).parquet(f"{path}/state/batch-{version}")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """State per salt and batch, as metrics."""
    return spark.read.schema(STATE_SCHEMA).parquet(f"{path}/state/*")


def _in_front(rows: DataFrame, state: DataFrame) -> DataFrame:
    frontier = state.select(F.col("salt_id").alias("_salt"), "frontier_seq", "frontier_placeholder")
    joined = rows.join(frontier, rows.salt_id == frontier["_salt"], "left")
    newer = (F.col("last_seq") > F.col("frontier_seq")) | ((F.col("last_seq") == F.col("frontier_seq")) & (F.col("placeholder") < F.col("frontier_placeholder")))
    return joined.where(F.col("frontier_seq").isNull() | newer).select(*rows.columns)


def read_store(spark: SparkSession, path: str, version: int, compact_every: int = COMPACT_EVERY) -> DataFrame:
    """The store after a batch."""
    if version < 0:
        return spark.createDataFrame([], MAPPING_SCHEMA)
    return _in_front(_written(spark, path, version, compact_every), read_state(spark, path, version)).select(*MAPPING_COLUMNS)


def _first_evicted(rows: DataFrame, max_entries: int | None, max_bytes: int | None, part_sequences: int) -> DataFrame:
    """(salt_id, seq, placeholder) of the newest entry with which a cap is exceeded, per salt."""
    over = F.lit(False)
    if max_entries is not None:
        over = over | (F.col("n") > max_entries)
    if max_bytes is not None:
        over = over | (F.col("b") > max_bytes)
    sized = rows.select(
        "salt_id", "placeholder", "last_seq", F.octet_length("secret").cast("bigint").alias("size"), F.floor(F.col("last_seq") / part_sequences).alias("part")
    )
    newest = Window.partitionBy("salt_id").orderBy(F.desc("part"))
    running = newest.rowsBetween(Window.unboundedPreceding, 0)
    parts = sized.groupBy("salt_id", "part").agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"))
    summed = parts.withColumns({"n": F.sum("entries").over(running), "b": F.sum("bytes").over(running)})
    crossed = summed.where(over).groupBy("salt_id").agg(F.max_by(F.struct("part", "n", "b", "entries", "bytes"), "part").alias("c"))
    crossed = crossed.select(
        F.col("salt_id").alias("_salt"), F.col("c.part").alias("_part"), (F.col("c.n") - F.col("c.entries")).alias("n0"), (F.col("c.b") - F.col("c.bytes")).alias("b0")
    )
    inside = sized.join(crossed, (sized.salt_id == crossed["_salt"]) & (sized.part == crossed["_part"]))
    order = Window.partitionBy("salt_id").orderBy(F.desc("last_seq"), "placeholder")
    place = inside.withColumns(
        {"n": F.col("n0") + F.row_number().over(order), "b": F.col("b0") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))}
    )
    first = F.min_by(F.struct(F.col("last_seq").alias("seq"), "placeholder"), "n").alias("f")
    return place.where(over).groupBy("salt_id").agg(first).select("salt_id", "f.*")


def record_batch(
    batch: DataFrame,
    version: int,
    path: str,
    max_entries: int | None = None,
    max_bytes: int | None = None,
    compact_every: int = COMPACT_EVERY,
    part_sequences: int = PART_SEQUENCES,
) -> None:
    """Append one batch of mapping rows and move the frontier to where the caps are met."""
    if any(cap is not None and cap <= 0 for cap in (max_entries, max_bytes)):
        raise ValueError("a mapping store must be able to hold something")
    spark = batch.sparkSession
    delta = _delta(path, version, compact_every)
    merge(batch.select(*MAPPING_COLUMNS)).select(*MAPPING_COLUMNS).write.mode("overwrite").parquet(delta)
    before = read_state(spark, path, version - 1)
    offered = _in_front(_written(spark, path, version, compact_every), before)
    evicted = _first_evicted(offered, max_entries, max_bytes, part_sequences).select(
        F.col("salt_id").alias("_salt"), F.col("seq").alias("_seq"), F.col("placeholder").alias("_placeholder")
    )
    judged = offered.join(evicted, offered.salt_id == evicted["_salt"], "left")
    newer = (F.col("last_seq") > F.col("_seq")) | ((F.col("last_seq") == F.col("_seq")) & (F.col("placeholder") < F.col("_placeholder")))
    kept = F.col("_seq").isNull() | newer
    counts = judged.groupBy("salt_id").agg(
        F.count_if(kept).alias("entries"), F.coalesce(F.sum(F.when(kept, F.octet_length("secret"))), F.lit(0)).cast("bigint").alias("bytes"),
        F.count_if(~kept).alias("evicted"), F.first("_seq").alias("_seq"), F.first("_placeholder").alias("_placeholder"),
    )
    # A salt without rows in front of its frontier stays as it was.
    old = before.select("salt_id", F.col("frontier_seq").alias("_old_seq"), F.col("frontier_placeholder").alias("_old_placeholder"))
    written = spark.read.schema(MAPPING_SCHEMA).parquet(delta).groupBy("salt_id").agg(F.count("*").alias("written"))
    state = old.join(counts, "salt_id", "full").join(written, "salt_id", "left")
    moved = F.col("_seq").isNotNull()
    state.select(
        "salt_id", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("entries", "bytes", "evicted")),
        F.when(moved, F.col("_seq")).otherwise(F.col("_old_seq")).alias("frontier_seq"),
        F.when(moved, F.col("_placeholder")).otherwise(F.col("_old_placeholder")).alias("frontier_placeholder"),
        F.lit(version).cast("bigint").alias("version"), F.coalesce("written", F.lit(0)).cast("bigint").alias("written"),
    ).write.mode("overwrite").parquet(f"{path}/state/batch-{version}")
    if (version + 1) % compact_every == 0:
        read_store(spark, path, version, compact_every).write.mode("overwrite").parquet(_base(path, version, compact_every))


def latest_store(spark: SparkSession, path: str, compact_every: int = COMPACT_EVERY) -> DataFrame:
    """The store after the last batch."""
    newest = read_history(spark, path).agg(F.max("version")).first()[0]
    return read_store(spark, path, -1 if newest is None else newest, compact_every)


def store_to(mappings: DataFrame, path: str, checkpoint: str, **options: int):
    """Streaming sink that maintains the store under `path`; without caps it keeps everything."""
    return mappings.writeStream.foreachBatch(lambda batch, batch_id: record_batch(batch, batch_id, path, **options)).option(
        "checkpointLocation", checkpoint
    )
