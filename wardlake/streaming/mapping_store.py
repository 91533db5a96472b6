"""A live mapping store: a bounded table that grows and evicts batch by batch.

Each batch writes a new version of the table in one of two slots, so the version before
stays until the new one is complete, and evicted secrets do not stay on disk. A batch
that is retried writes the same version again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.operators.mappings import merge, retained
from wardlake.schemas import MAPPING_COLUMNS, MAPPING_SCHEMA


def read_store(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The newest version or the one before; before the first batch the store is empty.

    A version whose folder is missing is an error, not an empty store.
    """
    if version < 0:
        return spark.createDataFrame([], MAPPING_SCHEMA)
    return spark.read.schema(MAPPING_SCHEMA).parquet(_slot(path, version))


def _slot(path: str, version: int) -> str:
    return f"{path}/store/slot-{version % 2}"


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Entries kept and evicted per batch."""
    return spark.read.parquet(f"{path}/metrics")


def latest_store(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of the store."""
    newest = read_metrics(spark, path).agg(F.max("version")).first()[0]
    return read_store(spark, path, newest)


def record_batch(
    batch: DataFrame,
    version: int,
    path: str,
    max_entries: int | None = None,
    max_bytes: int | None = None,
) -> None:
    """Merge one batch of mapping rows and evict what exceeds the caps."""
    spark = batch.sparkSession
    # The batch is read twice below: write it once instead of minting it again.
    batch.select(*MAPPING_COLUMNS).write.mode("overwrite").parquet(f"{path}/offered")
    new = spark.read.schema(MAPPING_SCHEMA).parquet(f"{path}/offered")
    offered = merge(read_store(spark, path, version - 1), new)
    retained(offered, max_entries, max_bytes).write.mode("overwrite").parquet(_slot(path, version))
    kept = read_store(spark, path, version).agg(
        F.count("*").alias("entries"),
        F.coalesce(F.sum(F.octet_length("secret")), F.lit(0)).alias("bytes"),
    )
    before = offered.agg(F.count("*"))
    kept.select("entries", "bytes", (before.scalar() - F.col("entries")).alias("evicted")).write.mode("overwrite").parquet(f"{path}/metrics/version={version}")


def store_to(mappings: DataFrame, path: str, checkpoint: str, **caps: int):
    """Streaming sink that maintains the store under `path`; without caps it keeps everything."""
    return mappings.writeStream.foreachBatch(
        lambda batch, batch_id: record_batch(batch, batch_id, path, **caps)
    ).option("checkpointLocation", checkpoint)
