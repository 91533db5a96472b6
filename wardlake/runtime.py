"""Session-level helpers: shared scratch space and the streaming state store."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared one that the session names.

    A cluster without one is an error; only a single-machine session gets a local one.
    What is written there may hold live secrets: keep the folder restricted.
    """
    base = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(_CHECKPOINT_KEY)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder that all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/wardlake/{purpose}-{uuid.uuid4().hex}"


def use_state_store(spark: SparkSession) -> None:
    """Select the state store that stateful processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
