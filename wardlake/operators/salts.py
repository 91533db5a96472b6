"""Salts as tables: machine secrets are rows, session salts are derived once per session.

Pads in a plan are literals that `explain`, event logs and the UI show. Here a plan holds
paths and column names only. The tables are secret: keep them on a restricted path.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.functions.masking import pad_bytes, session_pads

MACHINE_SCHEMA = "machine_id string, inner binary, outer binary"


def write_machines(spark: SparkSession, secrets: Mapping[str, bytes], path: str) -> None:
    """Write the pads of machine secrets as a table; done once, where the secrets are known."""
    rows = [(machine, *map(bytearray, pad_bytes(secret))) for machine, secret in secrets.items()]
    spark.createDataFrame(rows, MACHINE_SCHEMA).write.mode("overwrite").parquet(path)


def read_machines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MACHINE_SCHEMA).parquet(path)


def session_salts(sessions: DataFrame, machines: DataFrame, session_id: str = "session_id", machine_id: str = "machine_id") -> DataFrame:
    """(machine_id, session_id, pads) of every distinct session; a session of an unknown machine has no row.

    `sessions` has the two ids; a null session is the machine's empty context.
    """
    known = sessions.select(F.col(machine_id).alias("machine_id"), F.coalesce(F.col(session_id), F.lit("")).alias("session_id")).distinct()
    pads = session_pads("session_id", F.struct("inner", "outer"))
    return known.join(machines, "machine_id").select("machine_id", "session_id", pads.alias("pads"))


def with_pads(rows: DataFrame, salts: DataFrame, session_id: str = "session_id", machine_id: str = "machine_id") -> DataFrame:
    """Add `pads` to rows of sessions; a row without a salt fails the job."""
    salts = salts.select(F.col("machine_id").alias("_machine"), F.col("session_id").alias("_session"), F.col("pads").alias("_pads"))
    same = (F.col(machine_id) == F.col("_machine")) & (F.coalesce(F.col(session_id), F.lit("")) == F.col("_session"))
    missing = F.raise_error(F.concat(F.lit("no salt for session "), F.coalesce(F.col(session_id), F.lit("(none)"))))
    joined = rows.join(salts, same, "left")
    pads = F.when(F.col("_session").isNull(), missing.cast(dict(salts.dtypes)["_pads"])).otherwise(F.col("_pads"))
    return joined.select(*(rows[c] for c in rows.columns), pads.alias("pads"))
