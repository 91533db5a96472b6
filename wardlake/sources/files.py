"""Sources and sinks of policies, evaluation records, corpora, captures and transcripts."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.operators.corpus import label_tables
from wardlake.operators.policy import Policy
from wardlake.schemas import EVAL_SCHEMA, KDPII_SCHEMA, PAYLOAD_SCHEMA, REQUEST_SCHEMA, TRANSCRIPT_COLUMNS


def read_policy(path: str) -> Policy:
    """A policy file (YAML or JSON). It is configuration: small, and read on the driver."""
    return Policy.from_text(Path(path).read_text(encoding="utf-8"))


def read_labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """`labels` and `label_map` tables of a label configuration file."""
    import yaml

    doc = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    return label_tables(spark, doc["labels"])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation records; blank lines are skipped and a malformed one fails."""
    return spark.read.schema(EVAL_SCHEMA).option("mode", "FAILFAST").json(path)


def write_records(records: DataFrame, path: str) -> None:
    records.write.mode("errorifexists").json(path)


def read_kdpii(spark: SparkSession, path: str) -> DataFrame:
    """A corpus file: one JSON array of sentences."""
    return spark.read.schema(KDPII_SCHEMA).option("multiLine", True).json(path)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Captured requests (Parquet)."""
    return spark.read.schema(REQUEST_SCHEMA).parquet(path)


def stream_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(REQUEST_SCHEMA).parquet(path)


def parse_transcripts(lines: DataFrame, value: str = "value") -> DataFrame:
    """Hook payloads from a text column; one that is no JSON object is ignored.

    `tool_response` keeps its JSON text whatever its shape.
    """
    payload = F.from_json(value, f"{PAYLOAD_SCHEMA}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    parsed = lines.select(
        payload.alias("p"), F.to_json(F.try_variant_get(F.try_parse_json(value), "$.tool_response", "variant")).alias("r")
    )
    return parsed.where(F.col("p").isNotNull() & F.col("p._corrupt").isNull()).select(
        *[F.col("r").alias("tool_response") if n == "tool_response" else F.col(f"p.{n}") for n in TRANSCRIPT_COLUMNS]
    )


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    return parse_transcripts(spark.read.text(path))
