"""Audit log source and sink: JSON lines, one event per line."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.schemas import AUDIT_SCHEMA

# RFC 3339 with microseconds.
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"

_CORRUPT = "_corrupt_record"


def _open(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines table; a path that does not exist is an empty log."""
    schema = f"{AUDIT_SCHEMA}, {_CORRUPT} string"
    try:
        return spark.read.schema(schema).option("columnNameOfCorruptRecord", _CORRUPT).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of a log; blank and malformed lines are skipped, and so are empty objects."""
    is_event = F.coalesce(F.col("id").cast("string"), F.col("timestamp").cast("string"), F.col("decision")).isNotNull()
    return _open(spark, path).where(F.col(_CORRUPT).isNull() & is_event).drop(_CORRUPT)


def read_rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """Malformed lines of a log, for inspection."""
    # The reader needs a data column next to the text; the id is useful for a cut line.
    return _open(spark, path).where(F.col(_CORRUPT).isNotNull()).select(F.col(_CORRUPT).alias("line"), "id")


def stream_audit_log(spark: SparkSession, path: str) -> DataFrame:
    """A log directory as a stream."""
    return spark.readStream.schema(AUDIT_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def append_audit_log(events: DataFrame, path: str) -> None:
    """Append events; absent fields are left out of the JSON."""
    events.write.mode("append").option("ignoreNullFields", "true").option(
        "timestampFormat", TIMESTAMP_FORMAT
    ).json(path)


def stream_to_audit_log(events: DataFrame, path: str, checkpoint: str):
    """Streaming sink of the same format."""
    return (
        events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
        .option("timestampFormat", TIMESTAMP_FORMAT)
        .outputMode("append")
    )
