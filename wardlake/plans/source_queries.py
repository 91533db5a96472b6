"""Sources: a given table is written in a source's format, read back through it, and compared."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.functions.hosts import request_host
from wardlake.functions.pii import SPAN_TYPE
from wardlake.operators.policy import egress_verdict
from wardlake.plans.registry import query
from wardlake.plans.tables import PAGE_POLICY, URL_HOST_SQL, egress_sql, pick, table
from wardlake.runtime import shared_dir
from wardlake.schemas import META_TYPE, RECORD_COLUMNS, REQUEST_SCHEMA
from wardlake.sources.files import read_policy, read_records, read_requests, read_transcripts, write_records


@query(
    """SELECT 'doc-' || doc_id AS id, lang, md5(text) AS text_md5, CAST(1 AS BIGINT) AS spans, 'test' AS split FROM documents
UNION ALL SELECT 'again-' || doc_id, lang, md5(text), 1, 'test' FROM documents"""
)
def records_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as evaluation records: once as written by the sink, once among blank lines."""
    span = F.struct(
        F.lit(0).cast("bigint").alias("start"), F.lit(1).cast("bigint").alias("end"), F.lit("EMAIL").alias("label"),
        F.substring("text", 1, 1).alias("text"), F.lit(1).cast("bigint").alias("tier"),
    )
    meta = F.struct(F.lit("test").alias("split"), F.lit("easy").alias("difficulty"), F.lit(None).cast("string").alias("domain")).cast(META_TYPE)
    records = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), "source", F.lit("prose").alias("surface"), "lang", "text",
        F.array(span).cast(f"array<{SPAN_TYPE}>").alias("spans"), meta.alias("meta"),
    ).select(*RECORD_COLUMNS)
    path = shared_dir(spark, "records")
    write_records(records, f"{path}/sink")
    again = records.withColumn("id", F.replace("id", F.lit("doc-"), F.lit("again-")))
    lines = again.select(F.explode(F.array(F.lit(""), F.to_json(F.struct(*RECORD_COLUMNS)), F.lit("  "))).alias("value"))
    lines.write.text(f"{path}/lines")
    read = read_records(spark, f"{path}/sink").unionByName(read_records(spark, f"{path}/lines"))
    return read.select("id", "lang", F.md5("text").alias("text_md5"), F.size("spans").cast("bigint").alias("spans"), F.col("meta.split").alias("split"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN 'PUT' ELSE 'POST' END AS method, 'h' || (doc_id % 7) AS host, md5(text) AS body_md5 FROM documents")
def captured_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as captured requests in Parquet."""
    key = F.col("doc_id")
    requests = table(spark, sf_dir, "documents").select(
        F.lit(None).cast("timestamp").alias("ts"), F.lit("c").alias("client"), F.lit(False).alias("is_connect"),
        pick(["POST", "PUT", "POST"], key % 3).alias("method"), F.concat(F.lit("/d/"), key.cast("string")).alias("uri"),
        F.create_map(F.lit("host"), F.concat(F.lit("h"), (key % 7).cast("string"))).alias("headers"), F.lit(None).cast("string").alias("endpoint"),
        F.lit(None).cast("bigint").alias("content_length"), F.encode("text", "UTF-8").alias("body"),
    )
    path = shared_dir(spark, "requests")
    requests.write.parquet(path)
    read = read_requests(spark, path)
    assert read.schema == spark.createDataFrame([], REQUEST_SCHEMA).schema
    return read.select(
        F.regexp_extract("uri", "([0-9]+)$", 1).cast("bigint").alias("doc_id"), "method", F.col("headers")["host"].alias("host"), F.md5("body").alias("body_md5")
    )


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS session_id, 'PostToolUse' AS event, CASE WHEN doc_id % 4 = 1 THEN NULL ELSE 'Read' END AS tool_name, md5(text) AS prompt_md5,
  doc_id % 4 <> 1 AS responded FROM documents WHERE doc_id % 4 <> 3"""
)
def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as hook payloads, one a line; every fourth line is blank or broken."""
    key = F.col("doc_id")
    payload = F.to_json(
        F.struct(
            key.cast("string").alias("session_id"), F.lit("PostToolUse").alias("hook_event_name"), F.when(key % 4 != 1, "Read").alias("tool_name"),
            F.col("text").alias("prompt"), F.when(key % 4 != 1, F.struct(F.lit("x").alias("stdout"))).alias("tool_response"),
        )
    )
    broken = F.when(key % 8 == 3, "").otherwise(F.concat(F.lit("{"), payload))
    path = shared_dir(spark, "transcripts")
    table(spark, sf_dir, "documents").select(F.when(key % 4 == 3, broken).otherwise(payload).alias("value")).write.text(path)
    return read_transcripts(spark, path).select(
        "session_id", F.col("hook_event_name").alias("event"), "tool_name", F.md5("prompt").alias("prompt_md5"), F.col("tool_response").isNotNull().alias("responded")
    )


@query(f"SELECT page_id, {egress_sql(PAGE_POLICY, URL_HOST_SQL)} AS verdict FROM pages")
def policy_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages under a policy that was read from a file."""
    document = {"version": 1, "egress": {"default": PAGE_POLICY.default, "allow": list(PAGE_POLICY.allow), "deny": list(PAGE_POLICY.deny)}}
    # Configuration is read on the driver alone.
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "policy.json")
        with open(path, "w", encoding="utf-8") as file:
            json.dump(document, file)
        policy = read_policy(path)
    pages = table(spark, sf_dir, "pages").withColumn("headers", F.create_map().cast("map<string,string>"))
    return pages.select("page_id", egress_verdict(policy, request_host("url", "headers")).alias("verdict"))
