"""Not-modified revisits of a web archive, resolved to full responses.

A revisit record (a 304 answer) has no body of its own. It refers to the latest earlier
full response of the same canonical URL; validators that both carry must agree. The
answer's headers then update the stored ones, except those that describe the connection or
the stored body.

The as-of step moves narrow rows only. Each URL's time is cut into buckets: within a bucket
a running window finds the latest response, and one row per bucket carries it forward, so a
URL that is captured all the time is many small tasks. Bodies are joined afterwards, by
record id, for the records that are referred to.

Defined results: `outcome` is `resolved`, `mismatch` (a shared validator differs),
`unverified` (no shared validator) or `orphan` (no earlier response; also for a null URL or
time). Only `resolved` and `unverified` revisits get headers and body. At equal times the
response with the larger id is later, and no response is earlier than a revisit of the same
time. Repeated records are resolved each. Responses and other records do not come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.functions.expressions import ascii_lower
from wardlake.llm.urls import canonical

HEADERS = "array<struct<name:string,value:string>>"
# Headers that a 304 answer does not update.
KEPT_STORED = (
    "connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer",
    "transfer-encoding", "upgrade", "content-length", "content-encoding", "content-range",
)
# Seconds of one URL's captures that one window orders.
BUCKET_SECONDS = 86_400


def header(headers: Column, name: str) -> Column:
    """First value of a header, by name without regard to case; null if absent."""
    return F.get(F.filter(headers, lambda h: ascii_lower(h["name"]) == name), F.lit(0))["value"]


def merge_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers updated by a not-modified answer's permitted headers."""
    named = F.split(ascii_lower(F.coalesce(header(fresh, "connection"), F.lit(""))), r"\s*,\s*")
    permitted = F.filter(
        F.coalesce(fresh, F.array().cast(HEADERS)),
        lambda h: ~ascii_lower(h["name"]).isin(*KEPT_STORED) & ~F.array_contains(named, ascii_lower(h["name"])),
    )
    replaced = F.transform(permitted, lambda h: ascii_lower(h["name"]))
    left = F.filter(F.coalesce(stored, F.array().cast(HEADERS)), lambda h: ~F.array_contains(replaced, ascii_lower(h["name"])))
    return F.concat(left, permitted)


def _agreement(mine: str, theirs: str) -> Column:
    """Whether a validator agrees; null unless both sides have it."""
    return F.col(mine) == F.col(theirs)


def latest_earlier(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Revisits with `found`: id, time and validators of the latest earlier response.

    `records` has record_id, url (canonical), ts, full (a response) and validators `v`; other
    columns of revisits are kept. Of responses at one time, the largest id counts, then the
    largest validators.
    """
    rows = records.where("url is not null and ts is not null").withColumn("bucket", F.floor(F.col("ts") / bucket_seconds))
    response = F.when(F.col("full"), F.struct("ts", "record_id", "v"))
    order = Window.partitionBy("url", "bucket").orderBy("ts", "full", "record_id", "v")
    placed = rows.withColumn("near", F.last(response, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    # One row per URL and bucket: its last response, and the one before the bucket.
    ends = rows.groupBy("url", "bucket").agg(F.max(response).alias("end"))
    before = Window.partitionBy("url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("url", "bucket", F.last("end", ignorenulls=True).over(before).alias("far"))
    revisits = placed.where(~F.col("full"))
    return revisits.join(carried, ["url", "bucket"], "left").withColumn("found", F.coalesce("near", "far")).drop("near", "far", "bucket")


def resolve_revisits(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Every revisit, with outcome, the record it refers to, merged headers and body.

    `records` has record_id, kind (`response`, `revisit`), status, url, ts (seconds), headers
    (array of name and value), digest (of the body; may be null) and body.
    """
    headers = F.col("headers")
    tag = F.regexp_replace(header(headers, "etag"), "^W/", "")
    validators = F.struct(tag.alias("etag"), header(headers, "last-modified").alias("modified"), F.col("digest").alias("digest"))
    is_full = (F.col("kind") == "response") & (F.col("status") == 200)
    # A revisit's own headers go with it, so that records with equal ids keep theirs.
    known = records.where(is_full | (F.col("kind") == "revisit")).select(
        "record_id", canonical(F.col("url")).alias("url"), "ts", (F.col("kind") == "response").alias("full"), validators.alias("v"),
        F.when(F.col("kind") == "revisit", headers).alias("fresh"),
    )
    resolved = latest_earlier(known, bucket_seconds)
    lost = known.where("not full and (url is null or ts is null)").withColumn("found", F.lit(None).cast(resolved.schema["found"].dataType))
    joined = resolved.unionByName(lost)
    checks = [_agreement(f"v.{name}", f"found.v.{name}") for name in ("digest", "etag", "modified")]
    agreed, differs = (F.coalesce(F.array_max(F.array(*(c if same else ~c for c in checks))), F.lit(False)) for same in (True, False))
    outcome = (
        F.when(F.col("found").isNull(), "orphan").when(differs, "mismatch").when(agreed, "resolved").otherwise("unverified")
    )
    decided = joined.select("record_id", "url", "ts", "found", "fresh", outcome.alias("outcome"))
    decided = decided.withColumn("usable", F.col("outcome").isin("resolved", "unverified"))
    # A response is known by id, URL, time and validators; of several such, the smallest counts.
    stored = records.where(is_full).select(
        canonical(F.col("url")).alias("url"), F.struct("ts", "record_id", validators.alias("v")).alias("found"), headers.alias("stored"), "body"
    )
    stored = stored.where("url is not null and found.ts is not null").groupBy("url", "found").agg(F.min(F.struct("stored", "body")).alias("s"))
    bodied = decided.where("usable").join(stored, ["url", "found"], "left").select(*decided.columns, "s.stored", "s.body")
    plain = decided.where("not usable").withColumn("stored", F.lit(None).cast(HEADERS)).withColumn("body", F.lit(None).cast("string"))
    return bodied.unionByName(plain).select(
        "record_id", "url", "ts", "outcome", F.col("found.record_id").alias("refers_to"),
        F.when(F.col("usable"), merge_headers(F.col("stored"), F.col("fresh"))).alias("headers"), "body",
    )
