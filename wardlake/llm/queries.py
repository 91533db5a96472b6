"""One registered query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.llm import ann, lexical, mixing, packing, quality, secret_scan, sharding, simhash, tokens, urls, warc, wavelet, whitening
from wardlake.llm.common import table, word_count
from wardlake.llm.registry import ORACLES, QUERIES, query  # noqa: F401

# Shards of the placement query: name and weight. The last one has twice the room.
SHARDS = {f"shard-{i:02d}": 1 for i in range(47)} | {"shard-47": 2}
# Pages with less markup than this are listed as thin.
THIN_PAGE = 900


@query()
def op1_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


@query()
def op2_shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document."""
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


@query()
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of the secrets in every document."""
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


@query()
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokens.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query()
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


# Canonical form of a URL, as a DuckDB macro body over {url}.
_CANONICAL = r"""CASE WHEN contains({url}, '://') THEN
  regexp_replace(regexp_replace(lower(regexp_extract({url}, '://([^/?#]*)', 1)), '^(www|m)\.', ''), ':(80|443)$', '')
  || regexp_replace(regexp_replace(regexp_extract({url}, '://[^/?#]*([^?#]*)', 1), '(/index)?\.html$', ''), '/+$', '')
  || coalesce('?' || nullif(array_to_string(list_sort(list_filter(
       string_split(regexp_extract({url}, '^[^#]*?://[^?#]*\?([^#]*)', 1), '&'),
       lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid|msclkid|sessionid|sid)(=|$)'))), '&'), ''), '')
END"""

_URL_SQL = f"""
WITH parsed AS (
  SELECT page_id, coalesce(lower(regexp_extract(url, '://([^/?#]*)', 1)), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
         {_CANONICAL.format(url="url")} AS canonical, html
  FROM pages),
thin AS (SELECT DISTINCT canonical FROM parsed WHERE length(html) < 900 AND canonical IS NOT NULL),
ruled AS (
  SELECT parsed.*,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM parsed)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN thin.canonical IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  thin.canonical IS NOT NULL AS listed
FROM ruled LEFT JOIN thin USING (canonical)
"""


@query(_URL_SQL)
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page; the list has the addresses of thin pages."""
    pages = table(spark, sf_dir, "pages")
    thin = pages.where(F.length("html") < THIN_PAGE).select("url")
    return urls.judge_urls(pages, thin)


@query()
def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


@query()
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and offset of every piece of every document, measured in words."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs.select("doc_id", word_count(F.col("text")).alias("length")))


@query()
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    return quality.quality(table(spark, sf_dir, "documents"))


def captures(pages: DataFrame) -> DataFrame:
    """Archive records of the pages: a response each, and a later or earlier revisit.

    Entity tags are digests of the markup; some revisits carry a weak tag, a stale one, a
    date or nothing.
    """
    page, tag = F.col("page_id"), F.md5("html")

    def headers(*pairs: tuple[str, object]):
        return F.array(*(F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in pairs))

    date = F.concat(F.lit("day "), (page % 97).cast("string"))
    responses = pages.select(
        (page * 2).alias("record_id"), F.lit("response").alias("kind"), F.lit(200).alias("status"), "url", (page * 600).alias("ts"),
        headers(
            ("Content-Type", F.lit("text/html")), ("Content-Length", F.length("html").cast("string")), ("ETag", tag),
            ("Last-Modified", date), ("Cache-Control", F.lit("max-age=60")),
        ).alias("headers"),
        F.lit(None).cast("string").alias("digest"), F.col("html").alias("body"),
    )
    fresh = ("Cache-Control", F.concat(F.lit("max-age="), page.cast("string")))
    length, hop = ("Content-Length", F.lit("0")), ("Connection", F.lit("close, X-Hop"))
    sent = (
        F.when(page % 7 == 0, headers(("etag", F.concat(F.lit("W/"), tag)), fresh, hop, ("X-Hop", F.lit("1"))))
        .when(page % 7 == 1, headers(("etag", F.lit("stale")), fresh))
        .when(page % 7 == 2, headers(("last-modified", date), fresh, length))
        .when(page % 7 == 3, headers(fresh, length))
        .otherwise(headers(("ETag", tag), fresh))
    )
    late = F.when(page % 11 == 0, page * 600 - 1).otherwise(page * 600 + (page % 13) * 43_200 + 1)
    revisits = pages.select(
        (page * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), "url", late.alias("ts"),
        sent.alias("headers"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("string").alias("body"),
    )
    return responses.unionByName(revisits)


_WARC_SQL = f"""
WITH base AS (SELECT page_id, md5(html) AS tag, html, 'day ' || (page_id % 97) AS day, {_CANONICAL.format(url="url")} AS url FROM pages),
full_ AS (SELECT page_id * 2 AS record_id, url, page_id * 600 AS ts, tag, day, html FROM base),
revisits AS (
  SELECT page_id, page_id * 2 + 1 AS record_id, url,
    CASE WHEN page_id % 11 = 0 THEN page_id * 600 - 1 ELSE page_id * 600 + (page_id % 13) * 43200 + 1 END AS ts,
    CASE WHEN page_id % 7 = 1 THEN 'stale' WHEN page_id % 7 IN (2, 3) THEN NULL ELSE tag END AS tag,
    CASE WHEN page_id % 7 = 2 THEN day END AS day
  FROM base),
found AS (
  SELECT r.*, f.record_id AS source, f.tag AS f_tag, f.day AS f_day, f.html AS f_html,
    row_number() OVER (PARTITION BY r.record_id ORDER BY f.ts DESC, f.record_id DESC) AS n
  FROM revisits r LEFT JOIN full_ f ON r.url = f.url AND f.ts < r.ts),
judged AS (
  SELECT *, CASE WHEN source IS NULL THEN 'orphan' WHEN tag <> f_tag OR day <> f_day THEN 'mismatch'
    WHEN tag = f_tag OR day = f_day THEN 'resolved' ELSE 'unverified' END AS outcome
  FROM found WHERE n = 1)
SELECT record_id, url, ts, outcome, source AS refers_to,
  CASE WHEN outcome IN ('resolved', 'unverified') THEN
    concat_ws(chr(10), 'Content-Type: text/html', 'Content-Length: ' || length(f_html),
      CASE WHEN page_id % 7 IN (2, 3) THEN 'ETag: ' || f_tag END,
      CASE WHEN page_id % 7 <> 2 THEN 'Last-Modified: ' || f_day END,
      CASE WHEN page_id % 7 = 0 THEN 'etag: W/' || tag WHEN page_id % 7 = 2 THEN 'last-modified: ' || day
           WHEN page_id % 7 = 3 THEN NULL ELSE 'ETag: ' || tag END,
      'Cache-Control: max-age=' || page_id) END AS headers,
  CASE WHEN outcome IN ('resolved', 'unverified') THEN md5(f_html) END AS body_md5
FROM judged
"""


@query(_WARC_SQL)
def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response, outcome and merged headers of every revisit among the pages' captures."""
    resolved = warc.resolve_revisits(captures(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    lines = F.transform("headers", lambda h: F.concat_ws(": ", h["name"], h["value"]))
    return resolved.select(
        "record_id", "url", "ts", "outcome", "refers_to", F.when(F.col("headers").isNotNull(), F.array_join(lines, "\n")).alias("headers"),
        F.md5("body").alias("body_md5"),
    )


@query()
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op12_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, tokens and checksum of every document, read back from shard files."""
    import public_tokenizers

    return wavelet.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query()
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading whitened components of every vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query()
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
