"""Queries written in SQL with the session's registered functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake import sqlfunctions
from wardlake.plans.policy_queries import PATHS
from wardlake.plans.registry import query
from wardlake.plans.tables import URL_AUTHORITY_SQL, URL_HOST_SQL, pick_sql, table


def _view(spark: SparkSession, sf_dir: str, name: str) -> str:
    view = f"wardlake_{name}"
    table(spark, sf_dir, name).createOrReplaceTempView(view)
    return view


@query(
    f"""SELECT page_id, host, host = 'example.org' OR ends_with(host, '.example.org') AS is_org FROM (SELECT page_id, {URL_HOST_SQL} AS host FROM pages)"""
)
def sql_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host functions from SQL."""
    sqlfunctions.register(spark)
    authority = URL_AUTHORITY_SQL.replace("'^", "r'^")
    return spark.sql(
        f"""SELECT page_id, host, matches_domain('*.Example.org', host) AS is_org
        FROM (SELECT page_id, canonical_host({authority}) AS host FROM {_view(spark, sf_dir, 'pages')})"""
    )


_SENSITIVE = """CASE WHEN regexp_matches(base, '\\.(example|sample|template|dist)$') THEN FALSE ELSE
  regexp_matches(base, '^\\.env(rc)?$|^\\.env\\.') OR base IN ('.git-credentials', '.netrc', '.npmrc', '.pypirc', 'credentials')
  OR (regexp_matches(base, '^id_(rsa|dsa|ecdsa|ed25519)') AND NOT ends_with(base, '.pub'))
  OR regexp_matches(base, '\\.(pem|key|p12|pfx|keystore|jks|asc)$') OR contains(u, '.aws/credentials') OR contains(u, '.gnupg/') END"""


@query(
    f"""SELECT sensitive, count(*) AS n FROM (SELECT {_SENSITIVE} AS sensitive FROM (SELECT replace(lower(path), '\\', '/') AS u, string_split(replace(lower(path), '\\', '/'), '/')[-1] AS base
  FROM (SELECT {pick_sql(PATHS, f'page_id % {len(PATHS)}')} AS path FROM pages))) GROUP BY sensitive"""
)
def sql_sensitive_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path rule from SQL."""
    sqlfunctions.register(spark)
    path = pick_sql([p.replace("\\", "\\\\") for p in PATHS], f"page_id % {len(PATHS)}")
    return spark.sql(
        f"SELECT sensitive, count(*) AS n FROM (SELECT is_sensitive_path({path}) AS sensitive FROM {_view(spark, sf_dir, 'pages')}) GROUP BY sensitive"
    )


@query(
    """SELECT doc_id, path, depth, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (
SELECT doc_id, '$.text' AS path, 1 AS depth, text FROM documents UNION ALL SELECT doc_id, '$.tags[0]', 2, lang FROM documents
UNION ALL SELECT doc_id, '$.tags[1].source', 3, source FROM documents) GROUP BY ALL"""
)
def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String leaves of JSON values, with path and depth."""
    sqlfunctions.register(spark)
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("t"))), "(?s)^.{5}(.*).$", 1)
    value = F.concat(
        F.lit('{"text":'), quoted, F.lit(',"n":1,"tags":["'), "lang", F.lit('",{"source":"'), "source", F.lit('","no":null}]}')
    )
    table(spark, sf_dir, "documents").select("doc_id", value.alias("j")).createOrReplaceTempView("wardlake_json")
    return spark.sql(
        """SELECT doc_id, path, depth, count(*) AS n, sum(length(t.text)) AS chars
        FROM wardlake_json d, LATERAL json_string_leaves(d.j) t GROUP BY doc_id, path, depth"""
    )
