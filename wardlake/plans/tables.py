"""Adapters: the given tables as requests, audit logs, statements and transcripts.

Every row is a fixed function of one table row, so work grows with the tables. The
`*_SQL` texts say the same for the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.operators.policy import Policy, Rule
from wardlake.schemas import FACTS_TYPE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(options: list[str | None], index: Column) -> Column:
    """An option by position."""
    result = F.when(index == 0, F.lit(options[0]))
    for i, option in enumerate(options[1:], start=1):
        result = result.when(index == i, F.lit(option))
    return result


def pick_sql(options: list[str | None], index: str) -> str:
    quoted = ["NULL" if o is None else "'" + o.replace("'", "''") + "'" for o in options]
    cases = " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(quoted))
    return f"(CASE {index} {cases} END)"


SALT = b"demonstration-salt"
MACHINE_SECRET = b"demonstration-machine-secret"

# Pages: one fetch per row.
PAGE_POLICY = Policy(
    version=1,
    default="deny",
    allow=["*.example.com", "*.example.org", "therin.example.net", "WWW.ththwh.example.org"],
    deny=["*.cheap-pills.example.com", "blog.tiontion.example.com", "*.ththed.example.org"],
)
URL_AUTHORITY_SQL = (
    "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1)"
)
URL_HOST_SQL = f"lower(rtrim(regexp_replace({URL_AUTHORITY_SQL}, ':[0-9]*$', ''), '.'))"


def domain_match_sql(patterns: list[str], host: str) -> str:
    tests = []
    for p in (x.lower() for x in patterns):
        if p.startswith("*."):
            tests.append(f"{host} = '{p[2:]}' OR ends_with({host}, '{p[1:]}')")
        else:
            tests.append(f"{host} = '{p}'")
    return "(" + " OR ".join(tests) + ")" if tests else "FALSE"


def egress_sql(policy: Policy, host: str) -> str:
    return (
        f"CASE WHEN {domain_match_sql(list(policy.deny), host)} THEN 'deny' "
        f"WHEN {domain_match_sql(list(policy.allow), host)} THEN 'allow' ELSE '{policy.default}' END"
    )


# Orders: one request per row, of a kind that depends on the order key.
ENDPOINTS: list[str | None] = ["k8s-prod", "postgres-prod", "web", None, "postgres-dev"]
DOMAINS: list[str | None] = [
    "github.com", "raw.githubusercontent.com", "API.anthropic.com", "wiki.internal.corp", "evil.test", None, "githubusercontent.com",
]
SQL_VERBS: list[str | None] = ["DROP", "TRUNCATE", "SELECT", "DELETE"]
K8S_RESOURCES: list[str | None] = ["secrets", "pods", "deployments"]
K8S_VERBS: list[str | None] = ["delete", "get", "list", "create"]
METHODS: list[str | None] = ["POST", "GET", "PUT"]
SAMPLE_POLICY = Policy(
    version=1,
    default="deny",
    allow=["github.com", "*.githubusercontent.com", "api.anthropic.com"],
    deny=["*.internal.corp"],
    rules=[
        Rule("protect-secrets", "k8s-prod", "k8s.resource == 'secrets' && k8s.verb == 'delete'", "deny"),
        Rule("review-drops", "postgres-prod", "sql.verb == 'DROP' || sql.verb == 'TRUNCATE'", "pause"),
        Rule("no-large-uploads", "*", "http.method == 'POST' AND http.body_size > 10485760", "deny"),
        Rule("broken", "*", "no_such.field = 1", "deny"),
        Rule("not-boolean", "*", "http.body_size", "deny"),
    ],
)
# The rules again, as SQL over the adapter's columns.
SAMPLE_RULES_SQL = (
    "CASE WHEN endpoint = 'k8s-prod' AND k_resource = 'secrets' AND k_verb = 'delete' THEN 'protect-secrets' "
    "WHEN endpoint = 'postgres-prod' AND s_verb IN ('DROP', 'TRUNCATE') THEN 'review-drops' "
    "WHEN h_method = 'POST' AND h_size > 10485760 THEN 'no-large-uploads' END"
)
RULE_VERDICT_SQL = (
    "CASE rule WHEN 'protect-secrets' THEN 'deny' WHEN 'review-drops' THEN 'pause' WHEN 'no-large-uploads' THEN 'deny' END"
)


def order_facts(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Orders as requests with facts: every fifth Kubernetes, every fifth SQL, the rest HTTP; and more columns."""
    key = F.col("o_orderkey")
    kind = key % 5
    k8s = F.struct(
        pick(K8S_VERBS, F.floor(key / 5) % 4).alias("verb"),
        pick(K8S_RESOURCES, F.floor(key / 20) % 3).alias("resource"),
        F.lit("prod").alias("namespace"),
    )
    sql = F.struct(pick(SQL_VERBS, F.floor(key / 5) % 4).alias("verb"), F.lit("accounts").alias("table"))
    http = F.struct(
        pick(METHODS, F.floor(key / 5) % 3).alias("method"),
        F.coalesce(pick(DOMAINS, F.col("o_custkey") % 7), F.lit("")).alias("host"),
        F.lit("/upload").alias("path"),
        F.floor(F.col("o_totalprice") * 100).cast("bigint").alias("body_size"),
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_orderdate").alias("ts"),
        pick(ENDPOINTS, kind).alias("endpoint"),
        pick(DOMAINS, F.col("o_custkey") % 7).alias("domain"),
        F.when(kind == 0, k8s).alias("k8s"),
        F.when(kind.isin(1, 4), sql).alias("sql"),
        F.when(kind.isin(2, 3), http).alias("http"),
        *more,
    )


ORDER_FACTS_SQL = f"""
SELECT o_orderkey, o_orderdate AS ts, o_orderkey % 5 AS kind,
  {pick_sql(ENDPOINTS, "o_orderkey % 5")} AS endpoint,
  lower({pick_sql(DOMAINS, "o_custkey % 7")}) AS domain,
  CASE WHEN o_orderkey % 5 = 0 THEN {pick_sql(K8S_VERBS, "(o_orderkey // 5) % 4")} END AS k_verb,
  CASE WHEN o_orderkey % 5 = 0 THEN {pick_sql(K8S_RESOURCES, "(o_orderkey // 20) % 3")} END AS k_resource,
  CASE WHEN o_orderkey % 5 IN (1, 4) THEN {pick_sql(SQL_VERBS, "(o_orderkey // 5) % 4")} END AS s_verb,
  CASE WHEN o_orderkey % 5 IN (2, 3) THEN {pick_sql(METHODS, "(o_orderkey // 5) % 3")} END AS h_method,
  CASE WHEN o_orderkey % 5 IN (2, 3) THEN {pick_sql(DOMAINS, "o_custkey % 7")} END AS h_host,
  CASE WHEN o_orderkey % 5 IN (2, 3) THEN CAST(floor(o_totalprice * 100) AS BIGINT) END AS h_size
FROM orders"""


# Parts: one SQL statement per row. `{k}` key, `{n}` name with underscores.
STATEMENTS = [
    "DROP TABLE IF EXISTS public.{n}_{k};",
    'delete from "Sessions_{k}"',
    "INSERT INTO logs_{k} (a) VALUES (1)",
    "update Users_{k} set x=1",
    "SELECT * FROM public.Orders_{k} WHERE id = 1",
    "TRUNCATE ONLY accounts_{k}",
    "DROP MATERIALIZED VIEW `mv`.`V_{k}`",
    "ALTER TABLE t_{k} ADD c",
    "SELECT {k}",
    "  \n select a\tfrom  {n}_{k} ;",
    "DROP INDEX CONCURRENTLY idx_{k}",
    "",
]


def part_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    text = pick(STATEMENTS, key % len(STATEMENTS))
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    text = F.replace(F.replace(text, F.lit("{k}"), key.cast("string")), F.lit("{n}"), name)
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("statement"))


PART_STATEMENTS_SQL = (
    f"SELECT p_partkey, replace(replace({pick_sql(STATEMENTS, f'p_partkey % {len(STATEMENTS)}')}, "
    "'{k}', CAST(p_partkey AS VARCHAR)), '{n}', replace(p_name, ' ', '_')) AS statement FROM part"
)

# Orders again: one Kubernetes API request per row.
API_PATHS = [
    "/api/v1/namespaces/NS{k}/secrets/s{k}", "/api/v1/namespaces", "/api/v1/namespaces/ns{k}", "/api/v1/nodes?limit=5",
    "/apis/apps/v1/namespaces/staging/Deployments/api", "/apis/apps/v1/deployments/api", "/healthz", "/api/v1",
    "/api/v1/namespaces/a/pods",
]
API_METHODS = ["GET", "POST", "put", "PATCH", "DELETE", "HEAD"]


def api_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    path = F.replace(pick(API_PATHS, key % len(API_PATHS)), F.lit("{k}"), (key % 100).cast("string"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", pick(API_METHODS, F.floor(key / 9) % len(API_METHODS)).alias("method"), path.alias("path")
    )


API_REQUESTS_SQL = (
    f"SELECT o_orderkey, {pick_sql(API_METHODS, f'(o_orderkey // 9) % {len(API_METHODS)}')} AS method, "
    f"replace({pick_sql(API_PATHS, f'o_orderkey % {len(API_PATHS)}')}, '{{k}}', CAST(o_orderkey % 100 AS VARCHAR)) AS path FROM orders"
)

# Events: an audit log.
DECISION_OF_EVENT = {
    "view": ("allowed", "allow"), "error": ("denied", "deny"), "purchase": ("paused", "pause"),
    "signup": ("approved", "pause"), "click": ("rejected", "pause"),
}


def _event_case(position: int) -> Column:
    result = None
    for name, pair in DECISION_OF_EVENT.items():
        hit = F.col("event_type") == name
        result = F.when(hit, pair[position]) if result is None else result.when(hit, pair[position])
    return result


def _event_case_sql(position: int) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v[position]}'" for k, v in DECISION_OF_EVENT.items())
    return f"CASE event_type {cases} END"


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_rows(table(spark, sf_dir, "events"))


def audit_rows(events: DataFrame) -> DataFrame:
    """Events as an audit log: a hold is four neighbouring events at most."""
    user = F.col("user_id")
    domain = F.when(
        user % 11 != 0, F.concat(F.lit("Host"), (user % 7).cast("string"), F.when(user % 2 == 0, ".internal.corp").otherwise(".example.com"))
    )
    facts = F.struct(
        domain.alias("domain"), F.lit(None).cast("string").alias("endpoint"),
        *[F.lit(None).alias(c) for c in ("http", "sql", "k8s", "pii")],
    ).cast(FACTS_TYPE)
    return events.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        _event_case(0).alias("decision"),
        _event_case(1).alias("verdict"),
        F.when(user % 3 == 0, F.lit("sample-rule")).alias("rule"),
        facts.alias("facts"),
        F.when(F.col("event_type").isin("purchase", "signup", "click"), F.floor(F.col("event_id") / 4)).alias("approval_id"),
        F.concat(F.lit("log-"), (user % 5).cast("string")).alias("log_id"),
    )


AUDIT_SQL = f"""
SELECT event_id AS id, ts AS timestamp, {_event_case_sql(0)} AS decision, {_event_case_sql(1)} AS verdict,
  CASE WHEN user_id % 3 = 0 THEN 'sample-rule' END AS rule,
  CASE WHEN user_id % 11 <> 0 THEN 'Host' || (user_id % 7) || CASE WHEN user_id % 2 = 0 THEN '.internal.corp' ELSE '.example.com' END END AS domain,
  CASE WHEN event_type IN ('purchase', 'signup', 'click') THEN event_id // 4 END AS approval_id,
  'log-' || (user_id % 5) AS log_id
FROM events"""
