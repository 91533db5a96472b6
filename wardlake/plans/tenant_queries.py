"""Queries over the policies of many tenants: every customer has one, every order is a request under it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.operators.policy_documents import document_problems, document_tables
from wardlake.operators.rule_tables import decide_by_tables, residual_conditions, rule_faults
from wardlake.plans.registry import query
from wardlake.plans.tables import K8S_VERBS, ORDER_FACTS_SQL, SQL_VERBS, order_facts, pick, pick_sql, table

_DEFAULTS = ["allow", "deny", "pause", "deny"]
_DROP_VERDICTS = ["deny", "pause", "allow"]


def _policy(key: str) -> Column:
    return F.concat(F.lit("tenant-"), F.col(key).cast("string"))


def tenant_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five rules per customer, whose conditions differ from customer to customer."""
    c = F.col("c_custkey")

    def rule(pos: int, name: str, endpoint: Column, condition: Column, verdict: Column) -> Column:
        return F.struct(F.lit(pos).alias("pos"), F.lit(name).alias("name"), endpoint.alias("endpoint"), condition.alias("condition"), verdict.alias("verdict"))

    text, every = F.format_string, F.lit("*")
    rules = F.array(
        rule(0, "large-posts", every, text("http.method == 'POST' && http.body_size > %d", c % 50 * 400_000), F.lit("deny")),
        rule(1, "secrets", F.lit("k8s-prod"), text("k8s.resource == 'secrets' AND k8s.verb IN ('%s', 'create')", pick(K8S_VERBS, c % 4)), F.lit("pause")),
        rule(
            2, "drops", F.when(c % 2 == 0, "postgres-prod").otherwise("*"),
            text("sql.verb == 'DROP' || sql.verb == '%s' && sql.table != 'logs'", pick(SQL_VERBS, c % 4)), pick(_DROP_VERDICTS, c % 3),
        ),
        F.when(c % 5 == 0, rule(3, "long-hosts", every, text("length(http.host) > %d", c % 3 * 6), F.lit("allow"))),
        F.when(c % 7 == 0, rule(4, "broken", every, F.lit("no_such.field = 1"), F.lit("deny"))),
    )
    listed = table(spark, sf_dir, "customer").select(_policy("c_custkey").alias("policy"), F.explode(F.array_compact(rules)).alias("r"))
    return listed.select("policy", "r.*")


def tenant_egress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain lists of every customer."""
    c = F.col("c_custkey")
    lists = [("allow", "GitHub.com", F.lit(True)), ("allow", "*.githubusercontent.com", c % 2 == 0), ("deny", "*.internal.corp", c % 3 != 0)]
    entries = F.array(*(F.when(has, F.struct(F.lit(kind).alias("kind"), F.lit(pattern).alias("pattern"))) for kind, pattern, has in lists))
    return table(spark, sf_dir, "customer").select(_policy("c_custkey").alias("policy"), F.explode(F.array_compact(entries)).alias("e")).select("policy", "e.*")


def tenant_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests under their customer's policy."""
    return order_facts(spark, sf_dir, _policy("o_custkey").alias("policy"))


_RULE = f"""CASE WHEN h_method = 'POST' AND h_size > (c % 50) * 400000 THEN 'large-posts'
  WHEN endpoint = 'k8s-prod' AND k_resource = 'secrets' AND k_verb IN ({pick_sql(K8S_VERBS, 'c % 4')}, 'create') THEN 'secrets'
  WHEN (c % 2 = 1 OR endpoint = 'postgres-prod') AND s_verb IN ('DROP', {pick_sql(SQL_VERBS, 'c % 4')}) THEN 'drops'
  WHEN c % 5 = 0 AND kind IN (2, 3) AND length(coalesce(h_host, '')) > (c % 3) * 6 THEN 'long-hosts' END"""
_LISTED = """CASE WHEN c % 3 <> 0 AND (domain = 'internal.corp' OR ends_with(domain, '.internal.corp')) THEN 'deny'
  WHEN domain = 'github.com' OR c % 2 = 0 AND (domain = 'githubusercontent.com' OR ends_with(domain, '.githubusercontent.com')) THEN 'allow'"""


@query(
    f"""SELECT o_orderkey, 'tenant-' || c AS policy, rule, CASE rule WHEN 'large-posts' THEN 'deny' WHEN 'secrets' THEN 'pause'
  WHEN 'drops' THEN {pick_sql(_DROP_VERDICTS, 'c % 3')} WHEN 'long-hosts' THEN 'allow' ELSE {_LISTED} ELSE {pick_sql(_DEFAULTS, 'c % 4')} END END AS verdict
FROM (SELECT *, {_RULE} AS rule FROM (SELECT f.*, o.o_custkey AS c FROM ({ORDER_FACTS_SQL}) f JOIN orders o USING (o_orderkey)))"""
)
def tenant_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every request under the policy of its own tenant, with policies as tables."""
    rules = tenant_rules(spark, sf_dir)
    defaults = table(spark, sf_dir, "customer").select(_policy("c_custkey").alias("policy"), pick(_DEFAULTS, F.col("c_custkey") % 4).alias("default"))
    residual = [r["condition"] for r in residual_conditions(rules).collect()]
    decided = decide_by_tables(tenant_requests(spark, sf_dir), "o_orderkey", rules, tenant_egress(spark, sf_dir), defaults, residual)
    return decided.select("o_orderkey", "policy", "verdict", "rule")


@query("SELECT 'tenant-' || c_custkey AS policy, 4 AS pos, 'broken' AS name, 'invalid' AS fault FROM customer WHERE c_custkey % 7 = 0")
def tenant_rule_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that can never match, and why."""
    rules = tenant_rules(spark, sf_dir)
    residual = [r["condition"] for r in residual_conditions(rules).collect()]
    return rule_faults(rules, tenant_requests(spark, sf_dir), residual)


def customer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy document per customer, some of them with faults of every kind."""
    c = F.col("c_custkey")
    extra = F.when(c % 5 == 0, ',"owner":"x"').otherwise("")
    default = pick(['"default":"allow",', '"default":"deny",', '"default":"perhaps",', ""], c % 4)
    egress = F.concat(F.lit("{"), default, F.when(c % 7 == 0, '"mode":1,').otherwise(""), F.lit('"allow":["*.example.com"]}'))
    first = F.concat(F.lit('{"name":"one","endpoint":"web","condition":"http.body_size > 5","verdict":"'), pick(["deny", "pause", "block"], c % 3), F.lit('"}'))
    second = F.concat(
        F.lit('{"name":"two","endpoint":"*"'), F.when(c % 8 == 0, "").otherwise(',"condition":"pii.count >= 1"'),
        F.when(c % 9 == 0, ',"note":null').otherwise(""), F.lit(',"verdict":"pause"}'),
    )
    version = pick(['"1"', "0", "true", "3", "4", "5"], c % 6)
    whole = F.concat(F.lit('{"version":'), version, extra, F.lit(',"egress":'), egress, F.lit(',"rules":['), first, F.lit(","), second, F.lit("]}"))
    doc = F.when(c % 11 == 0, F.concat(whole, F.lit("}"))).when(c % 13 == 0, F.concat(F.lit("["), whole, F.lit("]"))).otherwise(whole)
    return table(spark, sf_dir, "customer").select(_policy("c_custkey").alias("policy"), doc.alias("doc"))


_SOUND = "c % 11 <> 0 AND c % 13 <> 0"


@query(
    f"""WITH d AS (SELECT c_custkey AS c, 'tenant-' || c_custkey AS policy FROM customer)
SELECT policy, 'not a document' AS problem FROM d WHERE NOT ({_SOUND})
UNION ALL SELECT policy, 'version must be a positive integer' FROM d WHERE {_SOUND} AND c % 6 < 3
UNION ALL SELECT policy, 'unknown key: owner' FROM d WHERE {_SOUND} AND c % 5 = 0
UNION ALL SELECT policy, 'unknown default verdict' FROM d WHERE {_SOUND} AND c % 4 = 2
UNION ALL SELECT policy, 'unknown egress key: mode' FROM d WHERE {_SOUND} AND c % 7 = 0
UNION ALL SELECT policy, 'rule 0: unknown verdict' FROM d WHERE {_SOUND} AND c % 3 = 2
UNION ALL SELECT policy, 'rule 1: missing condition' FROM d WHERE {_SOUND} AND c % 8 = 0
UNION ALL SELECT policy, 'rule 1: unknown key note' FROM d WHERE {_SOUND} AND c % 9 = 0"""
)
def policy_document_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the policy documents of a table."""
    return document_problems(customer_documents(spark, sf_dir))


@query(
    f"""SELECT 'tenant-' || c AS policy, CAST(pos AS BIGINT) AS pos, CASE pos WHEN 0 THEN 'one' ELSE 'two' END AS name, CASE pos WHEN 0 THEN 'web' ELSE '*' END AS endpoint,
  CASE WHEN pos = 0 THEN 'http.body_size > 5' WHEN c % 8 <> 0 THEN 'pii.count >= 1' END AS condition,
  CASE WHEN pos = 1 THEN 'pause' ELSE {pick_sql(["deny", "pause", "block"], 'c % 3')} END AS verdict,
  {pick_sql(["allow", "deny", "perhaps", "deny"], 'c % 4')} AS "default"
FROM (SELECT c_custkey AS c, unnest([0, 1]) AS pos FROM customer) WHERE {_SOUND}"""
)
def policy_document_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and defaults of the documents, as tables."""
    rules, _, defaults = document_tables(customer_documents(spark, sf_dir))
    return rules.join(defaults.hint("merge"), "policy").select("policy", F.col("pos").cast("bigint").alias("pos"), "name", "endpoint", "condition", "verdict", "default")
