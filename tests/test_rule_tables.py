"""Rules as tables against the same rules compiled into the plan."""

from __future__ import annotations

import random
import re

import pytest
from conftest import texts
from pyspark.sql import functions as F

from wardlake.operators.policy import Policy, Rule, decide
from wardlake.operators.rule_tables import condition_atoms, decide_by_tables, first_matches, residual_conditions, rule_faults
from wardlake.schemas import FACTS_TYPE

RULES = "policy string, pos int, name string, endpoint string, condition string, verdict string"
FORM = [
    "http.method == 'POST'", "http.method='POST' && http.body_size > 10485760", "sql.verb == 'DROP' || sql.verb == 'TRUNCATE'",
    "sql.verb IN ('DROP', 'a && b') and k8s.verb <> 'get' AND pii.count >= 2.5 or http.body_size=-3", "  k8s.namespace != ''  ",
]
OTHER = [
    "", "NOT (sql.verb = 'DROP')", "http.method = 5", "http.body_size = '5'", "http.method == 'PO''ST'", "no_such.field = 1", "http.body_size > 5e3",
    "http.body_size > 1 +1", "(http.method = 'GET')", "array_contains(pii.types, 'EMAIL')", "http.body_size", "sql.table LIKE '%a'", "http.method = \"GET\"",
]


def test_forms(spark):
    got = [r.a for r in texts(spark, FORM + OTHER).select("i", condition_atoms("t").alias("a")).orderBy("i").collect()]
    assert [a is not None for a in got] == [True] * len(FORM) + [False] * len(OTHER)
    assert [[(a.fact, a.op, a.texts, a.number and float(a.number)) for a in part] for part in got[3]] == [
        [("sql.verb", "=", ["DROP", "a && b"], None), ("k8s.verb", "!=", ["get"], None), ("pii.count", ">=", [], 2.5)],
        [("http.body_size", "=", [], -3.0)],
    ]
    assert [len(a) for a in got[:3]] == [1, 1, 2]


def generated(rng):
    """Policies of random rules, and requests of random facts."""
    def comparison():
        return rng.choice([
            f"http.method == '{rng.choice(['GET', 'POST'])}'", f"http.body_size {rng.choice(['<', '<=', '>', '>=', '=', '!='])} {rng.randrange(5)}",
            f"sql.verb IN ('{rng.choice(['DROP', 'SELECT'])}', 'DELETE')", f"k8s.verb != '{rng.choice(['get', 'list'])}'", f"pii.count < {rng.randrange(3)}",
            "length(http.path) > 3", "no_such = 1", "NOT (sql.verb = 'DROP')",
        ])

    policies = {}
    for p in range(12):
        rules = [
            Rule(f"r{i}", rng.choice(["*", "*", "web", "pg"]), rng.choice([" && ", " OR "]).join(comparison() for _ in range(rng.randrange(1, 4))), rng.choice(["allow", "deny", "pause"]))
            for i in range(rng.randrange(8))
        ]
        policies[f"p{p}"] = Policy(
            default=rng.choice(["allow", "deny", "pause"]), allow=rng.sample(["a.com", "*.b.org", "X.net"], rng.randrange(3)),
            deny=rng.sample(["*.bad.b.org", "x.net", "*.a.com"], rng.randrange(3)), rules=rules,
        )
    requests = []
    for i in range(300):
        f = {"domain": rng.choice([None, "a.com", "q.a.com", "b.org", "z.bad.b.org", "X.NET"]), "endpoint": rng.choice([None, "web", "pg"])}
        if rng.randrange(2):
            f["http"] = {"method": rng.choice(["GET", "POST", None]), "host": "h", "path": "/" * rng.randrange(6), "body_size": rng.choice([None, 0, 2, 4])}
        if rng.randrange(2):
            f["sql"] = {"verb": rng.choice(["DROP", "SELECT", "DELETE"]), "table": "t"}
        if rng.randrange(2):
            f["k8s"] = {"verb": rng.choice(["get", "list", None]), "resource": "pods", "namespace": ""}
        if rng.randrange(3) == 0:
            f["pii"] = {"types": ["EMAIL"], "count": rng.randrange(3), "max_severity": 1}
        requests.append((i, rng.choice([*policies, "none", None]) if i % 3 else "p0", f))
    return policies, requests


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_compiled(spark, seed):
    policies, rows = generated(random.Random(seed))
    requests = spark.createDataFrame(rows, f"i int, policy string, f {FACTS_TYPE}").select("i", "policy", "f.*")
    rules = spark.createDataFrame([(p, n, r.name, r.endpoint, r.condition, r.verdict) for p, policy in policies.items() for n, r in enumerate(policy.rules)], RULES)
    egress = spark.createDataFrame(
        [(p, kind, x) for p, policy in policies.items() for kind in ("allow", "deny") for x in getattr(policy, kind)], "policy string, kind string, pattern string"
    )
    defaults = spark.createDataFrame([(p, policy.default) for p, policy in policies.items()], "policy string, default string")
    residual = [r.condition for r in residual_conditions(rules).collect()]
    assert residual
    out = decide_by_tables(requests, "i", rules, egress, defaults, residual)
    assert out.columns == [*requests.columns, "verdict", "rule"]
    got = {r.i: (r.verdict, r.rule) for r in out.collect()}
    want = {}
    for name, policy in policies.items():
        for r in decide(requests.where(requests.policy == name), policy).collect():
            want[r.i] = (r.outcome.verdict, r.outcome.rule)
    assert got == {i: want.get(i, ("deny", None)) for i in range(len(rows))}


def test_faults_and_missing_residuals(spark):
    rules = spark.createDataFrame([("p", i, f"r{i}", "*", c, "deny") for i, c in enumerate([*OTHER, None, "http.body_size > 1"])], RULES)
    requests = spark.createDataFrame([(1, "p", {"domain": "a"})], f"i int, policy string, f {FACTS_TYPE}").select("i", "policy", "f.*")
    residual = [r.condition for r in residual_conditions(rules).collect()]
    got = {r.pos: r.fault for r in rule_faults(rules, requests, residual).collect()}
    assert got == {0: "empty", 5: "invalid", 10: "not boolean", len(OTHER): "empty"}
    with pytest.raises(Exception, match="not been compiled"):
        first_matches(requests, "i", rules).collect()


def test_plan_does_not_grow_with_rules(spark, tmp_path):
    requests = spark.createDataFrame([(1, "p", {"domain": "a"})], f"i int, policy string, f {FACTS_TYPE}").select("i", "policy", "f.*")
    plans = []
    for count in (10, 3_000):
        rows = [(f"p{i % 900}", i, f"r{i}", "*", f"http.method = 'M{i}' AND http.body_size > {i}", "deny") for i in range(count)]
        spark.createDataFrame(rows, RULES).write.parquet(f"{tmp_path}/{count}")
        plan = first_matches(requests, "i", spark.read.parquet(f"{tmp_path}/{count}"))._jdf.queryExecution().optimizedPlan().toString()
        plans.append(re.sub(r"[#_]\d+L?", "", plan))
    assert plans[0] == plans[1]


def test_tables_of_policies_are_not_broadcast(spark):
    """Their size is unknown before they are exploded, so no join may send them through the driver."""
    rows = spark.range(50)
    policy = F.concat(F.lit("p"), F.col("id").cast("string")).alias("policy")
    rule = F.struct(F.lit(0).alias("pos"), F.lit("r").alias("name"), F.lit("*").alias("endpoint"), F.lit("http.method = 'GET'").alias("condition"), F.lit("deny").alias("verdict"))
    rules = rows.select(policy, F.explode(F.array(rule)).alias("r")).select("policy", "r.*")
    egress = rows.select(policy, F.lit("allow").alias("kind"), F.lit("*.a.com").alias("pattern"))
    defaults = rows.select(policy, F.lit("pause").alias("default"))
    http = F.struct(F.when(F.col("id") < 20, "GET").alias("method"), F.lit("q.a.com").alias("host"), F.lit("/").alias("path"), F.lit(1).cast("bigint").alias("body_size"))
    requests = rows.select("id", policy, F.lit("q.a.com").alias("domain"), http.alias("http"))
    decided = decide_by_tables(requests, "id", rules, egress, defaults)
    assert "BroadcastExchange" not in decided._jdf.queryExecution().executedPlan().toString()
    assert {r.id: (r.verdict, r.rule) for r in decided.collect()} == {i: ("deny", "r") if i < 20 else ("allow", None) for i in range(50)}
