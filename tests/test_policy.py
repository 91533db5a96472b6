"""Policy decisions and enforcement."""

from __future__ import annotations

import pytest
from conftest import results
from pyspark.sql import functions as F

from wardlake.operators.corpus import egress_violations, policy_document_problems, policy_violations
from wardlake.operators.enforcement import enforce, host_gate, inspected, intercepted
from wardlake.operators.policy import Policy, Rule, decide, decide_all, host_verdicts, policy_tables, sql_condition, verdict_counts
from wardlake.schemas import FACTS_TYPE, REQUEST_SCHEMA

YAML = """
version: 1
egress:
  default: deny
  allow: [github.com, '*.gh.io']
  deny: [bad.gh.io]
rules:
  - {name: no-drop, endpoint: pg, condition: "sql.verb == 'DROP' || sql.verb == 'TRUNCATE'", verdict: pause}
  - {name: big, endpoint: '*', condition: "http.method == 'POST' && http.body_size > 100", verdict: deny}
"""


def facts(spark, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, f {FACTS_TYPE}")
    return df.select("i", "f.*")


def verdicts(spark, policy, rows):
    df = decide(facts(spark, rows), policy)
    return [(o.verdict, o.rule) for o in results(df, "outcome")]


def test_defaults_fail_closed(spark):
    policy = Policy.from_text("{}")
    assert (policy.version, policy.default, tuple(policy.rules)) == (0, "deny", ())
    assert verdicts(spark, policy, [{"domain": "a"}, {}]) == [("deny", None)] * 2
    with pytest.raises(ValueError):
        Policy.from_text("egress: {default: perhaps}")


def test_egress_lists(spark):
    policy = Policy.from_text(YAML)
    rows = [{"domain": d} for d in ("github.com", "x.gh.io", "gh.io", "bad.gh.io", "evil.com", "GitHub.com")] + [{}]
    assert [v for v, _ in verdicts(spark, policy, rows)] == ["allow", "allow", "allow", "deny", "deny", "allow", "deny"]


def test_rules_come_first_in_order(spark):
    policy = Policy.from_text(YAML)
    drop = {"sql": {"verb": "DROP", "table": "users"}}
    rows = [
        {**drop, "endpoint": "pg"}, {**drop, "endpoint": "other"}, drop,
        {"http": {"method": "POST", "host": "h", "path": "/", "body_size": 101}, "domain": "github.com"},
        {"http": {"method": "POST", "host": "h", "path": "/", "body_size": 100}, "domain": "github.com"},
    ]
    assert verdicts(spark, policy, rows) == [("pause", "no-drop"), ("deny", None), ("deny", None), ("deny", "big"), ("allow", None)]


def test_pii_is_always_bound_and_errors_do_not_match(spark):
    policy = Policy(default="deny", rules=[
        Rule("syntax", "*", "this is not sql", "pause"), Rule("unknown", "*", "nothing.here = 1", "pause"), Rule("empty", "*", "", "pause"),
        Rule("number", "*", "pii.count", "pause"), Rule("clean", "*", "pii.count == 0", "allow"), Rule("high", "*", "pii.count > 0 && pii.max_severity >= 3", "deny"),
    ])
    rows = [{}, {"pii": {"types": ["RRN"], "count": 1, "max_severity": 3}}, {"pii": {"types": ["IP"], "count": 1, "max_severity": 1}}]
    assert verdicts(spark, policy, rows) == [("allow", "clean"), ("deny", "high"), ("deny", None)]
    # The audit snapshot keeps the absence of findings.
    assert decide(facts(spark, [{}]), policy).first().pii is None


def test_condition_spelling():
    assert sql_condition("a == '&&' && !b || c != 'x'") == "a == '&&'  AND   NOT b  OR  c != 'x'"


def test_many_policies_match_single_ones(spark):
    policies = {"a": Policy.from_text(YAML), "b": Policy(default="allow")}
    rows = [{"domain": "github.com"}, {"endpoint": "pg", "sql": {"verb": "DROP", "table": "t"}}, {"domain": "evil.com"}]
    got = {(r.i, r.policy): (r.verdict, r.rule) for r in decide_all(facts(spark, rows), policies).collect()}
    for name, policy in policies.items():
        assert [got[(i, name)] for i in range(len(rows))] == verdicts(spark, policy, rows)


def test_suffix_join_equals_predicate(spark):
    policy = Policy(default="pause", allow=["*.a.com", "b.com", "*.B.org"], deny=["x.a.com", "*.y.a.com", "b.com"])
    hosts = ["a.com", "x.a.com", "z.x.a.com", "y.a.com", "q.y.a.com", "b.com", "c.b.com", "r.b.org", "com", ""]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hosts * 3)], "i int, host string")
    _, egress = policy_tables(spark, policy)
    got = {r.host: r.verdict for r in host_verdicts(df, egress, policy.default).collect()}
    want = dict(zip(hosts, [v for v, _ in verdicts(spark, policy, [{"domain": h} for h in hosts])]))
    assert got == want
    counts = {r.verdict: r.n for r in verdict_counts(df, host_verdicts(df, egress, policy.default), policy.default).collect()}
    assert sum(counts.values()) == len(hosts) * 3


def requests(spark, rows):
    base = {"ts": None, "client": "c", "is_connect": False, "method": "POST", "uri": "/u?q", "headers": {"host": "Api.Test:1"}, "endpoint": None, "content_length": None, "body": bytearray(b"")}
    return spark.createDataFrame([{**base, **r} for r in rows], REQUEST_SCHEMA).withColumn("i", F.monotonically_increasing_id())


def test_enforcement_modes(spark):
    policy = Policy(default="allow", rules=[Rule("high", "*", "pii.max_severity >= 3", "deny"), Rule("big", "*", "http.body_size > 100", "pause")])
    rows = [{"body": bytearray(b"670125-1230644")}, {"body": bytearray(b"a@b.co")}, {"body": bytearray(b"clean")}, {"body": bytearray(b"\xff" * 200)}]
    scanned = inspected(requests(spark, rows))
    detect = [(r.decision, r.outcome.verdict, r.audited) for r in enforce(scanned, policy, "detect").orderBy("i").collect()]
    assert detect == [("allowed", "deny", True), ("allowed", "allow", True), ("allowed", "allow", False), ("allowed", "pause", False)]
    block = enforce(scanned, policy, "block").orderBy("i").collect()
    assert [(r.decision, r.audited) for r in block] == [("denied", True), ("allowed", True), ("allowed", False), ("paused", True)]
    assert block[3].summary == "POST api.test/u: PII [none] (0 finding(s), rule: big)"
    with pytest.raises(ValueError):
        enforce(scanned, policy, "observe")


def test_host_gate_and_interception(spark):
    policy = Policy(allow=["ok.test"], rules=[Rule("ask", "*", "http.host = 'ask.test'", "pause")])
    rows = [{"uri": u, "is_connect": c} for u, c in [("ok.test:443", True), ("ok.test:443", False), ("no.test:443", False), ("Ask.test:443", True)]]
    from wardlake.functions.hosts import canonical_host

    gated = host_gate(requests(spark, rows), policy, canonical_host("uri")).orderBy("i").collect()
    assert [(r.decision, r.audited) for r in gated] == [("allowed", True), ("allowed", False), ("denied", True), ("paused", True)]
    assert gated[3].summary == "CONNECT ask.test (rule: ask)"
    df = requests(spark, rows)
    assert [intercepted(df, x).count() for x in ("none", "all", ["ask.test"])] == [0, 4, 1]
    assert intercepted(df, spark.createDataFrame([("ok.test",)], "host string")).count() == 2


def test_contracts(spark):
    rules = spark.createDataFrame([(0, "a", "*", "true", "allow"), (1, None, "*", "true", "maybe")], "pos int, name string, endpoint string, condition string, verdict string")
    assert {(r.pos, r.reason) for r in policy_violations(rules).collect()} == {(1, "missing_name"), (1, "verdict")}
    lists = spark.createDataFrame([("allow", "a"), ("block", None)], "kind string, pattern string")
    assert {r.reason for r in egress_violations(lists).collect()} == {"kind", "missing_pattern"}
    assert policy_document_problems({"version": 1, "egress": {"default": "deny"}, "rules": []}) == []
    assert len(policy_document_problems({"version": 0, "extra": 1, "rules": [{"name": "x", "odd": 1}]})) == 7
