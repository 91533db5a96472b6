"""Policy documents as VARIANT against the check of one document, and as tables."""

from __future__ import annotations

import json

from wardlake.operators.corpus import policy_document_problems
from wardlake.operators.policy import Policy
from wardlake.operators.policy_documents import document_problems, document_tables

RULE = {"name": "a", "endpoint": "*", "condition": "http.method = 'GET'", "verdict": "deny"}
DOCS = [
    {}, {"version": 1, "egress": {"default": "allow", "allow": ["a.com", "*.b"], "deny": ["c"]}, "rules": [RULE, {**RULE, "name": "é \"q\"", "verdict": "pause"}]},
    {"version": 0}, {"version": "1"}, {"version": True}, {"version": 1.5}, {"version": None}, {"version": 7, "owner": "x", "Egress": 1},
    {"egress": {"default": "perhaps", "mode": 1}}, {"egress": {"default": None}}, {"egress": None, "rules": None}, {"egress": {}, "rules": []},
    {"rules": [{}, {"name": "n", "note": 1}, {**RULE, "verdict": 5}, {**RULE, "verdict": "block", "x": None}]},
]


def frame(spark, docs):
    return spark.createDataFrame([(f"p{i}", d) for i, d in enumerate(docs)], "policy string, doc string")


def test_same_as_one_by_one(spark):
    got = sorted(map(tuple, document_problems(frame(spark, [json.dumps(d) for d in DOCS])).collect()))
    assert got == sorted((f"p{i}", p) for i, d in enumerate(DOCS) for p in policy_document_problems(d))


def test_no_documents_at_all(spark):
    texts = [None, "", "oops{", "[1]", "5", "null", '"x"', '{"version":1,"version":2}', "{}}", "{} {}", "{},{}"]
    assert sorted(map(tuple, document_problems(frame(spark, texts)).collect())) == sorted((f"p{i}", "not a document") for i in range(len(texts)))


def test_tables(spark):
    rules, lists, defaults = document_tables(frame(spark, [json.dumps(d) for d in DOCS[:2]] + ["oops"]))
    policy = Policy.from_mapping(DOCS[1])
    assert [tuple(r) for r in rules.orderBy("pos").collect()] == [("p1", i, r.name, r.endpoint, r.condition, r.verdict) for i, r in enumerate(policy.rules)]
    assert sorted(map(tuple, lists.collect())) == sorted([("p1", "allow", p) for p in policy.allow] + [("p1", "deny", p) for p in policy.deny])
    assert sorted(map(tuple, defaults.collect())) == [("p0", "deny"), ("p1", "allow"), ("p2", "deny")]
