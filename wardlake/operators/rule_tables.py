"""Policies of many tenants, as tables of rules.

A condition that is a conjunction of comparisons, or several joined by OR, becomes rows of
atoms `(fact, op, constants)`. Rules are indexed by one equality of theirs, so a request
meets only the rules of its own policy that it can match: it looks up each of its facts by
an equi join, and a rule matches when as many of its atoms hit as it has. The plan has no
expression per rule and is the same for ten policies and for ten million. Tables of policies
are never broadcast: the planner sees the size before they are exploded, which may be a
small part of theirs.

What is no such condition is kept as text. Each distinct text is compiled once
(`residual_conditions`, then `residual=`); where it holds, it is one more fact that rules are
looked up by.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.functions.expressions import as_column, ascii_lower, computed, let
from wardlake.operators.policy import bound_facts, condition_column, condition_fault, host_verdicts
from wardlake.schemas import FACT_COLUMNS

_NUMBER = "decimal(38,6)"
_ATOM = f"struct<fact:string,op:string,texts:array<string>,number:{_NUMBER}>"
_NAME = r"[a-z0-9_]+\.[a-z_]+"
_TEXT = r"'[^'\\]*'"
_ORDER = r"(?:==|=|!=|<>|<=|>=|<|>)"
_COMPARISON = (
    rf"(?:{_NAME}\s*(?:==|=|!=|<>)\s*{_TEXT}|{_NAME}\s+(?i:IN)\s*\(\s*{_TEXT}(?:\s*,\s*{_TEXT})*\s*\)"
    rf"|{_NAME}\s*{_ORDER}\s*-?[0-9]{{1,18}}(?:\.[0-9]{{1,6}})?(?![0-9A-Za-z_.]))"
)
_CONJUNCTION = rf"{_COMPARISON}(?:\s*(?:&&|\b(?i:AND)\b)\s*{_COMPARISON})*"
_WHOLE = rf"^\s*{_CONJUNCTION}(?:\s*(?:\|\||\b(?i:OR)\b)\s*{_CONJUNCTION})*\s*$"
# Facts that rules are looked up by besides their own: none needed, and a compiled text.
_ANY, _HOLDS = "*", "?"


def _fields(kind: str) -> list[str]:
    """Names of the scalar facts of a kind, as conditions spell them."""
    names = []
    for column, ddl in FACT_COLUMNS.items():
        if ddl.startswith("struct<"):
            parts = [p.split(":") for p in ddl[len("struct<") : -1].split(",")]
            names += [f"{column}.{p[0]}" for p in parts if p[1] == kind]
    return names


TEXT_FACTS, NUMBER_FACTS = _fields("string"), _fields("bigint")


def _atom(comparison: Column) -> Column:
    texts = F.transform(F.regexp_extract_all(comparison, F.lit(_TEXT), F.lit(0)), lambda t: F.substring(t, F.lit(2), F.length(t) - 2))
    op = F.lower(F.regexp_extract(comparison, rf"^{_NAME}\s*({_ORDER}|(?i:IN)\b)", 1))
    number = F.regexp_extract(comparison, r"(-?[0-9]+(?:\.[0-9]+)?)\s*$", 1).try_cast(_NUMBER)
    return F.struct(
        F.regexp_extract(comparison, rf"^({_NAME})", 1).alias("fact"),
        F.when(op.isin("==", "in"), "=").when(op == "<>", "!=").otherwise(op).alias("op"),
        texts.alias("texts"), F.when(F.size(texts) == 0, number).alias("number"),
    ).cast(_ATOM)


def condition_atoms(condition: Column | str) -> Column:
    """array<array<atom>>: what a condition asks for, any of the outer ones; NULL if it has no such form.

    Facts have to exist and to be of the constant's kind.
    """
    condition = as_column(condition)
    parts = F.transform(
        F.regexp_extract_all(condition, F.lit(_CONJUNCTION), F.lit(0)),
        lambda part: F.transform(F.regexp_extract_all(part, F.lit(_COMPARISON), F.lit(0)), _atom),
    )

    def known(atom: Column) -> Column:
        return F.when(F.size(atom["texts"]) > 0, atom["fact"].isin(TEXT_FACTS)).otherwise(atom["fact"].isin(NUMBER_FACTS))

    return F.when(condition.rlike(_WHOLE), let(parts, lambda p: F.when(F.forall(p, lambda part: F.forall(part, known)), p)))


def _no_atoms() -> Column:
    return F.array().cast(f"array<{_ATOM}>")


def rule_index(rules: DataFrame) -> DataFrame:
    """(policy, fact, value, pos, name, verdict, atoms): a row per way to look a rule up.

    `rules` has (policy, pos, name, endpoint, condition, verdict). The key is an equality of
    the condition, else the endpoint, else none. `residual` holds the text of a condition
    that has to be compiled.
    """
    listed = computed(rules, "parts", condition_atoms("condition"))
    part = F.explode(F.coalesce(F.col("parts"), F.array(F.lit(None).cast(f"array<{_ATOM}>"))))
    listed = listed.where(F.length(F.trim(F.coalesce("condition", F.lit("")))) > 0).select("*", part.alias("part"))
    endpoint = F.struct(
        F.lit("endpoint").alias("fact"), F.lit("=").alias("op"), F.array("endpoint").alias("texts"), F.lit(None).cast(_NUMBER).alias("number")
    ).cast(_ATOM)
    own = F.when(F.col("endpoint") == "*", _no_atoms()).otherwise(F.array(endpoint))
    atoms = F.concat(F.coalesce("part", _no_atoms()), own)
    equal = F.filter("atoms", lambda a: (a["op"] == "=") & (F.size(a["texts"]) > 0))
    listed = listed.withColumn("residual", F.when(F.col("part").isNull(), F.col("condition"))).withColumn("atoms", atoms)
    key = F.get(equal, F.lit(0))
    fact = F.when(F.col("residual").isNotNull(), F.lit(_HOLDS)).otherwise(F.coalesce(key["fact"], F.lit(_ANY)))
    values = F.when(F.col("residual").isNotNull(), F.array("residual")).otherwise(F.coalesce(F.array_distinct(key["texts"]), F.array(F.lit(_ANY))))
    return listed.select("policy", "pos", "name", "verdict", "atoms", "residual", fact.alias("fact"), F.explode(values).alias("value"))


def residual_conditions(rules: DataFrame) -> DataFrame:
    """The distinct conditions that have to be compiled; each text is parsed once."""
    texts = rules.where(F.length(F.trim("condition")) > 0).select("condition").distinct()
    return computed(texts, "parts", condition_atoms("condition")).where("parts is null").select("condition")


def rule_faults(rules: DataFrame, requests: DataFrame, residual: Sequence[str]) -> DataFrame:
    """(policy, pos, name, fault) of the rules that never match: `empty`, `invalid` or `not boolean`."""
    facts = bound_facts(requests)
    faults = {text: fault for text in residual if (fault := condition_fault(text, facts))}
    known = F.create_map(*(F.lit(x) for pair in faults.items() for x in pair)) if faults else F.create_map().cast("map<string,string>")
    empty = F.length(F.trim(F.coalesce("condition", F.lit("")))) == 0
    fault = F.when(empty, "empty").otherwise(F.try_element_at(known, F.col("condition")))
    return rules.select("policy", "pos", "name", fault.alias("fault")).where("fault is not null")


def _facts(names: list[str], kind: str) -> Column:
    """Map of the facts that a request has."""
    entries = F.array(*(F.struct(F.lit(n).alias("key"), F.col(n).cast(kind).alias("value")) for n in names))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def _hit(atom: Column, texts: Column, numbers: Column) -> Column:
    text, number, op = F.try_element_at(texts, atom["fact"]), F.try_element_at(numbers, atom["fact"]), atom["op"]
    inside = F.array_contains(atom["texts"], text)
    of_text = F.when(op == "=", inside).when(op == "!=", ~inside)
    of_number = (
        F.when(op == "=", number == atom["number"]).when(op == "!=", number != atom["number"]).when(op == "<", number < atom["number"])
        .when(op == "<=", number <= atom["number"]).when(op == ">", number > atom["number"]).when(op == ">=", number >= atom["number"])
    )
    return F.coalesce(F.when(F.size(atom["texts"]) > 0, of_text).otherwise(of_number), F.lit(False))


def first_matches(requests: DataFrame, request_id: str, rules: DataFrame, residual: Sequence[str] = ()) -> DataFrame:
    """(request_id, policy, pos, verdict, rule): the first rule of a request's policy that matches it.

    `requests` has fact columns and `policy`; `request_id` is unique. Requests without a
    match have no row. A rule whose condition is neither of the form above nor in
    `residual` fails the job.
    """
    facts = bound_facts(requests)
    holds = F.array(*(F.when(condition_column(text, facts), F.lit(text)) for text in residual)) if residual else F.array().cast("array<string>")
    texts = F.map_concat(_facts(TEXT_FACTS, "string"), _facts(["endpoint"], "string"))
    asked = facts.select(F.col(request_id), "policy", texts.alias("texts"), _facts(NUMBER_FACTS, _NUMBER).alias("numbers"), F.array_compact(holds).alias("holds"))
    entry = "array<struct<key:string,value:string>>"
    keys = F.concat(
        F.map_entries("texts").cast(entry),
        F.transform("holds", lambda text: F.struct(F.lit(_HOLDS).alias("key"), text.alias("value"))).cast(entry),
        F.array(F.struct(F.lit(_ANY).alias("key"), F.lit(_ANY).alias("value"))).cast(entry),
    )
    looked = asked.select(request_id, "policy", "texts", "numbers", F.explode(keys).alias("k")).select(
        request_id, "policy", "texts", "numbers", F.col("k.key").alias("fact"), F.col("k.value").alias("value")
    )
    compiled = F.col("residual").isNull() | F.col("residual").isin(list(residual)) if residual else F.col("residual").isNull()
    index = rule_index(rules).withColumn("value", F.when(F.assert_true(compiled, F.lit("a condition has not been compiled")).isNull(), F.col("value")))
    met = looked.join(index.hint("merge"), ["policy", "fact", "value"])
    hits = F.size(F.filter("atoms", lambda a: _hit(a, F.col("texts"), F.col("numbers"))))
    first = F.min(F.struct("pos", "verdict", F.col("name").alias("rule"))).alias("first")
    return met.where(hits == F.size("atoms")).groupBy(request_id, "policy").agg(first).select(request_id, "policy", "first.*")


def decide_by_tables(
    requests: DataFrame, request_id: str, rules: DataFrame, egress: DataFrame, defaults: DataFrame, residual: Sequence[str] = ()
) -> DataFrame:
    """requests with (verdict, rule) by the rules of their policy, then its domain lists, then its default.

    `egress` has (policy, kind, pattern), `defaults` has (policy, default), each policy once.
    A request of no known policy is denied.
    """
    matched = first_matches(requests, request_id, rules, residual).select(
        F.col(request_id).alias("_id"), F.col("verdict").alias("_verdict"), F.col("rule").alias("_rule")
    )
    hosts = requests.select("policy", ascii_lower(F.col("domain")).alias("host"))
    listed = host_verdicts(hosts, egress, None, by=["policy"]).where("verdict is not null").select(
        F.col("policy").alias("_policy"), F.col("host").alias("_host"), F.col("verdict").alias("_listed")
    )
    defaults = defaults.select(F.col("policy").alias("_own"), F.col("default").alias("_default"))
    same_host = (F.col("policy") == F.col("_policy")) & (ascii_lower(F.col("domain")) == F.col("_host"))
    joined = (
        requests.join(matched.hint("merge"), F.col(request_id) == F.col("_id"), "left").join(listed.hint("merge"), same_host, "left")
        .join(defaults.hint("merge"), F.col("policy") == F.col("_own"), "left")
    )
    verdict = F.coalesce("_verdict", "_listed", "_default", F.lit("deny"))
    return joined.select(*(requests[c] for c in requests.columns), verdict.alias("verdict"), F.col("_rule").alias("rule"))
