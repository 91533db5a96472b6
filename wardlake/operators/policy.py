"""Policies: ordered rules over protocol facts, then egress domain lists.

Conditions become part of the query plan, so they are compiled once for a job.
A rule's condition is a Spark SQL boolean over `http`, `sql`, `k8s` and `pii`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.constants import VERDICTS
from wardlake.functions.expressions import ascii_lower, empty_array
from wardlake.functions.hosts import domain_suffixes, in_domain_list
from wardlake.schemas import EGRESS_SCHEMA, FACT_COLUMNS, PII_TYPE, RULE_SCHEMA


@dataclass(frozen=True)
class Rule:
    name: str
    endpoint: str
    condition: str
    verdict: str


@dataclass(frozen=True)
class Policy:
    """Absent parts take the fail-closed defaults: no rules, no lists, deny."""

    version: int = 0
    default: str = "deny"
    allow: Sequence[str] = field(default_factory=tuple)
    deny: Sequence[str] = field(default_factory=tuple)
    rules: Sequence[Rule] = field(default_factory=tuple)

    @classmethod
    def from_mapping(cls, doc: Mapping) -> Policy:
        egress = doc.get("egress") or {}
        rules = tuple(
            Rule(r["name"], r["endpoint"], r["condition"], r["verdict"]) for r in doc.get("rules") or ()
        )
        policy = cls(
            version=doc.get("version", 0),
            default=egress.get("default", "deny"),
            allow=tuple(egress.get("allow") or ()),
            deny=tuple(egress.get("deny") or ()),
            rules=rules,
        )
        for verdict in [policy.default, *(r.verdict for r in rules)]:
            if verdict not in VERDICTS:
                raise ValueError(f"unknown verdict: {verdict!r}")
        return policy

    @classmethod
    def from_text(cls, text: str) -> Policy:
        """From YAML or JSON text."""
        try:
            import yaml
        except ImportError:
            return cls.from_mapping(json.loads(text))
        return cls.from_mapping(yaml.safe_load(text) or {})


_C_OPERATORS = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|&&|\|\||!(?!=)""")


def sql_condition(condition: str) -> str:
    """Spell `&&`, `||` and `!` the SQL way, outside of string literals."""
    words = {"&&": " AND ", "||": " OR ", "!": " NOT "}
    return _C_OPERATORS.sub(lambda m: words.get(m.group(), m.group()), condition)


def policy_tables(spark: SparkSession, policy: Policy) -> tuple[DataFrame, DataFrame]:
    """The policy as `rules` and `egress` tables."""
    rules = [(i, r.name, r.endpoint, r.condition, r.verdict) for i, r in enumerate(policy.rules)]
    egress = [("allow", p) for p in policy.allow] + [("deny", p) for p in policy.deny]
    return spark.createDataFrame(rules, RULE_SCHEMA), spark.createDataFrame(egress, EGRESS_SCHEMA)


def with_fact_columns(requests: DataFrame) -> DataFrame:
    """Add the fact columns a table lacks, as NULL."""
    missing = {c: F.lit(None).cast(t) for c, t in FACT_COLUMNS.items() if c not in requests.columns}
    return requests.withColumns(missing) if missing else requests


def _empty_pii() -> Column:
    return F.struct(
        empty_array("string").alias("types"),
        F.lit(0).cast("bigint").alias("count"),
        F.lit(0).cast("bigint").alias("max_severity"),
    ).cast(PII_TYPE)


def condition_fault(condition: str, facts: DataFrame) -> str | None:
    """Why a condition can never match: `empty`, `invalid` or `not boolean`; NULL if it can."""
    if not condition.strip():
        return "empty"
    try:
        kind = facts.select(F.expr(sql_condition(condition)).alias("c")).schema["c"].dataType.simpleString()
    except (AnalysisException, ParseException):
        return "invalid"
    return None if kind == "boolean" else "not boolean"


def condition_column(condition: str, facts: DataFrame) -> Column:
    """A condition that never errors into a match: NULL and invalid ones are false."""
    if condition_fault(condition, facts):
        return F.lit(False)
    return F.coalesce(F.expr(sql_condition(condition)), F.lit(False))


def unusable_rules(policy: Policy, requests: DataFrame) -> list[tuple[int, str, str]]:
    """(position, name, fault) of the rules that never match, so that none goes unnoticed."""
    facts = bound_facts(requests)
    faults = [(i, r.name, condition_fault(r.condition, facts)) for i, r in enumerate(policy.rules)]
    return [f for f in faults if f[2]]


def endpoint_matches(pattern: str, endpoint: Column) -> Column:
    """`*` matches every request, also one without an endpoint."""
    return F.lit(True) if pattern == "*" else endpoint.eqNullSafe(F.lit(pattern))


def egress_verdict(policy: Policy, domain: Column) -> Column:
    """Deny list, then allow list, then the default."""
    return (
        F.when(in_domain_list(domain, policy.deny), "deny")
        .when(in_domain_list(domain, policy.allow), "allow")
        .otherwise(policy.default)
    )


def _hits(policy: Policy, facts: DataFrame) -> list[tuple[Column, Rule]]:
    return [
        (endpoint_matches(r.endpoint, F.col("endpoint")) & condition_column(r.condition, facts), r)
        for r in policy.rules
    ]


def _outcome(policy: Policy, facts: DataFrame) -> Column:
    """`struct<verdict, rule>` of the first matching rule, else of the egress lists."""

    def decided(verdict: Column, rule: Column) -> Column:
        return F.struct(verdict.alias("verdict"), rule.alias("rule"))

    egress = decided(egress_verdict(policy, F.col("domain")), F.lit(None).cast("string"))
    chain = None
    for hit, rule in _hits(policy, facts):
        outcome = decided(F.lit(rule.verdict), F.lit(rule.name))
        chain = F.when(hit, outcome) if chain is None else chain.when(hit, outcome)
    return egress if chain is None else chain.otherwise(egress)


def bound_facts(requests: DataFrame) -> DataFrame:
    """Facts as conditions see them: `pii` is always there, empty when nothing was found."""
    facts = with_fact_columns(requests)
    return facts.withColumns({"_found_pii": F.col("pii"), "pii": F.coalesce(F.col("pii"), _empty_pii())})


def _unbound(facts: DataFrame) -> DataFrame:
    return facts.withColumn("pii", F.col("_found_pii")).drop("_found_pii")


def decide(requests: DataFrame, policy: Policy) -> DataFrame:
    """Add `outcome` (`struct<verdict, rule>`) to a table of request facts.

    A narrow projection: one CASE chain per policy, no shuffle.
    """
    facts = bound_facts(requests)
    return _unbound(facts.withColumn("outcome", _outcome(policy, facts)))


def decide_all(requests: DataFrame, policies: Mapping[str, Policy]) -> DataFrame:
    """One row per request and policy, with the first matching rule by position."""
    facts = bound_facts(requests)
    per_policy = []
    for name, policy in policies.items():
        hits = F.array(
            *[
                F.when(hit, F.struct(F.lit(pos).alias("pos"), F.lit(r.verdict).alias("verdict"), F.lit(r.name).alias("rule")))
                for pos, (hit, r) in enumerate(_hits(policy, facts))
            ]
        ) if policy.rules else empty_array("struct<pos:int,verdict:string,rule:string>")
        # array_min skips the NULLs of rules that did not match.
        first = F.array_min(hits)
        per_policy.append(
            F.struct(
                F.lit(name).alias("policy"),
                F.coalesce(first["verdict"], egress_verdict(policy, F.col("domain"))).alias("verdict"),
                first["rule"].alias("rule"),
            )
        )
    facts = facts.withColumn("_decided", F.explode(F.array(*per_policy)))
    return _unbound(facts).select("*", "_decided.*").drop("_decided")


def pattern_table(egress: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Egress patterns as lookup keys: `(by..., suffix, wildcard, deny, allow)`, one row per key."""
    pattern = ascii_lower(F.col("pattern"))
    wildcard = pattern.startswith("*.")
    return (
        egress.select(
            *by,
            F.when(wildcard, F.substring(pattern, 3, 2147483647)).otherwise(pattern).alias("suffix"),
            wildcard.alias("wildcard"),
            (F.col("kind") == "deny").alias("deny"),
            (F.col("kind") == "allow").alias("allow"),
        )
        .groupBy(*by, "suffix", "wildcard")
        .agg(F.max("deny").alias("deny"), F.max("allow").alias("allow"))
    )


def host_verdicts(hosts: DataFrame, egress: DataFrame, default: str | None = "deny", by: Sequence[str] = ()) -> DataFrame:
    """Verdict of every distinct `host` against a large pattern table, within each `by`.

    The suffix rule is an equi join: a host is looked up by each of its suffixes,
    the whole host in exact and wildcard form. Work is per distinct host, so a host
    that holds a large share of the traffic costs one row here. Patterns are not
    broadcast, since the planner cannot tell the size of a table made by exploding.
    """
    patterns = pattern_table(egress, by)
    keys = hosts.select(*by, "host").where(F.col("host").isNotNull()).distinct().select(
        *by, "host", F.posexplode(domain_suffixes("host")).alias("depth", "suffix")
    )
    hits = (
        keys.join(patterns.hint("merge"), [*by, "suffix"], "left")
        .groupBy(*by, "host")
        .agg(
            F.max(F.col("deny") & (F.col("wildcard") | (F.col("depth") == 0))).alias("denied"),
            F.max(F.col("allow") & (F.col("wildcard") | (F.col("depth") == 0))).alias("allowed"),
        )
    )
    verdict = F.when(F.col("denied"), "deny").when(F.col("allowed"), "allow").otherwise(default)
    return hits.select(*by, "host", verdict.alias("verdict"))


def verdict_counts(requests: DataFrame, verdicts: DataFrame, default: str = "deny") -> DataFrame:
    """Requests per host verdict, counted per host before the join."""
    per_host = requests.groupBy("host").agg(F.count("*").alias("n"))
    return (
        per_host.join(verdicts, "host", "left")
        .groupBy(F.coalesce("verdict", F.lit(default)).alias("verdict"))
        .agg(F.sum("n").alias("n"))
    )
