"""From captured requests to facts, verdicts, decisions and audit drafts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.functions.bodies import (
    body_size,
    inspectable_text,
    is_json_type,
    is_scannable,
    redaction_skip_reason,
    scan_bytes,
)
from wardlake.functions.expressions import ascii_lower, computed
from wardlake.functions.hosts import canonical_host, request_host
from wardlake.functions.masking import redact_json_with_spans, redact_with_spans
from wardlake.functions.pii import detect_located, summarize_spans
from wardlake.functions.summaries import body_hold_summary, host_hold_summary
from wardlake.operators.policy import Policy, decide
from wardlake.schemas import FACT_COLUMNS, FACTS_TYPE

DECISION_OF_VERDICT = {"allow": "allowed", "deny": "denied", "pause": "paused"}


def decision_of(verdict: Column) -> Column:
    """Audit decision of a verdict; a pause is first recorded as held."""
    result = F.when(verdict == "allow", "allowed")
    for v in ("deny", "pause"):
        result = result.when(verdict == v, DECISION_OF_VERDICT[v])
    return result


def header(name: str) -> Column:
    """One header of a request; names are lowercase."""
    return F.try_element_at(F.col("headers"), F.lit(name))


def facts_struct() -> Column:
    """The facts snapshot an audit event keeps."""
    return F.struct(*[F.col(c) for c in FACT_COLUMNS]).cast(FACTS_TYPE)


def host_facts(requests: DataFrame, host: Column) -> DataFrame:
    """Facts of the connection gate: only the host is known."""
    known = computed(requests, "domain", host)
    http = F.struct(
        F.lit("").alias("method"), F.col("domain").alias("host"), F.lit("").alias("path"),
        F.lit(0).cast("bigint").alias("body_size"),
    )
    return known.withColumn("http", http)


def host_gate(requests: DataFrame, policy: Policy, host: Column) -> DataFrame:
    """Decide every request by host; adds `outcome`, `decision`, `audited` and `summary`.

    An allowed request is audited only when it opens a tunnel (`is_connect`).
    """
    decided = decide(host_facts(requests, host), policy)
    decision = decision_of(F.col("outcome.verdict"))
    return decided.withColumns(
        {
            "decision": decision,
            "audited": (decision != "allowed") | F.col("is_connect"),
            "summary": F.when(
                decision == "paused", host_hold_summary(F.col("domain"), F.col("outcome.rule"))
            ),
        }
    )


def connect_host(uri: Column) -> Column:
    """Host of a CONNECT target."""
    return canonical_host(uri)


def inspected(requests: DataFrame, limit: int | None = None) -> DataFrame:
    """Scan request bodies once and assemble the facts.

    Input is the request schema, optionally with `decoded` (binary) and
    `decode_status` (`decoded`, `unavailable`, `overflow`). Adds the fact columns,
    `is_json`, `scannable`, `scan_text` and `located` (internal spans). No row is
    dropped: a body that cannot be read still has its request metadata. Bodies of any
    size are read, unless `limit` (bytes) says otherwise.
    """
    if "decode_status" not in requests.columns:
        requests = requests.withColumns({"decode_status": F.lit("decoded"), "decoded": F.col("body")})
    length = F.col("content_length")
    base = requests.withColumns(
        {
            "domain": request_host("uri", "headers"),
            "is_json": is_json_type(header("content-type")),
            "scannable": is_scannable("body", length, limit),
            "_size": body_size("body", length, limit),
            "_path": F.regexp_extract(
                F.col("uri"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1
            ),
        }
    )
    scanned = base.withColumn(
        "scan_text",
        inspectable_text(
            scan_bytes(F.col("body"), F.col("decoded"), F.col("decode_status"), F.col("scannable"))
        ),
    )
    scanned = computed(scanned, "located", detect_located("scan_text"))
    http = F.struct(
        F.col("method"), F.col("domain").alias("host"), F.col("_path").alias("path"),
        F.col("_size").alias("body_size"),
    )
    return scanned.withColumns({"http": http, "pii": summarize_spans("located")}).drop("_size", "_path")


def enforce(facts: DataFrame, policy: Policy, mode: str) -> DataFrame:
    """Apply a policy to inspected requests; adds `outcome`, `decision`, `audited`, `summary`.

    `detect` forwards everything and audits only findings, with the verdict that
    would have applied. `block` enforces the verdict, and audits everything that was
    not allowed plus allowed requests with findings.
    """
    if mode not in ("detect", "block"):
        raise ValueError(f"unknown enforcement mode: {mode!r}")
    decided = decide(facts, policy)
    has_findings = F.coalesce(F.col("pii.count") > 0, F.lit(False))
    verdict, rule = F.col("outcome.verdict"), F.col("outcome.rule")
    if mode == "detect":
        decision, audited = F.lit("allowed"), has_findings
    else:
        decision, audited = decision_of(verdict), (verdict != "allow") | has_findings
    summary = body_hold_summary(
        F.col("http.method"), F.col("http.host"), F.col("http.path"), F.col("pii"), rule
    )
    return decided.withColumns(
        {
            "decision": decision,
            "audited": audited,
            "summary": F.when(F.lit(mode == "block") & (verdict == "pause"), summary),
        }
    )


def audit_drafts(decided: DataFrame, timestamp: str = "ts") -> DataFrame:
    """Audit events of audited rows; ids are given when the log is read or written."""
    return decided.where("audited").select(
        F.col(timestamp).alias("timestamp"),
        "decision",
        F.col("outcome.verdict").alias("verdict"),
        F.col("outcome.rule").alias("rule"),
        facts_struct().alias("facts"),
    )


def intercepted(requests: DataFrame, hosts: str | Sequence[str] | DataFrame) -> DataFrame:
    """CONNECT targets to open: `"none"`, `"all"`, a short host list or a host table."""
    host = connect_host(F.col("uri"))
    if isinstance(hosts, DataFrame):
        wanted = hosts.select(ascii_lower(F.col("host")).alias("_host"))
        return requests.withColumn("_host", host).join(wanted, "_host", "left_semi").drop("_host")
    if hosts == "none":
        return requests.where(F.lit(False))
    if hosts == "all":
        return requests
    return requests.where(host.isin([h.lower() for h in hosts]))


def forwarded_bodies(inspected_requests: DataFrame, pads: Column) -> DataFrame:
    """Rewrite request bodies: adds `skip_reason` and `redaction`.

    A row with a skip reason keeps its body and mints no mapping. JSON bodies keep
    their syntax. Spans found by `inspected` are reused, so nothing is scanned twice
    for personal data.
    """
    encoding_present = header("content-encoding").isNotNull()
    reason = redaction_skip_reason(
        header("content-range").isNotNull(),
        F.col("scannable"),
        encoding_present,
        header("content-encoding"),
        F.col("decode_status"),
        F.col("decoded"),
    )
    staged = inspected_requests.withColumn("skip_reason", reason)
    text = F.col("scan_text")
    rewritten = F.when(
        F.col("is_json"), redact_json_with_spans(text, F.col("located"), pads)
    ).otherwise(redact_with_spans(text, F.col("located"), pads))
    return computed(staged, "redaction", F.when(F.col("skip_reason").isNull(), rewritten))
