"""Queries over requests: hosts, protocol facts, policies, enforcement, tunnels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.functions.bodies import (
    body_size,
    inspectable_text,
    is_json_type,
    is_scannable,
    redaction_skip_reason,
    restore_skip_reason,
    scan_bytes,
)
from wardlake.functions.expressions import let
from wardlake.functions.hosts import canonical_host, host_of, matches_domain, request_host
from wardlake.functions.kube import k8s_facts
from wardlake.functions.paths import is_sensitive_path
from wardlake.functions.sqlfacts import postgres_facts, sql_facts
from wardlake.functions.summaries import body_hold_summary, describe_facts, host_hold_summary, rfc3339, time_of_day
from wardlake.operators.enforcement import (
    audit_drafts,
    enforce,
    facts_struct,
    host_gate,
    inspected,
    intercepted,
)
from wardlake.operators.policy import (
    Policy,
    Rule,
    decide,
    decide_all,
    egress_verdict,
    host_verdicts,
    policy_tables,
    verdict_counts,
)
from wardlake.operators.tunnels import authorize_inner
from wardlake.plans import checks
from wardlake.plans.registry import query
from wardlake.plans.tables import (
    API_REQUESTS_SQL,
    DOMAINS,
    ORDER_FACTS_SQL,
    PAGE_POLICY,
    PART_STATEMENTS_SQL,
    RULE_VERDICT_SQL,
    SAMPLE_POLICY,
    SAMPLE_RULES_SQL,
    URL_AUTHORITY_SQL,
    URL_HOST_SQL,
    api_requests,
    egress_sql,
    order_facts,
    part_statements,
    pick,
    pick_sql,
    table,
)


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", request_host(F.col("url"), F.lit(None).cast("map<string,string>")).alias("host")
    )


@query(
    f"SELECT verdict, count(*) AS n FROM (SELECT {egress_sql(PAGE_POLICY, 'host')} AS verdict "
    f"FROM (SELECT {URL_HOST_SQL} AS host FROM pages)) GROUP BY verdict"
)
def egress_verdicts_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many page fetches the policy would have allowed or denied."""
    hosts = page_hosts(spark, sf_dir)
    return (
        hosts.groupBy("host").agg(F.count("*").alias("n"))
        .groupBy(egress_verdict(PAGE_POLICY, F.col("host")).alias("verdict"))
        .agg(F.sum("n").alias("n"))
    )


@query(
    f"SELECT page_id, host, {egress_sql(PAGE_POLICY, 'host')} AS verdict "
    f"FROM (SELECT page_id, {URL_HOST_SQL} AS host FROM pages)"
)
def egress_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every fetch."""
    decided = decide(page_hosts(spark, sf_dir).withColumnRenamed("host", "domain"), PAGE_POLICY)
    return decided.select("page_id", F.col("domain").alias("host"), F.col("outcome.verdict").alias("verdict"))


@query(
    f"SELECT verdict, CAST(count(*) AS BIGINT) AS n FROM (SELECT {egress_sql(PAGE_POLICY, 'host')} AS verdict "
    f"FROM (SELECT {URL_HOST_SQL} AS host FROM pages)) GROUP BY verdict"
)
def egress_suffix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same numbers with the pattern lists as a table."""
    hosts = page_hosts(spark, sf_dir)
    _, egress = policy_tables(spark, PAGE_POLICY)
    return verdict_counts(hosts, host_verdicts(hosts, egress, PAGE_POLICY.default), PAGE_POLICY.default)


# Pages whose URL host is a pattern: every page is matched against the patterns its key selects.
_PATTERNS = ["*.example.com", "*.EXAMPLE.net", "therin.example.net", "*.tionble.example.com", "example.org"]


@query(
    f"SELECT page_id, p LIKE '*.%' AND (host = substr(lower(p), 3) OR ends_with(host, substr(lower(p), 2))) OR host = lower(p) AS hit "
    f"FROM (SELECT page_id, {URL_HOST_SQL} AS host, {pick_sql(_PATTERNS, 'page_id % 5')} AS p FROM pages)"
)
def domain_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One domain pattern per row."""
    return page_hosts(spark, sf_dir).select(
        "page_id", matches_domain(pick(_PATTERNS, F.col("page_id") % 5), "host").alias("hit")
    )


# Host forms as they occur in CONNECT lines and headers.
_TARGETS = ["{h}", "{h}:443", "{H}.:8443", "[::1]:443", "[2001:DB8::{k}]", "{h}..", ""]
_TARGET_SQL = (
    f"replace(replace(replace({pick_sql(_TARGETS, 'page_id % 7')}, '{{h}}', host), '{{H}}', upper(host)), '{{k}}', CAST(page_id AS VARCHAR))"
)


@query(
    f"""SELECT page_id, h AS host_of, lower(rtrim(h, '.')) AS canonical FROM (
SELECT page_id, CASE WHEN starts_with(t, '[') THEN regexp_extract(t, '^\\[([^\\]]*)', 1) ELSE regexp_replace(t, ':[^:]*$', '') END AS h
FROM (SELECT page_id, {_TARGET_SQL} AS t FROM (SELECT page_id, {URL_HOST_SQL} AS host FROM pages)))"""
)
def canonical_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of connection targets in every form."""
    target = pick(_TARGETS, F.col("page_id") % 7)
    target = F.replace(F.replace(target, F.lit("{h}"), F.col("host")), F.lit("{H}"), F.upper("host"))
    target = F.replace(target, F.lit("{k}"), F.col("page_id").cast("string"))
    return page_hosts(spark, sf_dir).select(
        "page_id", host_of(target).alias("host_of"), canonical_host(target).alias("canonical")
    )


@query(
    f"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN {URL_HOST_SQL}
  WHEN page_id % 3 = 1 THEN lower(rtrim(regexp_replace(upper({URL_AUTHORITY_SQL}) || '.:80', ':[^:]*$', ''), '.')) ELSE '' END AS host FROM pages"""
)
def request_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Destination of absolute-form, origin-form and anonymous requests."""
    key = F.col("page_id") % 3
    authority = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)
    uri = F.when(key == 0, F.col("url")).otherwise("/submit")
    headers = F.when(key == 1, F.create_map(F.lit("host"), F.concat(F.upper(authority), F.lit(".:80")))).otherwise(F.create_map().cast("map<string,string>"))
    return table(spark, sf_dir, "pages").select("page_id", request_host(uri, headers).alias("host"))


_FACTS_WITH_RULE = f"SELECT *, {SAMPLE_RULES_SQL} AS rule FROM ({ORDER_FACTS_SQL})"
_OUTCOMES_SQL = f"SELECT *, CASE WHEN rule IS NOT NULL THEN {RULE_VERDICT_SQL} ELSE {egress_sql(SAMPLE_POLICY, 'domain')} END AS verdict FROM ({_FACTS_WITH_RULE})"


@query(f"SELECT o_orderkey, verdict, rule FROM ({_OUTCOMES_SQL})")
def policy_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered rules over facts, then the egress lists."""
    return decide(order_facts(spark, sf_dir), SAMPLE_POLICY).select("o_orderkey", "outcome.verdict", "outcome.rule")


@query(f"SELECT verdict, rule, count(*) AS n FROM ({_OUTCOMES_SQL}) GROUP BY verdict, rule")
def policy_verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests per verdict and rule."""
    decided = decide(order_facts(spark, sf_dir), SAMPLE_POLICY)
    return decided.groupBy("outcome.verdict", "outcome.rule").agg(F.count("*").alias("n"))


_STRICT = Policy(default="pause", deny=["*.internal.corp"], rules=[
    Rule("web-only", "web", "http.method = 'GET'", "allow"),
    Rule("no-findings", "*", "pii.count == 0 AND sql.verb = 'DELETE'", "deny"),
])
_OPEN = Policy(default="allow")


@query(
    f"""SELECT o_orderkey, 'sample' AS policy, verdict, rule FROM ({_OUTCOMES_SQL})
UNION ALL SELECT o_orderkey, 'strict', CASE rule WHEN 'web-only' THEN 'allow' WHEN 'no-findings' THEN 'deny'
    ELSE CASE WHEN ends_with(domain, '.internal.corp') THEN 'deny' ELSE 'pause' END END, rule
  FROM (SELECT *, CASE WHEN endpoint = 'web' AND h_method = 'GET' THEN 'web-only' WHEN s_verb = 'DELETE' THEN 'no-findings' END AS rule FROM ({ORDER_FACTS_SQL}))
UNION ALL SELECT o_orderkey, 'open', 'allow', NULL FROM orders"""
)
def policy_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several policies over the same requests, the first rule by position each."""
    policies = {"sample": SAMPLE_POLICY, "strict": _STRICT, "open": _OPEN}
    return decide_all(order_facts(spark, sf_dir), policies).select("o_orderkey", "policy", "verdict", "rule")


_WORDS = "list_filter(string_split_regex(statement, '\\s+'), lambda w: w <> '')"
_MODIFIERS = "('table','view','materialized','index','sequence','schema','database','if','exists','concurrently','only')"
_SQL_FACTS = f"""
SELECT p_partkey, verb, lower(trim(string_split(trim(raw, '"`'';'), '.')[-1], '"`')) AS "table" FROM (
SELECT p_partkey, verb, coalesce(CASE
  WHEN verb IN ('DROP', 'TRUNCATE') THEN list_filter(rest, lambda w: lower(w) NOT IN {_MODIFIERS})[1]
  WHEN verb IN ('INSERT', 'DELETE', 'SELECT') THEN rest[list_min(list_filter([list_position(low, 'from'), list_position(low, 'into')], lambda p: p > 0)) + 1]
  WHEN verb = 'UPDATE' THEN rest[1] END, '') AS raw
FROM (SELECT p_partkey, upper(coalesce(w[1], '')) AS verb, w[2:] AS rest, list_transform(w[2:], lambda x: lower(x)) AS low
  FROM (SELECT p_partkey, {_WORDS} AS w FROM ({PART_STATEMENTS_SQL}))))"""


@query(_SQL_FACTS)
def sql_statement_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verb and table of SQL statements."""
    return part_statements(spark, sf_dir).select("p_partkey", sql_facts("statement").alias("f")).select("p_partkey", "f.*")


# Frames: every third is damaged in some way.
_DAMAGE = 7


@query(
    f"""SELECT f.p_partkey, CASE WHEN f.p_partkey % {_DAMAGE} IN (0, 1, 2, 3, 4) THEN NULL ELSE verb END AS verb,
  CASE WHEN f.p_partkey % {_DAMAGE} IN (0, 1, 2, 3, 4) THEN NULL ELSE "table" END AS "table" FROM ({_SQL_FACTS}) f"""
)
def postgres_frame_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of query frames; malformed frames have none."""
    statements = part_statements(spark, sf_dir)
    body = F.encode("statement", "UTF-8")
    length = F.octet_length(body) + 5
    word = lambda n: F.unhex(F.lpad(F.hex(n.cast("bigint")), 8, "0"))
    frame = F.concat(F.unhex(F.lit("51")), word(length), body, F.unhex(F.lit("00")))
    damaged = [
        F.concat(frame, F.unhex(F.lit("78"))),
        F.concat(F.unhex(F.lit("51")), word(length - 1), body),
        F.concat(F.unhex(F.lit("51")), word(length + 9), body, F.unhex(F.lit("00"))),
        F.concat(F.unhex(F.lit("58")), word(length), body, F.unhex(F.lit("00"))),
        F.concat(F.unhex(F.lit("51")), word(length + 1), body, F.unhex(F.lit("FF00"))),
    ]
    kind = F.col("p_partkey") % _DAMAGE
    packet = frame
    for i, bad in enumerate(damaged):
        packet = F.when(kind == i, bad).otherwise(packet)
    return statements.select("p_partkey", postgres_facts(packet).alias("f")).select("p_partkey", "f.*")


@query(
    f"""SELECT o_orderkey, CASE upper(method) WHEN 'GET' THEN CASE WHEN named THEN 'get' ELSE 'list' END WHEN 'POST' THEN 'create'
  WHEN 'PUT' THEN 'update' WHEN 'PATCH' THEN 'patch' WHEN 'DELETE' THEN 'delete' ELSE '' END AS verb, resource, namespace FROM (
SELECT o_orderkey, method,
  CASE WHEN head = 'namespaces' AND n >= 3 THEN n >= 4 WHEN head = 'namespaces' THEN n = 2 ELSE n >= 2 END AS named,
  lower(CASE WHEN head = 'namespaces' AND n >= 3 THEN rest[3] ELSE head END) AS resource,
  CASE WHEN head = 'namespaces' AND n >= 3 THEN lower(rest[2]) ELSE '' END AS namespace
FROM (SELECT *, len(rest) AS n, coalesce(rest[1], '') AS head FROM (
  SELECT o_orderkey, method, s[(CASE s[1] WHEN 'api' THEN 3 WHEN 'apis' THEN 4 ELSE 1 END):] AS rest
  FROM (SELECT *, list_filter(string_split(split_part(path, '?', 1), '/'), lambda x: x <> '') AS s FROM ({API_REQUESTS_SQL})))))"""
)
def k8s_request_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verb, resource and namespace of Kubernetes API requests."""
    return api_requests(spark, sf_dir).select("o_orderkey", k8s_facts("method", "path").alias("f")).select("o_orderkey", "f.*")


# Bodies: documents as request bodies with declared lengths and types.
_TYPES = ["application/json", "APPLICATION/JSON; charset=utf-8", "application/problem+json", "text/plain", None, "application/json+x"]
_OVER = 3_000_000
_LIMIT = 5_000
# Every hundredth body is larger than 2 MiB.
_PADDING = 600_000


@query(
    f"""SELECT doc_id, doc_id % 6 IN (0, 1, 2) AS is_json, size AS body_size,
  CASE WHEN size > {_LIMIT} THEN CASE WHEN doc_id % 4 = 0 THEN {_OVER} WHEN doc_id % 4 = 1 THEN size ELSE -1 END ELSE size END AS limited_size,
  size <= {_LIMIT} AS within_limit, CASE WHEN doc_id % 5 <> 1 THEN length(text) END AS text_chars FROM (
  SELECT doc_id, text, CAST(strlen(text) + (doc_id % 5 IN (1, 2))::INT AS BIGINT) AS size FROM (
  SELECT doc_id, CASE WHEN doc_id % 100 = 7 THEN repeat('a b ', {_PADDING}) || text ELSE text END AS text FROM documents))"""
)
def body_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, size and text of bodies: intact, cut inside a character, broken, of any size."""
    key = F.col("doc_id")
    padded = F.when(key % 100 == 7, F.concat(F.repeat(F.lit("a b "), F.lit(_PADDING)), F.col("text"))).otherwise(F.col("text"))
    body = F.encode(padded, "UTF-8")
    cut = F.concat(body, F.unhex(F.lit("C3")))
    broken = F.concat(F.unhex(F.lit("FF")), body)
    staged = table(spark, sf_dir, "documents").select(
        "doc_id",
        pick(_TYPES, key % 6).alias("content_type"),
        F.when(key % 5 == 1, broken).when(key % 5 == 2, cut).otherwise(body).alias("body"),
    ).withColumn("content_length", F.when(key % 4 == 0, _OVER).when(key % 4 == 1, F.octet_length("body")).cast("bigint"))
    # A wrong declared length does not matter where the body is there.
    return staged.select(
        "doc_id",
        is_json_type("content_type").alias("is_json"),
        body_size("body", "content_length").alias("body_size"),
        body_size("body", "content_length", _LIMIT).alias("limited_size"),
        is_scannable("body", "content_length", _LIMIT).alias("within_limit"),
        let(F.col("body"), lambda b: F.length(inspectable_text(b))).alias("text_chars"),
    )


_STATUSES = ["decoded", "unavailable", "overflow"]


@query(
    """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'none' WHEN doc_id % 3 = 0 THEN 'decoded' WHEN doc_id % 3 = 1 THEN 'raw' ELSE 'none' END AS scanned,
  CASE WHEN doc_id % 11 = 0 THEN 'partial_upload' WHEN doc_id % 7 = 0 THEN 'over_limit' WHEN doc_id % 13 = 0 THEN 'encoding_not_text'
    WHEN doc_id % 3 <> 0 THEN 'not_decodable' WHEN doc_id % 5 = 0 THEN 'not_utf8' END AS skip_reason FROM documents"""
)
def decode_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is scanned and what may be rewritten, by decode status."""
    key = F.col("doc_id")
    status = pick(_STATUSES, key % 3)
    raw, good = F.encode(F.lit("raw"), "UTF-8"), F.encode("text", "UTF-8")
    decoded = F.when(key % 5 == 0, F.concat(F.unhex(F.lit("FF")), good)).otherwise(good)
    scanned = scan_bytes(raw, decoded, status, key % 7 != 0)
    reason = redaction_skip_reason(
        key % 11 == 0, key % 7 != 0, key % 13 == 0, F.lit(None).cast("string"), status, decoded
    )
    kind = let(scanned, lambda s: F.when(s.isNull(), "none").when(s == raw, "raw").otherwise("decoded"))
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("scanned"), reason.alias("skip_reason"))


_CODES = ["100", "200", "204", "206", "304", "404", "199"]
_ENCODINGS = [None, "", " Identity ", "gzip"]


@query(
    f"""SELECT o_orderkey, CASE WHEN s BETWEEN 100 AND 199 THEN 'informational' WHEN s = 204 THEN 'no_content' WHEN s = 206 THEN 'partial_content'
  WHEN s = 304 THEN 'not_modified' WHEN e = 'gzip' THEN 'encoded' WHEN o_orderkey % 6 = 0 THEN 'nothing_to_restore' END AS skip_reason
FROM (SELECT o_orderkey, CAST({pick_sql(_CODES, 'o_orderkey % 7')} AS INTEGER) AS s, {pick_sql(_ENCODINGS, '(o_orderkey // 7) % 4')} AS e FROM orders)"""
)
def response_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which responses are left alone, and why."""
    key = F.col("o_orderkey")
    status = pick(_CODES, key % 7).cast("int")
    encoding = pick(_ENCODINGS, F.floor(key / 7) % 4)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", restore_skip_reason(status, encoding, key % 6).alias("skip_reason")
    )


@query(
    f"""SELECT o_orderkey, CASE WHEN s_verb IS NOT NULL THEN 'SQL ' || s_verb || ' accounts'
  WHEN k_verb IS NOT NULL THEN 'k8s ' || k_verb || ' ' || k_resource || ' in prod'
  WHEN h_method IS NOT NULL THEN h_method || ' ' || coalesce(h_host, '') || '/upload' ELSE '—' END AS description,
  'CONNECT ' || coalesce(raw, '?') || CASE WHEN rule IS NOT NULL THEN ' (rule: ' || rule || ')' ELSE '' END AS hold,
  coalesce(h_method, '-') || ' ' || coalesce(raw, '?') || '/upload: PII [none] (0 finding(s)' || CASE WHEN rule IS NOT NULL THEN ', rule: ' || rule ELSE '' END || ')' AS body_hold
FROM (SELECT f.*, {pick_sql(DOMAINS, 'o.o_custkey % 7')} AS raw FROM ({_FACTS_WITH_RULE}) f JOIN orders o USING (o_orderkey))"""
)
def request_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-line descriptions for audit views and approval queues."""
    decided = decide(order_facts(spark, sf_dir), SAMPLE_POLICY)
    host, rule = F.coalesce("domain", F.lit("?")), F.col("outcome.rule")
    return decided.select(
        "o_orderkey",
        describe_facts(facts_struct()).alias("description"),
        host_hold_summary(host, rule).alias("hold"),
        body_hold_summary(F.coalesce("http.method", F.lit("-")), host, F.lit("/upload"), F.col("pii"), rule).alias("body_hold"),
    )


@query(
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'not a time' ELSE strftime(ts, '%H:%M:%S') END AS shown FROM events"""
)
def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time of day of timestamps kept as text."""
    text = F.when(F.col("event_id") % 5 == 0, "not a time").otherwise(F.col("ts").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", time_of_day(text).alias("shown"))


# Connections: events as CONNECT lines and plain requests of a gateway.
def gateway_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", (key % 3 == 0).alias("is_connect"),
        F.concat(F.coalesce(pick(DOMAINS, F.col("user_id") % 7), F.lit("unknown.test")), F.lit(":443")).alias("uri"),
    )


_GATE_POLICY = Policy(
    default="deny", allow=["github.com", "*.githubusercontent.com"], deny=["*.internal.corp"],
    rules=[Rule("ask-first", "*", "http.host = 'api.anthropic.com'", "pause")],
)


@query(
    f"""SELECT event_id, decision, CASE WHEN decision = 'paused' THEN 'CONNECT api.anthropic.com (rule: ask-first)' END AS summary FROM (
SELECT event_id, event_id % 3 = 0 AS is_connect, CASE WHEN host = 'api.anthropic.com' THEN 'paused'
  WHEN {egress_sql(_GATE_POLICY, 'host')} = 'allow' THEN 'allowed' ELSE 'denied' END AS decision
FROM (SELECT event_id, lower(coalesce({pick_sql(DOMAINS, 'user_id % 7')}, 'unknown.test')) AS host FROM events)) WHERE decision <> 'allowed' OR is_connect"""
)
def connection_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audited decisions of the host gate."""
    gated = host_gate(gateway_requests(spark, sf_dir), _GATE_POLICY, canonical_host("uri"))
    return gated.where("audited").select("event_id", "decision", "summary")


@query(
    f"""SELECT event_id FROM (SELECT event_id, lower({pick_sql(DOMAINS, 'user_id % 7')}) AS host FROM events)
WHERE host IN ('github.com', 'api.anthropic.com')"""
)
def intercept_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections whose contents are inspected."""
    return intercepted(gateway_requests(spark, sf_dir), ["github.com", "api.anthropic.com"]).select("event_id")


@query(
    f"""SELECT 'all' AS form, event_id FROM events UNION ALL
SELECT 'table', event_id FROM (SELECT event_id, lower({pick_sql(DOMAINS, 'user_id % 7')}) AS host FROM events) WHERE host IN ('github.com', 'api.anthropic.com')"""
)
def intercept_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other forms of that selection: none, all, and a table of hosts."""
    requests = gateway_requests(spark, sf_dir)
    chosen = table(spark, sf_dir, "events").select(pick(DOMAINS, F.col("user_id") % 7).alias("host"))
    hosts = chosen.where(F.lower("host").isin("github.com", "api.anthropic.com")).distinct()
    forms = {"none": "none", "all": "all", "table": hosts}
    parts = [intercepted(requests, hosts).select(F.lit(form).alias("form"), "event_id") for form, hosts in forms.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT event_id, strftime(make_timestamp(event_id * 86399000001), '%Y-%m-%dT%H:%M:%S.%fZ') AS at FROM events")
def event_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants as RFC 3339 text."""
    instant = F.timestamp_micros(F.col("event_id") * 86_399_000_001)
    return table(spark, sf_dir, "events").select("event_id", rfc3339(instant).alias("at"))


# Uploads: documents as request bodies.
_UPLOAD_POLICY = Policy(
    default="allow",
    rules=[
        Rule("no-high-severity", "*", "pii.count > 0 AND pii.max_severity >= 3", "deny"),
        Rule("hold-mail", "*", "array_contains(pii.types, 'EMAIL')", "pause"),
        Rule("no-put", "*", "http.method = 'PUT' && http.body_size > 5000", "deny"),
    ],
)


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as captured requests."""
    key = F.col("doc_id")
    headers = F.create_map(F.lit("host"), F.lit("Upload.Example.com:8080"), F.lit("content-type"), F.lit("text/plain"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.lit(None).cast("timestamp").alias("ts"),
        pick(["POST", "PUT", "POST"], key % 3).alias("method"),
        F.concat(F.lit("/u/"), (key % 10).cast("string"), F.lit("?q=1")).alias("uri"),
        headers.alias("headers"),
        F.octet_length("text").cast("bigint").alias("content_length"),
        F.encode("text", "UTF-8").alias("body"),
    )


_DOCS = "SELECT doc_id AS key, text FROM documents"
_UPLOADS_SQL = f"""
SELECT d.doc_id, method, strlen(text) AS size, coalesce(n, 0) AS n, types, coalesce(sev, 0) AS sev,
  CASE WHEN coalesce(n, 0) > 0 AND sev >= 3 THEN 'no-high-severity' WHEN list_contains(coalesce(types, []), 'EMAIL') THEN 'hold-mail'
    WHEN method = 'PUT' AND strlen(text) > 5000 THEN 'no-put' END AS rule
FROM (SELECT doc_id, text, CASE WHEN doc_id % 3 = 1 THEN 'PUT' ELSE 'POST' END AS method FROM documents) d LEFT JOIN (
  SELECT key, count(*) AS n, list(DISTINCT label ORDER BY label) AS types, max({checks.severity('label')}) AS sev FROM ({checks.spans(_DOCS)}) GROUP BY key) s ON s.key = d.doc_id"""
_UPLOAD_VERDICT = "CASE rule WHEN 'no-high-severity' THEN 'deny' WHEN 'hold-mail' THEN 'pause' WHEN 'no-put' THEN 'deny' ELSE 'allow' END"


def _audit_rows(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    decided = enforce(inspected(uploads(spark, sf_dir)), _UPLOAD_POLICY, mode)
    return decided.where("audited").select(
        "doc_id", "decision", "outcome.verdict", "outcome.rule",
        F.array_join("pii.types", ",").alias("types"), F.coalesce("pii.count", F.lit(0)).cast("bigint").alias("findings"),
        F.col("http.host").alias("host"), F.col("http.path").alias("path"), F.col("http.body_size").alias("body_size"), "summary",
    )


_AUDIT_COLUMNS = (
    "array_to_string(types, ',') AS types, CAST(n AS BIGINT) AS findings, 'upload.example.com' AS host, "
    "'/u/' || (doc_id % 10) AS path, CAST(size AS BIGINT) AS body_size"
)


@query(
    f"SELECT doc_id, 'allowed' AS decision, {_UPLOAD_VERDICT} AS verdict, rule, {_AUDIT_COLUMNS}, CAST(NULL AS VARCHAR) AS summary "
    f"FROM ({_UPLOADS_SQL}) WHERE n > 0"
)
def enforcement_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows of detect mode: findings, with the verdict that would have applied."""
    return _audit_rows(spark, sf_dir, "detect")


@query(
    f"""SELECT doc_id, CASE verdict WHEN 'allow' THEN 'allowed' WHEN 'deny' THEN 'denied' ELSE 'paused' END AS decision, verdict, rule, {_AUDIT_COLUMNS},
  CASE WHEN verdict = 'pause' THEN method || ' upload.example.com/u/' || (doc_id % 10) || ': PII [' || array_to_string(types, ',') || '] (' || n || ' finding(s), rule: ' || rule || ')' END AS summary
FROM (SELECT *, {_UPLOAD_VERDICT} AS verdict FROM ({_UPLOADS_SQL})) WHERE verdict <> 'allow' OR n > 0"""
)
def enforcement_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows of block mode."""
    return _audit_rows(spark, sf_dir, "block")


@query(
    f"""SELECT CASE {_UPLOAD_VERDICT} WHEN 'allow' THEN 'allowed' WHEN 'deny' THEN 'denied' ELSE 'paused' END AS decision, count(*) AS n
FROM ({_UPLOADS_SQL}) WHERE {_UPLOAD_VERDICT} <> 'allow' OR n > 0 GROUP BY 1"""
)
def request_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request to audit draft, end to end, counted by decision."""
    decided = enforce(inspected(uploads(spark, sf_dir)), _UPLOAD_POLICY, "block")
    return audit_drafts(decided).groupBy("decision").agg(F.count("*").alias("n"))


# Tunnels: a client is a user; most events are inner requests.
_TUNNEL_HOSTS = ["a.test", "b.test"]


def tunnel_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("user_id").alias("client"),
        pick(_TUNNEL_HOSTS, F.floor(key / 3) % 2).alias("host"),
        (F.col("event_type") == "view").alias("is_connect"),
        (key % 4 != 0).alias("allowed"),
    )


@query(
    f"""SELECT event_id, client, tunnel_host, coalesce(tunnel_host = host, FALSE) AS authorized FROM (
SELECT *, last_value(CASE WHEN is_connect AND allowed THEN host END IGNORE NULLS) OVER (PARTITION BY client ORDER BY ts, event_id) AS tunnel_host
FROM (SELECT event_id, ts, user_id AS client, {pick_sql(_TUNNEL_HOSTS, '(event_id // 3) % 2')} AS host, event_type = 'view' AS is_connect, event_id % 4 <> 0 AS allowed FROM events))
WHERE NOT is_connect"""
)
def tunnel_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner requests with the tunnel they came through."""
    return authorize_inner(tunnel_traffic(spark, sf_dir)).select("event_id", "client", "tunnel_host", "authorized")


# Sensitive paths: a fixed list of shapes with the page key in it.
PATHS = [
    "/project/{k}/.env", "/project/.env.local{k}", ".ENVRC", "/p/{k}/.env.example", "/home/u{k}/.ssh/id_rsa", "/home/u/.ssh/id_rsa.pub",
    "/home/u/.ssh/id_ed25519_old{k}", "C:\\Users\\u{k}\\.gnupg\\secring.gpg", ".aws/credentials", "/x/{k}.aws/credentials.sample",
    "/keys/{k}.PEM", "/keys/{k}.pem.dist", "/etc/credentials", "/etc/credentials{k}", "src/main{k}.rs", "", "/srv/.netrc", "store{k}.jks",
    "a/b.key/c{k}", "/home/.npmrc\\x{k}",
]


@query(
    f"""SELECT page_id, path, CASE WHEN regexp_matches(base, '\\.(example|sample|template|dist)$') THEN FALSE ELSE
  regexp_matches(base, '^\\.env(rc)?$|^\\.env\\.') OR base IN ('.git-credentials', '.netrc', '.npmrc', '.pypirc', 'credentials')
  OR (regexp_matches(base, '^id_(rsa|dsa|ecdsa|ed25519)') AND NOT ends_with(base, '.pub'))
  OR regexp_matches(base, '\\.(pem|key|p12|pfx|keystore|jks|asc)$') OR contains(u, '.aws/credentials') OR contains(u, '.gnupg/') END AS sensitive
FROM (SELECT page_id, path, replace(lower(path), '\\', '/') AS u, string_split(replace(lower(path), '\\', '/'), '/')[-1] AS base
  FROM (SELECT page_id, replace({pick_sql(PATHS, f'page_id % {len(PATHS)}')}, '{{k}}', CAST(page_id AS VARCHAR)) AS path FROM pages))"""
)
def sensitive_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which paths name credentials or key material."""
    key = F.col("page_id")
    path = F.replace(pick(PATHS, key % len(PATHS)), F.lit("{k}"), key.cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).withColumn("sensitive", is_sensitive_path("path"))
