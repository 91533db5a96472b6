"""Queries over texts: personal data, credentials, masking, and agent hooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.functions.expressions import computed, let
from wardlake.functions.masking import (
    all_labels,
    placeholder,
    redact,
    redact_json_with_spans,
    redact_with_spans,
    restore_text,
    salt_pads,
    session_pads,
    unquoted_findings,
)
from wardlake.functions.pii import detect_located, detect_pii, detect_spans, public_spans, severity_of
from wardlake.functions.secrets import detect_secrets, generic_secrets
from wardlake.operators.enforcement import forwarded_bodies, inspected
from wardlake.operators.hooks import hook_verdicts, prompt_block_reason
from wardlake.operators.mappings import mapping_rows, merge, restore, retained, retention_stats, unstable_secrets
from wardlake.operators.salts import read_machines, session_salts, with_pads, write_machines
from wardlake.plans import checks
from wardlake.plans.policy_queries import PATHS, uploads
from wardlake.plans.registry import query
from wardlake.plans.tables import MACHINE_SECRET, SALT, pick, pick_sql, table
from wardlake.runtime import shared_dir

_DOCS = "SELECT doc_id AS key, text FROM documents"
_SPANS = checks.spans(_DOCS)


@query(f'SELECT key AS doc_id, label, start, "end", text, 1 AS tier FROM ({_SPANS})')
def pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding with its UTF-16 offsets."""
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(detect_spans("text")).alias("s")).select(
        "doc_id", "s.label", "s.start", "s.end", "s.text", "s.tier"
    )


@query(
    f"""SELECT doc_id, types, CAST(n AS BIGINT) AS "count", CAST(sev AS BIGINT) AS max_severity FROM documents LEFT JOIN (
SELECT key, string_agg(DISTINCT label, ',' ORDER BY label) AS types, count(*) AS n, max({checks.severity('label')}) AS sev FROM ({_SPANS}) GROUP BY key) ON key = doc_id"""
)
def pii_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, count and severity per document; NULL where nothing was found."""
    return table(spark, sf_dir, "documents").select("doc_id", detect_pii("text").alias("p")).select(
        "doc_id", F.array_join("p.types", ",").alias("types"), "p.count", "p.max_severity"
    )


@query(
    f"""SELECT label, count(*) AS spans, count(DISTINCT key) AS docs, CAST(max({checks.severity('label')}) AS BIGINT) AS severity FROM ({_SPANS}) GROUP BY label"""
)
def pii_label_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings per label over the whole corpus, counted per document first."""
    per_doc = table(spark, sf_dir, "documents").select("doc_id", F.explode(detect_spans("text")).alias("s")).groupBy(
        "doc_id", "s.label"
    ).agg(F.count("*").alias("n"))
    return per_doc.groupBy("label").agg(
        F.sum("n").alias("spans"), F.count("*").alias("docs"), F.max(severity_of("label")).alias("severity")
    )


# Conversations hold user turns without personal data; pages hold raw HTML.
@query(
    f'SELECT key AS page_id, label, count(*) AS n FROM ({checks.spans("SELECT page_id AS key, html AS text FROM pages")}) GROUP BY key, label'
)
def page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in raw pages."""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(detect_spans("html")).alias("s")).groupBy(
        "page_id", "s.label"
    ).agg(F.count("*").alias("n"))


# Korean identifiers from order keys: valid, wrong, or shaped like one. A base number
# is the key in fixed width, so any check digit occurs.
_ID_TEXTS = [
    "제 번호는{a}-{b}입니다", "no {a}{b} end", "x{a}-{b}", "사업자 {c} 번호", "{c}", "call 0{d}-{e}-{f}", "모바일010{e}{f}로", "011{e}{f}",
    "ref {a}-{b}; mail u{k}@x{d}.co.kr, host 10.{d}.0.{k}", "😀 4{a}{b}{d} / 4{e}-{f}-{e}-{f}",
]


def id_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")

    def number(step: int, offset: int, width: int) -> Column:
        return F.lpad(((key * step + offset) % 10**width).cast("string"), width, "0")

    day = F.lpad((key % 31 + 1).cast("string"), 2, "0")
    month = F.lpad((F.floor(key / 31) % 13).cast("string"), 2, "0")
    parts = {
        "{a}": F.concat(number(7, 3, 2), month, day),
        "{b}": F.concat((key % 10).cast("string"), number(7919, 17, 6)),
        "{c}": F.concat(number(31, 100, 3), F.lit("-"), number(17, 1, 2), F.lit("-"), number(104729, 5, 5)),
        "{d}": (key % 99).cast("string"),
        "{e}": number(7907, 1000, 4),
        "{f}": number(1231, 77, 4),
        "{k}": (key % 300).cast("string"),
    }
    text = pick(_ID_TEXTS, F.floor(key / 3) % len(_ID_TEXTS))
    for mark, value in parts.items():
        text = F.replace(text, F.lit(mark), value)
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))


def _id_texts_sql() -> str:
    def number(step: int, offset: int, width: int) -> str:
        return f"lpad(CAST((o_orderkey * {step} + {offset}) % {10**width} AS VARCHAR), {width}, '0')"

    parts = {
        "{a}": f"{number(7, 3, 2)} || lpad(CAST((o_orderkey // 31) % 13 AS VARCHAR), 2, '0') || lpad(CAST(o_orderkey % 31 + 1 AS VARCHAR), 2, '0')",
        "{b}": f"CAST(o_orderkey % 10 AS VARCHAR) || {number(7919, 17, 6)}",
        "{c}": f"{number(31, 100, 3)} || '-' || {number(17, 1, 2)} || '-' || {number(104729, 5, 5)}",
        "{d}": "CAST(o_orderkey % 99 AS VARCHAR)",
        "{e}": number(7907, 1000, 4),
        "{f}": number(1231, 77, 4),
        "{k}": "CAST(o_orderkey % 300 AS VARCHAR)",
    }
    text = pick_sql(_ID_TEXTS, f"(o_orderkey // 3) % {len(_ID_TEXTS)}")
    for mark, value in parts.items():
        text = f"replace({text}, '{mark}', {value})"
    return f"SELECT o_orderkey AS key, {text} AS text FROM orders"


ID_TEXTS_SQL = _id_texts_sql()


@query(f'SELECT key AS o_orderkey, label, start, "end", text FROM ({checks.spans(ID_TEXTS_SQL)})')
def pii_kr_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Korean identifiers, phones and cards, flush against Hangul and emoji."""
    return id_texts(spark, sf_dir).select("o_orderkey", F.explode(detect_spans("text")).alias("s")).select(
        "o_orderkey", "s.label", "s.start", "s.end", "s.text"
    )


@query(f"SELECT key AS doc_id, label, text FROM ({checks.secrets(_DOCS)}) WHERE label = 'GENERIC_SECRET'")
def secrets_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword-anchored credentials."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.lit("GENERIC_SECRET").alias("label"), F.explode(generic_secrets("text")).alias("text")
    )


# Credentials from customer keys: `{h}` 64 hex digits, `{H}` the same in upper case.
_SECRET_TEXTS = [
    "deploy with sk-ant-api03-{h} now", "key=sk-proj-{h};", "OPENAI sk-{h}", "aws AKIA{U} ok", "token ghp_{p} or github_pat_{p}",
    "slack xoxb-{p}", "AIza{g} and AIza{g}", "-----BEGIN RSA PRIVATE KEY-----\n{h}\n-----END RSA PRIVATE KEY-----\ntail",
    "-----BEGIN PRIVATE KEY-----\n{h} no footer", 'api_key = "{p}"', "password: example{p}", "passwd=aaaaaaaaaaaaaaaaaaaa",
    '{"client_secret":"{h}"}', "xsk-ant-{h}", "AUTH-TOKEN = '{p}' twice '{p}'",
]


def secret_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    h = F.sha2(F.concat(F.lit("k"), key.cast("string")).cast("binary"), 256)
    parts = {"{h}": h, "{U}": F.upper(F.substring(h, 1, 16)), "{p}": F.substring(h, 1, 40), "{g}": F.substring(h, 5, 35)}
    text = pick(_SECRET_TEXTS, key % len(_SECRET_TEXTS))
    for mark, value in parts.items():
        text = F.replace(text, F.lit(mark), value)
    return table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"))


def _secret_texts_sql() -> str:
    h = "sha256('k' || c_custkey)"
    parts = {"{h}": h, "{U}": f"upper(substr({h}, 1, 16))", "{p}": f"substr({h}, 1, 40)", "{g}": f"substr({h}, 5, 35)"}
    text = pick_sql(_SECRET_TEXTS, f"c_custkey % {len(_SECRET_TEXTS)}")
    for mark, value in parts.items():
        text = f"replace({text}, '{mark}', {value})"
    return f"SELECT c_custkey AS key, {text} AS text FROM customer"


SECRET_TEXTS_SQL = _secret_texts_sql()


@query(f"SELECT key AS c_custkey, label, text FROM ({checks.secrets(SECRET_TEXTS_SQL)})")
def secrets_by_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor keys, key blocks and generic secrets."""
    return secret_texts(spark, sf_dir).select("c_custkey", F.explode(detect_secrets("text")).alias("s")).select(
        "c_custkey", "s.label", "s.text"
    )


_REDACTED = checks.redactions(_DOCS, SALT)


def _redaction_columns() -> list[Column]:
    return [
        F.sha2(F.col("r.text").cast("binary"), 256).alias("masked_hash"), F.col("r.redacted").alias("redacted"),
        F.array_join("r.secret_labels", ",").alias("secret_labels"), F.array_join("r.pii_labels", ",").alias("pii_labels"),
        F.col("r.max_pii_severity").alias("severity"), F.size("r.mapping").cast("bigint").alias("mapped"),
    ]


_REDACTION_SQL = (
    "sha256(masked) AS masked_hash, len(surfaces) > 0 AS redacted, secret_labels, pii_labels, severity, CAST(len(surfaces) AS BIGINT) AS mapped"
)


@query(f"SELECT key AS doc_id, {_REDACTION_SQL} FROM ({_REDACTED})")
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask every document: what fired, and the masked text's hash."""
    return table(spark, sf_dir, "documents").select("doc_id", redact("text", salt_pads(SALT)).alias("r")).select(
        "doc_id", *_redaction_columns()
    )


@query(f"SELECT key AS c_custkey, masked, {_REDACTION_SQL} FROM ({checks.redactions(SECRET_TEXTS_SQL, SALT)})")
def redact_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask credential texts."""
    return secret_texts(spark, sf_dir).select("c_custkey", redact("text", salt_pads(SALT)).alias("r")).select(
        "c_custkey", F.col("r.text").alias("masked"), *_redaction_columns()
    )


@query(f"SELECT key AS o_orderkey, masked, pii_labels FROM ({checks.redactions(ID_TEXTS_SQL, SALT, 1)})")
def redact_with_low_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask everything down to addresses, from spans that are already there."""
    spans = id_texts(spark, sf_dir).withColumn("spans", detect_spans("text"))
    return spans.select("o_orderkey", redact_with_spans("text", "spans", salt_pads(SALT), floor=1).alias("r")).select(
        "o_orderkey", F.col("r.text").alias("masked"), F.array_join("r.pii_labels", ",").alias("pii_labels")
    )


@query(f"SELECT key AS o_orderkey, {checks.placeholder('text', SALT)} AS placeholder FROM ({ID_TEXTS_SQL})")
def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The placeholder of a text as a whole."""
    return id_texts(spark, sf_dir).select("o_orderkey", placeholder("text", salt_pads(SALT)).alias("placeholder"))


@query("SELECT doc_id, TRUE AS restored, sha256(text) AS text_hash FROM documents")
def detokenize_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask, then restore row by row: the original text again."""
    masked = table(spark, sf_dir, "documents").select("doc_id", "text", redact("text", salt_pads(SALT)).alias("r"))
    back = masked.select("doc_id", "text", restore_text("r.text", F.col("r.mapping")).alias("back"))
    return back.select(
        "doc_id", (F.col("back") == F.col("text")).alias("restored"), F.sha2(F.col("back").cast("binary"), 256).alias("text_hash")
    )


def masked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", F.lit("main").alias("salt_id"), "text")
    masked = computed(documents, "r", redact("text", salt_pads(SALT)))
    return masked.select("doc_id", "salt_id", F.col("r.text").alias("text"), F.col("r.mapping").alias("mapping"))


def document_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping_rows(masked_documents(spark, sf_dir), "mapping", "doc_id", "salt_id")


@query(
    f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN sha256(text) ELSE sha256(text || ' <<hs:00000000000000000000000000000000>> <<hs:12') END AS text_hash FROM documents"""
)
def restore_by_mapping_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restore from the mapping table; forged and cut placeholders stay."""
    # Texts and mapping come from one pass: masking again for each would cost as much.
    path = shared_dir(spark, "masked")
    masked_documents(spark, sf_dir).write.parquet(path)
    masked = spark.read.parquet(path)
    forged = F.concat("text", F.lit(" <<hs:00000000000000000000000000000000>> <<hs:12"))
    texts = masked.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(forged))
    mapping = mapping_rows(masked, "mapping", "doc_id", "salt_id")
    restored = restore(texts.drop("mapping"), merge(mapping), "doc_id", "text", "salt_id")
    return restored.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"))


_MAPPING = f"SELECT {checks.placeholder('secret', SALT)} AS placeholder, secret, max(key) AS last_seq FROM (SELECT key, unnest(surfaces) AS secret FROM ({_REDACTED})) GROUP BY secret"


@query(f"SELECT 'main' AS salt_id, placeholder, secret, last_seq FROM ({_MAPPING})")
def mapping_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholder and secret of everything masked, latest use last; two transports share it."""
    mapping = document_mapping(spark, sf_dir)
    return merge(mapping.where("last_seq % 2 = 0"), mapping.where("last_seq % 2 = 1"))


_CAPS = {"max_entries": 20, "max_bytes": 400}
_RETAINED = f"""SELECT placeholder, secret, last_seq FROM (SELECT *, row_number() OVER w AS r, sum(strlen(secret)) OVER (w ROWS UNBOUNDED PRECEDING) AS b
FROM ({_MAPPING}) WINDOW w AS (ORDER BY last_seq DESC, placeholder)) WHERE r <= {_CAPS['max_entries']} AND b <= {_CAPS['max_bytes']}"""


@query(f"SELECT placeholder, secret, last_seq FROM ({_RETAINED})")
def mapping_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a small store keeps."""
    return retained(document_mapping(spark, sf_dir), **_CAPS).select("placeholder", "secret", "last_seq")


@query(f"SELECT 'main' AS salt_id, count(*) AS entries, CAST(sum(strlen(secret)) AS BIGINT) AS bytes FROM ({_RETAINED})")
def mapping_retention_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries and bytes of that store."""
    return retention_stats(retained(document_mapping(spark, sf_dir), **_CAPS))


# Sessions: conversations whose every turn repeats the session's credential.
def session_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    secret = F.sha2(F.concat(F.lit("c"), F.col("conv_id").cast("string")).cast("binary"), 256)
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"), "conv_id", "turn", "role",
        F.concat(F.col("text"), F.lit("\nsecret: "), secret).alias("text"),
    )


@query(
    f"""SELECT conv_id, turn, '<<hs:' || substr(sha256(outer_pad || unhex(sha256(inner_pad || encode(secret)))), 1, 32) || '>>' AS placeholder FROM (
SELECT conv_id, turn, sha256('c' || conv_id) AS secret,
  unhex(list_reduce(list_transform(range(1, 65), lambda i: CASE WHEN i <= 32 THEN printf('%02x', xor(('0x' || substr(salt, 2 * i - 1, 2))::INTEGER, 54)) ELSE '36' END), lambda a, b: a || b)) AS inner_pad,
  unhex(list_reduce(list_transform(range(1, 65), lambda i: CASE WHEN i <= 32 THEN printf('%02x', xor(('0x' || substr(salt, 2 * i - 1, 2))::INTEGER, 92)) ELSE '5c' END), lambda a, b: a || b)) AS outer_pad
FROM (SELECT *, {checks.hmac("'s' || conv_id", MACHINE_SECRET)} AS salt FROM conversations))"""
)
def session_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session masks under its own derived salt, with salts from a table."""
    path = shared_dir(spark, "machines")
    write_machines(spark, {"local": MACHINE_SECRET}, path)
    turns = session_turns(spark, sf_dir).withColumn("machine_id", F.lit("local"))
    masked = with_pads(turns, session_salts(turns, read_machines(spark, path))).withColumn("r", redact("text", F.col("pads")))
    return masked.select("conv_id", "turn", F.explode(F.map_keys("r.mapping")).alias("placeholder"))


@query("SELECT 's' AS session_id, '' AS secret, '' AS first, '' AS last WHERE FALSE")
def turn_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets whose placeholder changed between turns: none."""
    pads = session_pads("session_id", salt_pads(MACHINE_SECRET))
    masked = session_turns(spark, sf_dir).withColumn("r", let(pads, lambda p: redact("text", p)))
    rows = mapping_rows(masked.withColumn("mapping", F.col("r.mapping")), "mapping", "turn", "session_id")
    return unstable_secrets(rows.withColumnRenamed("salt_id", "session_id"))


@query(
    """SELECT session_id, CAST(count(DISTINCT secret) AS BIGINT) AS secrets, CAST(count(*) AS BIGINT) AS masked, CAST(0 AS BIGINT) AS unstable
FROM (SELECT 's' || conv_id AS session_id, sha256('c' || conv_id) AS secret FROM conversations) GROUP BY session_id"""
)
def turn_stability_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per session: secrets, how often they were masked, and how many got a second placeholder, which none did."""
    pads = session_pads("session_id", salt_pads(MACHINE_SECRET))
    masked = session_turns(spark, sf_dir).withColumn("r", let(pads, lambda p: redact("text", p)))
    rows = mapping_rows(masked.withColumn("mapping", F.col("r.mapping")), "mapping", "turn", "session_id")
    rows = rows.withColumnRenamed("salt_id", "session_id")
    rows = rows.where(F.length("secret") == 64)  # the credential of each turn; its texts may hold other findings
    unstable = unstable_secrets(rows).groupBy("session_id").agg(F.count("*").alias("unstable"))
    seen = rows.groupBy("session_id").agg(F.count_distinct("secret").alias("secrets"), F.count("*").alias("masked"))
    return seen.join(unstable, "session_id", "left").select("session_id", "secrets", "masked", F.coalesce("unstable", F.lit(0)).cast("bigint").alias("unstable"))


# JSON bodies: each document's text as a string value, and its card numbers bare.
def json_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = F.regexp_extract("text", r"(?<![0-9A-Za-z_])[0-9]{16}(?![0-9A-Za-z_])", 0)
    clean = F.replace(F.replace(F.col("text"), F.lit("\\"), F.lit("/")), F.lit('"'), F.lit("'"))
    note = F.concat(F.lit('"'), F.replace(clean, F.lit("\n"), F.lit("\\n")), F.lit('"'))
    body = F.concat(
        F.lit('{"note":'), note, F.lit(',"bare":'), F.when(card == "", "0").otherwise(card), F.lit(',"again":"'), card,
        F.lit('","k":"say \\"hi\\" '), card, F.lit('"}'),
    )
    return table(spark, sf_dir, "documents").select("doc_id", body.alias("text"))


_WRAPPED_SQL = """SELECT doc_id AS key, '{"note":"' || replace(clean, chr(10), '\\n') || '","bare":' || CASE WHEN card = '' THEN '0' ELSE card END || ',"again":"' || card || '","k":"say \\"hi\\" ' || card || '"}' AS text
FROM (SELECT doc_id, replace(replace(text, '\\', '/'), '"', '''') AS clean, regexp_extract(text, '\\b[0-9]{16}\\b') AS card FROM documents)"""
_JSON_SPANS = checks.spans(_WRAPPED_SQL)
# Pieces of the text between kept findings; secrets of these bodies never overlap personal data.
_JSON_EDITS = f"""SELECT key, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS stop, text AS surface FROM ({_JSON_SPANS}) WHERE quoted AND {checks.severity('label')} >= 2"""


@query(
    f"""SELECT s.key AS doc_id, quoted_findings, bare_findings,
  sha256(list_reduce(coalesce(list_distinct(secret_list), []), lambda acc, x: replace(acc, x, {checks.placeholder('x', SALT)}),
    coalesce(piece, '') || substr(s.text, coalesce(last_stop, 0) + 1))) AS masked_hash
FROM ({_WRAPPED_SQL}) s
LEFT JOIN (SELECT key, string_agg(substr(text, prev + 1, start - prev) || {checks.placeholder('surface', SALT)}, '' ORDER BY start) AS piece, max(stop) AS last_stop FROM (
    SELECT e.key, w.text, e.start, e.stop, e.surface, coalesce(lag(e.stop) OVER (PARTITION BY e.key ORDER BY e.start), 0) AS prev FROM ({_JSON_EDITS}) e JOIN ({_WRAPPED_SQL}) w USING (key)) GROUP BY key) p ON p.key = s.key
LEFT JOIN (SELECT key, list(text) AS secret_list FROM ({checks.secrets(_WRAPPED_SQL)}) GROUP BY key) x ON x.key = s.key
LEFT JOIN (SELECT doc_id AS key, coalesce(q, 0) AS quoted_findings, coalesce(b, 0) AS bare_findings FROM documents LEFT JOIN (
    SELECT key, count(*) FILTER (quoted) AS q, count(*) FILTER (NOT quoted) AS b FROM ({_JSON_SPANS}) GROUP BY key) ON key = doc_id) f ON f.key = s.key"""
)
def json_quoted_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask JSON bodies: only values inside quoted strings are replaced."""
    located = json_bodies(spark, sf_dir).withColumn("located", detect_located("text"))
    done = located.withColumn("r", redact_json_with_spans("text", "located", salt_pads(SALT)))
    bare = unquoted_findings("located").cast("bigint")
    return done.select(
        "doc_id", (F.size("located") - bare).alias("quoted_findings"), bare.alias("bare_findings"),
        F.sha2(F.col("r.text").cast("binary"), 256).alias("masked_hash"),
    )


@query(f"SELECT key AS doc_id, CASE WHEN key % 5 = 0 THEN 'partial_upload' END AS skip_reason, key % 5 <> 0 AND len(surfaces) > 0 AS redacted, CASE WHEN key % 5 <> 0 THEN sha256(masked) END AS masked_hash FROM ({_REDACTED})")
def forwarded_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies as they are forwarded: scanned once, masked unless skipped."""
    part = F.create_map(F.lit("content-range"), F.lit("bytes 0-1/2"))
    requests = uploads(spark, sf_dir).withColumn(
        "headers", F.when(F.col("doc_id") % 5 == 0, F.map_concat("headers", part)).otherwise(F.col("headers"))
    )
    done = forwarded_bodies(inspected(requests), salt_pads(SALT))
    return done.select(
        "doc_id", "skip_reason", F.coalesce("redaction.redacted", F.lit(False)).alias("redacted"),
        F.sha2(F.col("redaction.text").cast("binary"), 256).alias("masked_hash"),
    )


# Agent transcripts.
_BLOCKED = f"""SELECT key, 'The prompt holds a secret or sensitive identifier (' || array_to_string(list_concat(coalesce(ss, []), coalesce(ps, [])), ', ') || '). Remove it and submit again.' AS reason FROM (
SELECT key, list(DISTINCT label ORDER BY label) FILTER (kind = 's') AS ss, list(DISTINCT label ORDER BY label) FILTER (kind = 'p') AS ps FROM (
  SELECT key, label, 's' AS kind FROM ({{secrets}}) UNION ALL SELECT key, label, 'p' FROM ({{spans}}) WHERE {checks.severity('label')} >= 3) GROUP BY key)"""
_PROMPTS = "SELECT 'd' || doc_id AS key, text FROM documents UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations WHERE role = 'user'"


@query(_BLOCKED.format(secrets=checks.secrets(_PROMPTS), spans=checks.spans(_PROMPTS)))
def hook_prompt_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts that must not be sent, with the reason."""
    documents = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("key"), "text")
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select(
        F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("key"), "text"
    )
    judged = F.struct(F.col("key"), prompt_block_reason(F.col("text")).alias("reason"))
    kept = F.explode(let(judged, lambda j: F.when(j["reason"].isNotNull(), F.array(j))))
    return documents.unionByName(turns).select(kept.alias("j")).select("j.*")


_TOOLS = ["Read", "Edit", "Write", "MultiEdit", "NotebookEdit", "Bash", "Grep", None]
_EVENTS = ["PreToolUse", "PostToolUse", "UserPromptSubmit", "SessionStart"]
_RESOLUTIONS = ["not_sensitive", "sensitive", "unresolved"]


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as hook payloads: every event, tool and resolution occurs."""
    key = F.col("doc_id")
    path = F.replace(pick(PATHS, key % len(PATHS)), F.lit("{k}"), key.cast("string"))
    notebook = key % 2 == 1
    response = F.to_json(F.struct(F.array(F.struct(F.col("text").alias("body"), key.alias("n"))).alias("items"), F.lit("done").alias("status")))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("s"), (key % 9).cast("string")).alias("session_id"),
        pick(_EVENTS, F.floor(key / 8) % 4).alias("hook_event_name"),
        pick(_TOOLS, key % 8).alias("tool_name"),
        F.struct(F.when(~notebook, path).alias("file_path"), F.when(notebook, path).alias("notebook_path")).alias("tool_input"),
        response.alias("tool_response"),
        F.col("text").alias("prompt"),
        pick(_RESOLUTIONS, F.floor(key / 3) % 3).alias("resolution"),
    )


_PAYLOADS = f"""SELECT doc_id, text, {pick_sql(_EVENTS, '(doc_id // 8) % 4')} AS event, {pick_sql(_TOOLS, 'doc_id % 8')} AS tool,
  replace({pick_sql(PATHS, f'doc_id % {len(PATHS)}')}, '{{k}}', CAST(doc_id AS VARCHAR)) AS path, {pick_sql(_RESOLUTIONS, '(doc_id // 3) % 3')} AS res FROM documents"""
_SENSITIVE = """CASE WHEN regexp_matches(base, '\\.(example|sample|template|dist)$') THEN FALSE ELSE
  regexp_matches(base, '^\\.env(rc)?$|^\\.env\\.') OR base IN ('.git-credentials', '.netrc', '.npmrc', '.pypirc', 'credentials')
  OR (regexp_matches(base, '^id_(rsa|dsa|ecdsa|ed25519)') AND NOT ends_with(base, '.pub'))
  OR regexp_matches(base, '\\.(pem|key|p12|pfx|keystore|jks|asc)$') OR contains(u, '.aws/credentials') OR contains(u, '.gnupg/') END"""
_HOOKS = f"""SELECT p.*, {_SENSITIVE} AS bad, b.reason AS blocked, len(coalesce(r.surfaces, [])) > 0 AS dirty
FROM (SELECT *, replace(lower(path), '\\', '/') AS u, string_split(replace(lower(path), '\\', '/'), '/')[-1] AS base FROM ({_PAYLOADS})) p
LEFT JOIN ({_BLOCKED.format(secrets=checks.secrets(_DOCS), spans=_SPANS)}) b ON b.key = doc_id
LEFT JOIN ({_REDACTED}) r ON r.key = doc_id"""
_ACTION = """CASE WHEN event = 'PreToolUse' AND tool IN ('Read', 'Edit', 'Write', 'MultiEdit', 'NotebookEdit') AND (bad OR res <> 'not_sensitive') THEN 'deny'
  WHEN event = 'UserPromptSubmit' AND blocked IS NOT NULL THEN 'block' WHEN event = 'PostToolUse' AND tool IN ('Read', 'Bash', 'Grep') AND dirty THEN 'redact' END"""


@query(
    f"""SELECT doc_id, action, CASE action WHEN 'deny' THEN 'Access to `' || path || CASE WHEN bad OR res = 'sensitive' THEN '` is blocked: the path is known to hold credentials or key material.'
    ELSE '` is blocked: the path could not be resolved, so it cannot be checked for links.' END WHEN 'block' THEN blocked END AS reason
FROM (SELECT *, {_ACTION} AS action FROM ({_HOOKS}))"""
)
def hook_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every hook payload; no effect is NULL."""
    return hook_verdicts(transcripts(spark, sf_dir), salt_pads(MACHINE_SECRET)).select("doc_id", "action", "reason")


@query(
    f"""SELECT event, tool, coalesce(action, 'none') AS action, count(*) AS n FROM (SELECT *, {_ACTION} AS action FROM ({_HOOKS})) GROUP BY ALL"""
)
def hook_action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects per event and tool."""
    judged = hook_verdicts(transcripts(spark, sf_dir), salt_pads(MACHINE_SECRET))
    return judged.groupBy(
        F.col("hook_event_name").alias("event"), F.col("tool_name").alias("tool"), F.coalesce("action", F.lit("none")).alias("action")
    ).agg(F.count("*").alias("n"))


@query(
    f"""SELECT doc_id, CAST(len(surfaces) AS BIGINT) AS mapped, CAST(length(text) - list_sum(list_transform(surfaces, lambda s: length(s) * ((length(text) - length(replace(text, s, ''))) // length(s))))
   + list_sum(list_transform(surfaces, lambda s: 39 * ((length(text) - length(replace(text, s, ''))) // length(s)))) AS BIGINT) AS body_chars
FROM (SELECT p.doc_id, r.surfaces, r.text FROM ({_PAYLOADS}) p JOIN ({_REDACTED}) r ON r.key = p.doc_id
  WHERE event = 'PostToolUse' AND tool IN ('Read', 'Bash', 'Grep') AND len(surfaces) > 0)"""
)
def hook_tool_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked tool output: JSON with every string leaf masked."""
    judged = hook_verdicts(transcripts(spark, sf_dir), salt_pads(MACHINE_SECRET))
    body = F.get_json_object("updated_output", "$.items[0].body")
    row = F.struct("doc_id", F.size("mapping").cast("bigint").alias("mapped"), F.length(body).cast("bigint").alias("body_chars"))
    return judged.select(F.explode(F.when(F.col("action") == "redact", F.array(row))).alias("x")).select("x.*")


@query(
    f"SELECT doc_id, array_to_string(list_concat(list_filter(string_split(secret_labels, ','), lambda x: x <> ''), list_filter(string_split(pii_labels, ','), lambda x: x <> '')), ',') AS labels "
    f"FROM (SELECT key AS doc_id, * FROM ({_REDACTED})) WHERE len(surfaces) > 0"
)
def fired_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that fired per masked document, secrets first."""
    outcome = let(
        redact("text", salt_pads(SALT)),
        lambda r: F.when(r["redacted"], F.array(F.struct(F.col("doc_id"), F.array_join(all_labels(r), ",").alias("labels")))),
    )
    return table(spark, sf_dir, "documents").select(F.explode(outcome).alias("x")).select("x.*")


@query(f'SELECT key AS doc_id, label, start, "end" FROM ({_SPANS}) WHERE {checks.severity("label")} >= 2')
def spans_above_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings at or above the masking floor."""
    spans = F.filter(public_spans(detect_located("text")), lambda s: severity_of(s["label"]) >= 2)
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(spans).alias("s")).select(
        "doc_id", "s.label", "s.start", "s.end"
    )
