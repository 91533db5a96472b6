"""Row schemas of every table the library reads or writes, as DDL text."""

from __future__ import annotations

from wardlake.functions.pii import SPAN_TYPE, SUMMARY_TYPE

HTTP_TYPE = "struct<method:string,host:string,path:string,body_size:bigint>"
SQL_TYPE = "struct<verb:string,table:string>"
K8S_TYPE = "struct<verb:string,resource:string,namespace:string>"
PII_TYPE = SUMMARY_TYPE
FACTS_TYPE = (
    f"struct<domain:string,endpoint:string,http:{HTTP_TYPE},sql:{SQL_TYPE},k8s:{K8S_TYPE},pii:{PII_TYPE}>"
)
FACT_COLUMNS = {
    "domain": "string",
    "endpoint": "string",
    "http": HTTP_TYPE,
    "sql": SQL_TYPE,
    "k8s": K8S_TYPE,
    "pii": PII_TYPE,
}


AUDIT_SCHEMA = (
    f"id bigint, timestamp timestamp, decision string, verdict string, rule string, "
    f"facts {FACTS_TYPE}, approval_id bigint"
)
REQUEST_SCHEMA = (
    "ts timestamp, client string, is_connect boolean, method string, uri string, "
    "headers map<string,string>, endpoint string, content_length bigint, body binary"
)
FRAME_SCHEMA = "ts timestamp, endpoint string, packet binary"
# A hook payload; its tool response has any shape and is read apart.
PAYLOAD_SCHEMA = (
    "session_id string, hook_event_name string, tool_name string, "
    "tool_input struct<file_path:string,notebook_path:string>, prompt string, cwd string, resolution string"
)
RULE_SCHEMA = "pos int, name string, endpoint string, condition string, verdict string"
EGRESS_SCHEMA = "kind string, pattern string"
MAPPING_SCHEMA = "salt_id string, placeholder string, secret string, last_seq bigint"
CHUNK_SCHEMA = "stream_id string, seq bigint, chunk binary, is_last boolean"
META_TYPE = "struct<split:string,difficulty:string,domain:string>"
EVAL_SCHEMA = (
    f"id string, source string, surface string, lang string, text string, "
    f"spans array<{SPAN_TYPE}>, meta {META_TYPE}"
)
LABEL_SCHEMA = (
    "key string, tier int, severity string, method string, default_action string, ref_f1 double"
)
LABEL_MAP_SCHEMA = "source string, code string, key string"
KDPII_SCHEMA = (
    "sent_idx string, sentence string, "
    "PII_set array<struct<form:string,label:string,begin:bigint,end:bigint>>"
)

RECORD_COLUMNS = ["id", "source", "surface", "lang", "text", "spans", "meta"]
MAPPING_COLUMNS = ["salt_id", "placeholder", "secret", "last_seq"]
TRANSCRIPT_COLUMNS = [
    "session_id", "hook_event_name", "tool_name", "tool_input", "tool_response", "prompt", "cwd", "resolution",
]
