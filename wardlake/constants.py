"""Names, limits, word lists and patterns that results depend on."""

from __future__ import annotations

# Verdicts and audit decisions.
VERDICTS = ["allow", "deny", "pause"]
DECISIONS = ["allowed", "denied", "paused", "approved", "rejected"]

# Limits.
HOLD_TIMEOUT_SECONDS = 300
AUDIT_RING_CAPACITY = 1024
DEFAULT_AUDIT_LIMIT = 200
REDACTION_SEVERITY_FLOOR = 2
BLOCKING_SEVERITY = 3
PERSON_MIN_LENGTH = 3

# The placeholder format, prefix + 32 hex digits + suffix.
PLACEHOLDER_PREFIX = "<<hs:"
PLACEHOLDER_SUFFIX = ">>"
PLACEHOLDER_HEX_DIGITS = 32
PLACEHOLDER_PATTERN = "<<hs:[0-9a-f]{32}>>"

# Words skipped before the relation name of DROP / TRUNCATE.
SQL_OBJECT_WORDS = [
    "table", "view", "materialized", "index", "sequence", "schema", "database",
    "if", "exists", "concurrently", "only",
]

# PII labels in detector order, with severity.
PII_SEVERITY = {
    "RRN": 3,
    "FRN": 3,
    "BUSINESS_REG_NO": 3,
    "CREDIT_CARD": 3,
    "EMAIL": 2,
    "IP": 1,
    "PHONE": 2,
}

# Checksum weights of resident and business registration numbers.
RRN_WEIGHTS = [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5]
BRN_WEIGHTS = [1, 3, 7, 1, 3, 7, 1, 3, 5]

# Korean carrier, area and service prefixes.
PHONE_PREFIXES = [
    "010", "011", "016", "017", "018", "019",
    "02", "031", "032", "033", "041", "042", "043", "044", "051", "052", "053", "054", "055",
    "061", "062", "063", "064",
    "070", "080",
]

# Sensitive-path rules.
TEMPLATE_SUFFIXES = [".example", ".sample", ".template", ".dist"]
SENSITIVE_BASENAMES = [".git-credentials", ".netrc", ".npmrc", ".pypirc", "credentials"]
SSH_KEY_PREFIXES = ["id_rsa", "id_dsa", "id_ecdsa", "id_ed25519"]
SENSITIVE_EXTENSIONS = [".pem", ".key", ".p12", ".pfx", ".keystore", ".jks", ".asc"]
SENSITIVE_FRAGMENTS = [".aws/credentials", ".gnupg/"]

# Agent tools by hook stage.
FILE_TOOLS = ["Read", "Edit", "Write", "MultiEdit", "NotebookEdit"]
OUTPUT_TOOLS = ["Read", "Bash", "Grep"]

# Evaluation-record enumerations and gate thresholds.
SURFACES = ["prose", "http-json", "http-form", "url-query", "sql", "header"]
LANGUAGES = ["ko", "en"]
SPLITS = ["dev", "test"]
DIFFICULTIES = ["easy", "medium", "hard"]
TIERS = [1, 2, 3]
GATED_LABELS = ["RRN", "CREDIT_CARD", "PHONE", "EMAIL", "IP"]
GATE_MICRO_F1 = 0.98
GATE_LABEL_F1 = 0.90
GATE_LABEL_PRECISION = 0.99
NEGATIVE_FP_BUDGET = 5

# Record sources of the evaluation sets; the generated ones carry our own names.
EVAL_SOURCES = ["kdpii", "ko-pii-synth", "synthetic", "hard-negative"]
