"""The scalar functions for SQL users, as temporary functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from wardlake.constants import (
    PII_SEVERITY,
    SENSITIVE_BASENAMES,
    SENSITIVE_EXTENSIONS,
    SENSITIVE_FRAGMENTS,
    SSH_KEY_PREFIXES,
    TEMPLATE_SUFFIXES,
)
from wardlake.functions.json_leaves import leaf_table


def _list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _any(template: str, values: list[str]) -> str:
    return "(" + " OR ".join(template.format(v) for v in values) + ")"


_HOST = r"CASE WHEN startswith(target, '[') THEN regexp_extract(target, r'^\[([^\]]*)', 1) ELSE regexp_replace(target, r'(?s):[^:]*\z', '') END"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "translate(" + _LOWER.format("path") + ", '\\\\', '/')"
_BASE = f"substring_index({_PATH}, '/', -1)"
_SEVERITIES = " ".join(f"WHEN '{k}' THEN {v}" for k, v in PII_SEVERITY.items())

# name -> (parameters, result type, body)
SCALARS = {
    "canonical_host": ("target STRING", "STRING", _LOWER.format(f"rtrim('.', {_HOST})")),
    "matches_domain": (
        "pattern STRING, domain STRING",
        "BOOLEAN",
        f"CASE WHEN startswith(pattern, '*.') THEN {_LOWER.format('domain')} = substr({_LOWER.format('pattern')}, 3) "
        f"OR endswith({_LOWER.format('domain')}, substr({_LOWER.format('pattern')}, 2)) "
        f"ELSE {_LOWER.format('domain')} = {_LOWER.format('pattern')} END",
    ),
    "digits_only": ("value STRING", "STRING", "regexp_replace(value, '[^0-9]', '')"),
    "luhn_ok": ("value STRING", "BOOLEAN", "luhn_check(regexp_replace(value, '[^0-9]', ''))"),
    "pii_severity": ("label STRING", "INT", f"CASE label {_SEVERITIES} ELSE 0 END"),
    "is_sensitive_path": (
        "path STRING",
        "BOOLEAN",
        f"CASE WHEN {_any('endswith(' + _BASE + ', {!r})', TEMPLATE_SUFFIXES)} THEN false ELSE "
        f"{_BASE} IN ('.env', '.envrc', {_list(SENSITIVE_BASENAMES)}) OR startswith({_BASE}, '.env.') "
        f"OR ({_any('startswith(' + _BASE + ', {!r})', SSH_KEY_PREFIXES)} AND NOT endswith({_BASE}, '.pub')) "
        f"OR {_any('endswith(' + _BASE + ', {!r})', SENSITIVE_EXTENSIONS)} OR {_any('contains(' + _PATH + ', {!r})', SENSITIVE_FRAGMENTS)} END",
    ),
}


def register(spark: SparkSession) -> None:
    """Create the functions, and the table function `json_string_leaves`."""
    for name, (parameters, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udtf.register("json_string_leaves", leaf_table())
