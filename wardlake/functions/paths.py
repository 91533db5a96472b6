"""Sensitive-path classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlake.constants import (
    SENSITIVE_BASENAMES,
    SENSITIVE_EXTENSIONS,
    SENSITIVE_FRAGMENTS,
    SSH_KEY_PREFIXES,
    TEMPLATE_SUFFIXES,
)
from wardlake.functions.expressions import ColumnLike, as_column, ascii_lower


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def is_sensitive_path(path: ColumnLike) -> Column:
    """Whether a path names credentials or key material, on either separator."""
    unified = F.translate(ascii_lower(as_column(path)), "\\", "/")
    base = F.substring_index(unified, "/", -1)
    is_template = _any([base.endswith(s) for s in TEMPLATE_SUFFIXES])
    is_dotenv = base.isin(".env", ".envrc") | base.startswith(".env.")
    is_ssh_key = _any([base.startswith(p) for p in SSH_KEY_PREFIXES]) & ~base.endswith(".pub")
    is_key_file = _any([base.endswith(e) for e in SENSITIVE_EXTENSIONS])
    in_key_store = _any([unified.contains(f) for f in SENSITIVE_FRAGMENTS])
    sensitive = is_dotenv | base.isin(SENSITIVE_BASENAMES) | is_ssh_key | is_key_file | in_key_store
    return F.when(is_template, False).otherwise(sensitive)
