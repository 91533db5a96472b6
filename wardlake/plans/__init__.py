"""Registered queries, grouped by subject."""

from __future__ import annotations

from wardlake.plans import (  # noqa: F401
    audit_queries,
    benchmark_queries,
    dlp_queries,
    policy_queries,
    source_queries,
    sql_queries,
    streaming_queries,
    tenant_queries,
)
from wardlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
