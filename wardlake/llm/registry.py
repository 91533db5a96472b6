"""The queries of this subpackage: a Spark plan each, and a SQL text where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under its function name."""

    def register(plan: Plan) -> Plan:
        if plan.__name__ in QUERIES:
            raise ValueError(f"query registered twice: {plan.__name__}")
        QUERIES[plan.__name__] = plan
        if oracle is not None:
            ORACLES[plan.__name__] = oracle
        return plan

    return register
