"""The registered queries: a Spark plan each, and a SQL text for checking it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under its function name, with its check where SQL can express it."""

    def register(plan: Plan) -> Plan:
        name = plan.__name__
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = plan
        if oracle is not None:
            ORACLES[name] = oracle
        return plan

    return register
