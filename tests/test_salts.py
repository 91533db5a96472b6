"""Salts as tables against the derivation of one salt."""

from __future__ import annotations

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from wardlake.functions.masking import pad_bytes, placeholder
from wardlake.operators.salts import read_machines, session_salts, with_pads, write_machines

MACHINES = {"a": b"machine secret of a", "b": b"b" * 100}
ROWS = [(1, "a", "s1"), (2, "a", "s1"), (3, "b", "s1"), (4, "a", None), (5, "a", ""), (6, "b", "세션")]


def mint(secret, machine, session):
    salt = hmac.new(MACHINES[machine], (session or "").encode(), hashlib.sha256).digest()
    return f"<<hs:{hmac.new(salt, secret.encode(), hashlib.sha256).hexdigest()[:32]}>>"


def test_placeholders_by_table(spark, tmp_path):
    path = str(tmp_path / "machines")
    write_machines(spark, MACHINES, path)
    rows = spark.createDataFrame(ROWS, "i int, machine_id string, session_id string")
    salts = session_salts(rows, read_machines(spark, path))
    assert salts.count() == 4
    out = with_pads(rows, salts).select("i", placeholder(F.lit("secret"), F.col("pads")).alias("p"))
    assert {r.i: r.p for r in out.collect()} == {i: mint("secret", m, s) for i, m, s in ROWS}
    plan = out._jdf.queryExecution().toString().lower()
    for secret in MACHINES.values():
        for pad in pad_bytes(secret):
            assert pad.hex()[:16] not in plan and secret.decode() not in plan
    lost = spark.createDataFrame([(1, "unknown", "s")], "i int, machine_id string, session_id string")
    with pytest.raises(Exception, match="no salt for session"):
        with_pads(lost, salts).collect()
