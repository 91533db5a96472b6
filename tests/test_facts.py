"""Protocol facts, hosts, bodies, paths, and descriptions."""

from __future__ import annotations

import random
import struct

from conftest import results, texts
from pyspark.sql import functions as F

from wardlake.functions import bodies, hosts, summaries
from wardlake.functions.kube import k8s_facts
from wardlake.functions.paths import is_sensitive_path
from wardlake.functions.sqlfacts import postgres_facts, sql_facts
from wardlake.schemas import FACTS_TYPE


def test_hosts(spark):
    cases = {
        "github.com:443": ("github.com", "github.com"), "[::1]:443": ("::1", "::1"), "nohost": ("nohost", "nohost"),
        "github.com.:443": ("github.com.", "github.com"), "API.Example.COM:8443": ("API.Example.COM", "api.example.com"),
        "a.b..": ("a.b..", "a.b"), "": ("", ""),
    }
    df = texts(spark, list(cases)).select("i", hosts.host_of("t").alias("h"), hosts.canonical_host("t").alias("c"))
    assert list(zip(results(df, "h"), results(df, "c"))) == list(cases.values())


def test_request_host(spark):
    cases = [
        ("http://User@GitHub.com:80/x", {"host": "other.test"}, "github.com"), ("/submit", {"host": "Api.Test.:8080"}, "api.test"),
        ("/submit", {}, ""), ("https://[2001:DB8::1]:443/", {}, "[2001:db8::1]"), ("/a", None, ""),
    ]
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(cases)], "i int, u string, h map<string,string>")
    assert results(df.select("i", hosts.request_host("u", "h").alias("r")), "r") == [want for *_, want in cases]


def test_domain_patterns(spark):
    cases = [
        ("GitHub.com", "github.com", True), ("*.GH.io", "raw.gh.io", True), ("*.gh.io", "gh.io", True),
        ("*.gh.io", "xgh.io", False), ("gh.io", "raw.gh.io", False),
    ]
    df = spark.createDataFrame([(i, p, d) for i, (p, d, _) in enumerate(cases)], "i int, p string, d string")
    assert results(df.select("i", hosts.matches_domain("p", "d").alias("m")), "m") == [want for *_, want in cases]
    for pattern, domain, want in cases:
        assert df.select(hosts.in_domain_list(F.lit(domain), [pattern])).first()[0] is want
    assert df.select(hosts.in_domain_list(F.lit(None).cast("string"), ["a"])).first()[0] is False


SQL = [
    ("DROP TABLE IF EXISTS users", "DROP", "users"), ("DROP MATERIALIZED VIEW mv", "DROP", "mv"),
    ("TRUNCATE ONLY accounts", "TRUNCATE", "accounts"), ("DROP INDEX CONCURRENTLY idx_a", "DROP", "idx_a"),
    ('delete from "Sessions"', "DELETE", "sessions"), ("INSERT INTO logs (a) VALUES (1)", "INSERT", "logs"),
    ("update Users set x=1", "UPDATE", "users"), ("SELECT * FROM public.orders WHERE id = 1", "SELECT", "orders"),
    ("SELECT 1", "SELECT", ""), ("", "", ""), ("  \n ", "", ""), ("select 1 from", "SELECT", ""), ("ALTER TABLE x", "ALTER", ""),
    ("DROP TABLE `a`.`B`;", "DROP", "b"), ("DROP TABLE", "DROP", ""), ("update", "UPDATE", ""),
]


def test_sql_facts(spark):
    df = texts(spark, [q for q, *_ in SQL]).select("i", sql_facts("t").alias("f"))
    assert [(f.verb, f.table) for f in results(df, "f")] == [(v, t) for _, v, t in SQL]
    assert spark.range(1).select(sql_facts(F.lit(None).cast("string"))).first()[0] is None


def _frame(text: bytes, tag=b"Q", extra=0, end=b"\0"):
    return tag + struct.pack(">I", len(text) + 4 + len(end) + extra) + text + end


def test_postgres_frames(spark):
    good = _frame(b"DROP TABLE users;")
    frames = [
        good, good + b"x", _frame(b"SELECT 1", end=b""), _frame(b"SELECT 1", extra=5), _frame(b"SELECT 1", tag=b"X"), b"Q", b"",
        _frame(b"\xff\xfe"), _frame(b""), b"Q\0\0\0\x04",
    ]
    df = spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(frames)], "i int, p binary")
    got = results(df.select("i", postgres_facts("p").alias("f")), "f")
    assert (got[0].verb, got[0].table) == ("DROP", "users")
    assert got[1:8] == [None] * 7
    assert (got[8].verb, got[8].table) == ("", "")
    assert got[9] is None


def test_k8s(spark):
    cases = [
        ("GET", "/apis/apps/v1/deployments/api", ("get", "deployments", "")), ("GET", "/api/v1/namespaces", ("list", "namespaces", "")),
        ("DELETE", "/api/v1/namespaces/prod", ("delete", "namespaces", "")),
        ("PATCH", "/apis/apps/v1/namespaces/staging/deployments/api", ("patch", "deployments", "staging")),
        ("GET", "/api/v1/nodes", ("list", "nodes", "")), ("delete", "/api/v1/namespaces/Prod/Secrets/db?x=/y", ("delete", "secrets", "prod")),
        ("HEAD", "/", ("", "", "")), ("POST", "/api", ("create", "", "")),
    ]
    df = spark.createDataFrame([(i, m, p) for i, (m, p, _) in enumerate(cases)], "i int, m string, p string")
    got = results(df.select("i", k8s_facts("m", "p").alias("f")), "f")
    assert [tuple(f) for f in got] == [want for *_, want in cases]


def _prefix(b: bytes):
    try:
        return b.decode()
    except UnicodeDecodeError as e:
        return b[: e.start].decode() if e.reason == "unexpected end of data" else None


def test_inspectable_text_against_decoder(spark):
    rng = random.Random(3)
    base = "aé한😀z".encode()
    cases = [base[:n] for n in range(len(base) + 1)] + [b"ab\xffcd", b"\xff", b"ab\xc3", b"\xe0\x80", b"\xed\xa0", b"\xf4\x90", b"\xf5", b"a\xf0\x9f\x98"]
    cases += [bytes(rng.choice([0x61, 0xC3, 0xE0, 0xA0, 0xED, 0x80, 0xF0, 0x90, 0xF4, 0x8F, 0xBF]) for _ in range(rng.randrange(1, 6))) for _ in range(400)]
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, b binary")
    assert results(df.select("i", bodies.inspectable_text("b").alias("t")), "t") == [_prefix(c) for c in cases]


def test_body_limits(spark):
    limit = 1_000
    rows = [(0, 10, None), (1, 10, 10), (2, 10, limit + 1), (3, limit + 1, None), (4, limit, limit), (5, limit + 1, 7), (6, None, limit + 1)]
    df = spark.createDataFrame(rows, "i int, size int, declared bigint").withColumn("body", F.repeat(F.lit("x"), F.col("size")).cast("binary"))
    df = df.select("i", *(f("body", "declared", n).alias(c) for c, f, n in (
        ("s", bodies.body_size, limit), ("ok", bodies.is_scannable, limit), ("all", bodies.body_size, None), ("any", bodies.is_scannable, None))))
    assert results(df, "s") == [10, 10, 10, -1, limit, 7, limit + 1]
    assert results(df, "ok") == [True, True, True, False, True, False, False]
    assert results(df, "all") == [10, 10, 10, limit + 1, limit, limit + 1, limit + 1] and all(results(df, "any"))


PATHS = {
    "/project/.env.local": True, "/keys/server.pem": True, "/home/u/.ssh/id_rsa.backup": True, "/home/u/.ssh/id_rsa_backup": True,
    "/home/u/.ssh/id_ed25519_old": True, "/home/u/.ssh/id_rsa.pub": False, "/home/u/.gnupg/secring.gpg": True,
    r"C:\Users\me\.gnupg\secring.gpg": True, ".aws/credentials": True, ".env": True, ".envrc": True, ".env.example": False,
    "src/main.py": False, "key.pem.sample": False, "": False, "/etc/CREDENTIALS": True, ".environment": False,
}


def test_sensitive_paths(spark):
    df = texts(spark, list(PATHS)).select("i", is_sensitive_path("t").alias("s"))
    assert results(df, "s") == list(PATHS.values())


def test_descriptions(spark):
    rows = [
        ({"sql": {"verb": "DROP", "table": "users"}, "domain": "d"}, "SQL DROP users"), ({"sql": {"verb": "X", "table": ""}}, "SQL X"),
        ({"k8s": {"verb": "get", "resource": "pods", "namespace": "a"}}, "k8s get pods in a"),
        ({"http": {"method": "GET", "host": "h", "path": "/p", "body_size": 1}}, "GET h/p"),
        ({"http": {"method": "", "host": "h", "path": "", "body_size": 0}, "domain": "d"}, "d"), ({"endpoint": "e"}, "e"), ({}, "—"),
    ]
    df = spark.createDataFrame([(i, f) for i, (f, _) in enumerate(rows)], f"i int, f {FACTS_TYPE}")
    assert results(df.select("i", summaries.describe_facts("f").alias("d")), "d") == [want for _, want in rows]


def test_times(spark):
    df = texts(spark, ["2026-01-02T03:04:05Z", "soon"]).select("i", summaries.time_of_day("t").alias("x"))
    assert results(df, "x") == ["03:04:05", "soon"]
    assert spark.sql("SELECT timestamp'2026-01-02 03:04:05.5' AS t").select(summaries.rfc3339("t")).first()[0] == "2026-01-02T03:04:05.500000Z"


def test_instants_of_any_year_and_zone(spark):
    """Years beyond 9999 have no sign, and a session's gaps in summer time move nothing."""
    micros = {
        0: "1970-01-01T00:00:00.000000Z", -1: "1969-12-31T23:59:59.999999Z", 2_940_000 * 86_399_000_001: "10019-05-09T23:20:02.940000Z",
        5_999_999 * 86_399_000_001: "18397-04-01T13:20:06.999999Z", 1_773_023_400_000_005: "2026-03-09T02:30:00.000005Z", 1_772_937_000_000_000: "2026-03-08T02:30:00.000000Z",
    }
    df = spark.createDataFrame([(m,) for m in micros] + [(None,)], "m bigint")
    zone = spark.conf.get("spark.sql.session.timeZone")
    for other in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", other)
        try:
            got = {r.m: r.x for r in df.select("m", summaries.rfc3339(F.timestamp_micros("m")).alias("x")).collect()}
        finally:
            spark.conf.set("spark.sql.session.timeZone", zone)
        assert got == {**micros, None: None}
