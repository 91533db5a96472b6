"""Streams: re-cut chunks, holds, verdicts, and the mapping store."""

from __future__ import annotations

import random
import re
import struct
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from test_masking import CORPUS, leftmost_longest, mint

from wardlake.runtime import use_state_store
from wardlake.schemas import CHUNK_SCHEMA, MAPPING_SCHEMA
from wardlake.streaming import chunks, holds, mapping_store, responses, verdicts

PATTERN = re.compile(r"<<hs:[0-9a-f]{32}>>")


def feed(pieces):
    """Run pieces through `cut`; returns the emitted parts and whether text survived."""
    carry, is_text, out = b"", True, []
    for n, piece in enumerate(pieces):
        last = n == len(pieces) - 1
        if is_text:
            emit, carry, is_text = chunks.cut(carry, piece, last)
            assert len(carry) <= 41
        else:
            emit = piece
        out.append((emit, is_text))
    return out


def partitions(data):
    for i in range(len(data) + 1):
        yield [data[:i], data[i:]]
    n = len(data)
    yield [data[: n // 4], data[n // 4 : n // 2], data[n // 2 : 3 * n // 4], data[3 * n // 4 :]]
    yield [data[i : i + 1] for i in range(n)] or [b""]


@pytest.mark.parametrize("case", range(len(CORPUS)))
def test_every_split_keeps_placeholders_whole(case):
    surfaces, text = CORPUS[case]
    masked = leftmost_longest(text, surfaces).encode()
    whole = PATTERN.findall(masked.decode())
    for pieces in partitions(masked):
        parts = feed(pieces)
        assert b"".join(p for p, _ in parts) == masked
        assert all(ok for _, ok in parts)
        assert [m for p, _ in parts for m in PATTERN.findall(p.decode())] == whole


def test_false_starts_are_not_held_forever():
    token = mint("x").encode()
    for data in (b"<<hs:" * 50, b"<<hs:zz" + token, b"<" + token, b"<<hs:" + token, token[:-1] + b"x", b"<<hs:0123", b"a<<h" + "é".encode() + token):
        for pieces in partitions(data):
            parts = feed(pieces)
            assert b"".join(p for p, _ in parts) == data
            assert [m for p, _ in parts for m in PATTERN.findall(p.decode())] == PATTERN.findall(data.decode())


def test_invalid_bytes_switch_to_passthrough():
    token = mint("x").encode()
    parts = feed([b"ok " + token, b"<<hs:1", b"\xff" + token, token])
    assert parts == [(b"ok " + token, True), (b"", True), (b"<<hs:1\xff" + token, False), (token, False)]
    assert feed([b"a\xe2\x82", b"\xac"]) == [(b"a", True), ("€".encode(), True)]
    assert feed([b"a\xe2\x82"]) == [(b"a\xe2\x82", True)]


def drain(stream, sink, tmp_path):
    writer = stream.writeStream.format("parquet").option("path", str(tmp_path / sink)).option("checkpointLocation", str(tmp_path / f"{sink}-c"))
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def test_out_of_order_chunks_over_several_batches(spark, tmp_path):
    use_state_store(spark)
    secret = "sk-a-secret"
    streams = {f"s{k}": (f"{'é' * k} before {mint(secret)} after {mint('other')} {mint(secret)}").encode() for k in range(4)}
    rows = []
    for name, data in streams.items():
        pieces = [data[i : i + 10] for i in range(0, len(data), 10)]
        rows += [(name, i, bytearray(p), i == len(pieces) - 1) for i, p in enumerate(pieces)]
    source = str(tmp_path / "in")
    # Later chunks first, and the rest in a second batch.
    spark.createDataFrame([r for r in rows if r[1] % 3 == 2], CHUNK_SCHEMA).coalesce(1).write.parquet(source)
    mapping = spark.createDataFrame([("salt", mint(secret), secret, 0)], MAPPING_SCHEMA)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        stream = spark.readStream.schema(CHUNK_SCHEMA).parquet(source)
        chunks.restore_to(stream, lambda: mapping, "salt", out, checkpoint).trigger(availableNow=True).start().awaitTermination()

    run()
    spark.createDataFrame([r for r in rows if r[1] % 3 != 2], CHUNK_SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run()
    got = {}
    for r in spark.read.parquet(out).orderBy("stream_id", "seq").collect():
        got[r.stream_id] = got.get(r.stream_id, b"") + bytes(r.chunk)
    assert got == {name: data.replace(mint(secret).encode(), secret.encode()) for name, data in streams.items()}


def test_responses_by_class_over_several_batches(spark, tmp_path):
    """Chunks before their heads, heads before their chunks, and chunks without any."""
    use_state_store(spark)
    secret, began = "sk-a-secret", datetime(2024, 5, 1)
    body = (f"a {mint(secret)} b " * 3).encode()
    classes = {
        "ok": (200, None, "salt", None), "named": (404, " Identity ", "salt", None), "zip": (200, "gzip", "salt", "encoded"), "part": (206, None, "salt", "partial_content"),
        "old": (304, "gzip", "salt", "not_modified"), "none": (204, None, "salt", "no_content"), "info": (103, None, "salt", "informational"),
        "other": (200, "", "unused", "nothing_to_restore"), "bytes": (200, None, "salt", None),
    }
    data = {name: (b"\xff" if name == "bytes" else b"") + body for name in classes}
    pieces = [(name, began + timedelta(seconds=i // 10), i // 10, bytearray(d[i : i + 10]), i + 10 >= len(d)) for name, d in {**data, "lost": body}.items() for i in range(0, len(d), 10)]
    heads = [(name, began, status, encoding, salt) for name, (status, encoding, salt, _) in classes.items()]
    chunk_schema = "stream_id string, ts timestamp, seq bigint, chunk binary, is_last boolean"
    mapping = spark.createDataFrame([("salt", mint(secret), secret, 0)], MAPPING_SCHEMA)
    folder = str(tmp_path)

    def add(what, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{what}")

    def run():
        chunk = spark.readStream.schema(chunk_schema).parquet(f"{folder}/chunks")
        head = spark.readStream.schema(responses.HEAD_SCHEMA).parquet(f"{folder}/heads")
        matched = responses.with_heads(chunk, head, "1 hour", "1 hour", 600)
        responses.restore_responses_to(matched, lambda: mapping, f"{folder}/out", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    add("chunks", [p for p in pieces if p[2] % 2], chunk_schema)
    add("heads", heads[::2], responses.HEAD_SCHEMA)
    run()
    add("chunks", [p for p in pieces if not p[2] % 2], chunk_schema)
    add("heads", heads[1::2], responses.HEAD_SCHEMA)
    run()
    got, reasons = {}, {}
    for r in spark.read.parquet(f"{folder}/out").orderBy("stream_id", "seq").collect():
        got[r.stream_id] = got.get(r.stream_id, b"") + bytes(r.chunk)
        reasons.setdefault(r.stream_id, set()).add(r.skip_reason)
    assert reasons == {name: {c[3]} for name, c in classes.items()}
    restored = body.replace(mint(secret).encode(), secret.encode())
    assert got == {name: restored if name in ("ok", "named") else data[name] for name in classes}


def simulate(rows, cap, timeout_ms, end_ms):
    """The approval queue as a loop over one gateway."""
    out, open_holds = [], {}

    def expire(now):
        for approval, (request, deadline) in sorted(open_holds.items(), key=lambda x: x[1][1]):
            if deadline <= now:
                del open_holds[approval]
                out.append((deadline, request, "rejected", "timeout", approval))

    for ms, seq, kind, request in sorted(rows):
        expire(ms - 1)
        if kind == "pause":
            if cap is not None and len(open_holds) >= cap:
                out.append((ms, request, "rejected", "full", None))
            else:
                open_holds[seq] = (request, ms + timeout_ms)
                out.append((ms, request, "paused", "hold", seq))
            continue
        for approval in [a for a, (r, _) in open_holds.items() if r == request]:
            del open_holds[approval]
            out.append((ms, request, {"approve": "approved"}.get(kind, "rejected"), kind, approval))
    expire(end_ms)
    return sorted(out, key=str)


@pytest.mark.parametrize("late", [False, True])
@pytest.mark.parametrize("cap", [1, 3, None])
def test_holds_against_a_loop(spark, tmp_path, cap, late):
    import random

    use_state_store(spark)
    rng = random.Random(cap or 0)
    base = datetime(2026, 1, 1)
    rows = []
    for i in range(150):
        kind = rng.choice(["pause", "pause", "approve", "reject", "disconnect"])
        # Some requests pause again; some are resolved before they pause.
        request = i - i % 3 if kind == "pause" else rng.randrange(max(0, i - 8), i + 3)
        rows.append((f"g{i % 2}", base + timedelta(seconds=20 * i), i, kind, request))
    source = str(tmp_path / "in")
    schema = holds.HOLD_INPUT_SCHEMA
    # Within the lateness, a resolution may be read batches before its pause.
    parts = (rows[2:70:3], rows[1:70:3] + rows[0:70:3], rows[70:]) if late else (rows[:70], rows[70:])
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    drain(holds.hold_events(stream, max_pending=cap, timeout_seconds=300, lateness="30 minutes" if late else "0 seconds"), "out", tmp_path)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    epoch = int(base.timestamp()) * 1000
    end = max(epoch + 20000 * r[2] for r in rows) - (1_800_000 if late else 0)
    for gateway in ("g0", "g1"):
        mine = [(epoch + 20000 * seq, seq, kind, request) for g, _, seq, kind, request in rows if g == gateway and epoch + 20000 * seq <= end]
        want = simulate(mine, cap, 300_000, end)
        assert sorted([(r.at_ms, r.request_id, r.decision, r.cause, r.approval_id) for r in got if r.gateway == gateway], key=str) == want


def hold_rows(seed, count, seconds, gateways=("g0", "g1")):
    import random

    rng = random.Random(seed)
    rows = []
    for i in range(count):
        kind = rng.choice(["pause", "pause", "approve", "reject", "disconnect"])
        request = i - i % 3 if kind == "pause" else rng.randrange(max(0, i - 8), i + 3)
        rows.append((rng.choice(gateways), datetime(2026, 1, 1) + timedelta(seconds=seconds * i), i, kind, request))
    return rows


def outcomes_of(rows, cap, timeout_ms):
    """Of all gateways, up to the last event."""
    ms = lambda t: int(t.timestamp()) * 1000
    end = max(ms(r[1]) for r in rows)
    return sorted(
        ((g, *o) for g in {r[0] for r in rows} for o in simulate([(ms(t), q, k, r) for h, t, q, k, r in rows if h == g], cap, timeout_ms, end)), key=str
    )


@pytest.mark.parametrize("cap", [2, None])
def test_restart_from_what_was_left_open(spark, tmp_path, cap):
    """A job that begins with the holds of an earlier one's output goes on as one job would; its state shows what is open."""
    use_state_store(spark)
    rows = hold_rows(21, 160, 40)
    first, second = rows[:90], rows[90:]
    spark.createDataFrame(first, holds.HOLD_INPUT_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "first"))
    spark.createDataFrame(second, holds.HOLD_INPUT_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "second"))

    def run(source, **begin):
        stream = spark.readStream.schema(holds.HOLD_INPUT_SCHEMA).parquet(str(tmp_path / source))
        drain(holds.hold_events(stream, "0 seconds", max_pending=cap, timeout_seconds=300, parts=4, bucket_seconds=60, **begin), f"out-{source}", tmp_path)
        return spark.read.parquet(str(tmp_path / f"out-{source}"))

    before = run("first")
    left = holds.left_open(before, 300)
    assert left.count() > 1
    state = holds.open_in_state(spark, str(tmp_path / "out-first-c"))
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, left.collect()))
    one = left.first().approval_id
    assert [r.approval_id for r in state.where(F.col("approval_id") == one).collect()] == [one]
    spark.createDataFrame(left.collect(), left.schema).write.parquet(str(tmp_path / "left"))
    after = run("second", open_holds=spark.read.parquet(str(tmp_path / "left")))
    got = sorted(map(tuple, before.unionByName(after).collect()), key=str)
    assert got == outcomes_of(rows, cap, 300_000)


def test_a_timer_reads_the_due_buckets_only():
    """A backlog of other buckets is not touched."""

    class Map(dict):
        read = 0

        def getValue(self, key):
            Map.read += 1
            return self[key]

        def updateValue(self, key, value):
            self[key] = value

        removeKey = dict.pop
        containsKey = dict.__contains__

    class Value:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

    class Handle:
        timers: list[int] = []

        def getMapState(self, *_):
            return Map()

        def getValueState(self, *_):
            return Value()

        def registerTimer(self, at):
            self.timers.append(at)

    class Now:
        def getCurrentWatermarkInMs(self):
            return 120_000

        def getExpiryTimeInMs(self):
            return 0

    from pyspark.sql import Row

    registry = holds.HoldRegistry(None, 300, 60)
    registry.init(Handle())
    backlog = 50_000
    list(registry.handleInputRows(("g",), (Row(at_ms=60_000 * (i % 500), seq=i, kind="pause", request_id=i) for i in range(backlog)), None))
    Map.read = 0
    done = list(registry.handleExpiredTimer(("g",), Now(), Now()))
    assert len(done) == 3 * backlog // 500 and Map.read <= 6
    assert Handle.timers[-1] == 180_000


def test_mapping_store_batches(spark, tmp_path):
    path = str(tmp_path)
    batches = [[("a", "11", 0), ("b", "22", 1)], [("c", "33", 2), ("a", "11", 3)], [("d", "4" * 100, 4)], [("e", "55", 5)]]
    kept = []
    for version, batch in enumerate(batches):
        df = spark.createDataFrame([("s", *row) for row in batch], MAPPING_SCHEMA)
        mapping_store.record_batch(df, version, path, max_entries=2, max_bytes=50)
        # A retried batch changes nothing.
        mapping_store.record_batch(df, version, path, max_entries=2, max_bytes=50)
        kept.append({r.placeholder for r in mapping_store.read_store(spark, path, version).collect()})
    assert kept == [{"a", "b"}, {"a", "c"}, set(), {"e"}]
    assert len(list((tmp_path / "store").iterdir())) == 2
    metrics = {r.version: (r.entries, r.evicted) for r in mapping_store.read_metrics(spark, path).collect()}
    assert metrics == {0: (2, 0), 1: (2, 1), 2: (0, 3), 3: (1, 0)}
    assert [r.placeholder for r in mapping_store.latest_store(spark, path).collect()] == ["e"]


def test_deduplication(spark, tmp_path):
    rows = [("l", 1, datetime(2026, 1, 1)), ("l", 1, datetime(2026, 1, 1)), ("l", 1, datetime(2026, 1, 1, 0, 1)), ("m", 1, datetime(2026, 1, 1))]
    schema = "log_id string, id bigint, timestamp timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    drain(verdicts.deduplicated(stream), "out", tmp_path)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_rolling_counts_batch_equals_stream_plan(spark):
    rows = [("denied", datetime(2026, 1, 1, 0, 0, s)) for s in (1, 59)] + [("denied", datetime(2026, 1, 1, 0, 1))]
    df = spark.createDataFrame(rows, "decision string, timestamp timestamp")
    counts = verdicts.rolling_counts(df).orderBy("window_start").select(F.col("n")).collect()
    assert [r.n for r in counts] == [2, 1]


def test_holds_pass_in_parts(spark, tmp_path, monkeypatch):
    """Neither the events of a group nor its outcomes are ever one list; ids beyond 2^53 and null ones stay."""
    import inspect

    from pyspark.sql import Row

    read, kept = [], []

    class Waiting:
        def index(self):
            return {}

        def add(self, index, rows):
            kept.append((len(rows), len(read)))

        def keep(self, index):
            pass

    class Handle:
        def registerTimer(self, at):
            assert at == 0

    def rows(n):
        for i in range(n):
            read.append(i)
            yield Row(at_ms=(i + 5) % 11, seq=i, kind="pause", request_id=i)

    registry = holds.HoldRegistry(1, 300, 60)
    registry._waiting, registry._handle = Waiting(), Handle()
    monkeypatch.setattr(holds, "_ROWS_IN_MEMORY", 40)
    list(registry.handleInputRows(("g",), rows(100), None))
    assert kept == [(40, 40), (40, 80), (20, 100)]

    monkeypatch.setattr(holds, "_OUTCOMES_AT_ONCE", 4)
    monkeypatch.setattr(holds.HoldRegistry, "handleExpiredTimer", lambda self, *_: (self._event(("g",), i, i, "rejected", "full", None) for i in range(10)))
    frames = holds._FramedHolds(1, 300, 60).handleExpiredTimer(("g",), None, None)
    assert inspect.isgenerator(frames) and [len(f) for f in frames] == [4, 4, 2]
    monkeypatch.undo()

    use_state_store(spark)
    base, big = datetime(2026, 1, 1), 2**60 + 1
    events = [("g", base, big, "pause", big), ("g", base + timedelta(seconds=1), big + 2, "pause", None), ("g", base + timedelta(seconds=2), big + 4, "approve", big), ("g", base + timedelta(seconds=900), 1, "approve", 5)]
    spark.createDataFrame(events, holds.HOLD_INPUT_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    drain(holds.hold_events(spark.readStream.schema(holds.HOLD_INPUT_SCHEMA).parquet(str(tmp_path / "in")), "0 seconds", max_pending=1, timeout_seconds=300), "out", tmp_path)
    got = sorted((r.at_ms, r.request_id, r.cause, r.approval_id) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    start = int(base.timestamp()) * 1000
    assert got == [(start, big, "hold", big), (start + 1000, None, "full", None), (start + 2000, big, "approve", big)]


def test_a_stream_within_a_batch_asks_the_state_twice():
    """Every call to the state is a round trip, and most streams come whole in one batch."""
    from pyspark.sql import Row

    calls = []

    class State:
        def __init__(self, name):
            self._name = name

        def __getattr__(self, method):
            return lambda *_: calls.append((self._name, method))

    class Handle:
        def getValueState(self, name, *_):
            return State(name)

        getMapState = getValueState

    recutter = chunks.ChunkRecutter(None)
    recutter.init(Handle())
    rows = [Row(stream_id="s", seq=i, chunk=bytearray(b"abc"), is_last=i == 4) for i in (4, 3, 2, 1, 0)]
    assert [(r.seq, r.chunk) for r in recutter.handleInputRows(("s",), iter(rows), None)] == [(i, b"abc") for i in range(5)]
    assert calls == [("position", "get"), ("position", "update")]


class ValueState:
    def __init__(self):
        self.value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class MapState(dict):
    def exists(self):
        return bool(self)

    containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.__delitem__

    def keys(self):
        return iter(list(dict.keys(self)))

    def iterator(self):
        return iter(list(self.items()))


class Handle:
    """The state of one stream, and its timers."""

    def __init__(self):
        self.states, self.timers = {}, []

    def getValueState(self, name, *_):
        return self.states.setdefault(name, ValueState())

    def getMapState(self, name, *_):
        return self.states.setdefault(name, MapState())

    def registerTimer(self, ms):
        self.timers.append(ms)

    def is_empty(self):
        return all(s.value is None if isinstance(s, ValueState) else not s for s in self.states.values())


class Expired:
    def __init__(self, ms):
        self.ms = ms

    def getExpiryTimeInMs(self):
        return self.ms


def head_row(skip=None):
    return Row(head={"began": 1_000_000, "until": 9_000_000, "salt_id": "salt", "skip": skip}, entries=None, data=None)


def pack_row(*chunks):
    """A pack of chunks `(seq, chunk, is_last, at)`."""
    entries = b"".join(struct.pack(responses.PACK_ENTRY, at, seq, len(chunk), is_last) for seq, chunk, is_last, at in chunks)
    return Row(head=None, entries=entries, data=b"".join(c[1] for c in chunks))


@pytest.mark.parametrize("skip", [None, "encoded"])
def test_a_response_in_any_order_over_any_batches(skip, monkeypatch):
    """The head anywhere among the chunks, some of them repeated, with more of them than memory may keep."""
    monkeypatch.setattr(chunks, "_EARLY_IN_MEMORY", 3)
    monkeypatch.setattr(responses, "_HELD_IN_MEMORY", 3)
    body = f"é before {mint('x')} after {mint('y')} {'z' * 40}".encode()
    pieces = [body[i : i + 7] for i in range(0, len(body), 7)]
    whole = [(i, p, i == len(pieces) - 1, 1_000_000 + i) for i, p in enumerate(pieces)]
    shuffled = random.Random(4)
    for _ in range(200):
        # Two of another time than the head's, which meet nothing.
        sent = whole + shuffled.sample(whole, 4) + [(0, b"before", False, 999_999), (2, b"after", True, 9_000_001)]
        shuffled.shuffle(sent)
        rows = [head_row(skip)]
        while sent:
            n = shuffled.randint(1, 5)
            rows.append(pack_row(*sent[:n]))
            del sent[:n]
        shuffled.shuffle(rows)
        handle, got, at = Handle(), [], 0
        while at < len(rows):
            n = shuffled.randint(1, len(rows))
            recutter = responses.ResponseRecutter(None)
            recutter.init(handle)
            got += recutter.handleInputRows(("s",), iter(rows[at : at + n]), None)
            at += n
        assert [r.seq + n for r in got for n in range(len(r.chunks))] == list(range(len(pieces)))
        emitted = [c for r in got for c in r.chunks]
        assert b"".join(emitted) == body
        assert {(r.stream_id, r.salt_id, r.skip, r.restorable) for r in got} == {("s", "salt", skip, skip is None)}
        if skip is not None:
            assert emitted == pieces
        assert not handle.states["early"] and not handle.states["held"]


def test_a_response_turns_binary_and_fills_packs():
    token = mint("x").encode()
    big = [b"y" * 9000] * 5
    pieces = [b"ok " + token, b"<<hs:1", *big, b"\xff" + token, token]
    handle = Handle()
    recutter = responses.ResponseRecutter(None)
    recutter.init(handle)
    got = list(recutter.handleInputRows(("s",), iter([head_row(), pack_row(*((i, p, i == 8, 1_000_000) for i, p in enumerate(pieces)))]), None))
    flat = [(r.seq + n, c, r.restorable) for r in got for n, c in enumerate(r.chunks)]
    assert [(c, ok) for _, c, ok in flat] == feed(pieces)
    assert [n for n, _, _ in flat] == list(range(9))
    assert max(sum(map(len, r.chunks)) for r in got) < 2 * 16_384 and len(got) > 3


def test_packs_hold_all_chunks():
    """Chunks of many streams and sizes, in any order, some without bytes."""
    some = random.Random(5)
    rows = [(f"s{some.randint(0, 9)}", some.randint(-5, 2**60), n, some.randbytes(some.choice([0, 1, 300, 20_000])), some.choice([True, False, None])) for n in range(500)]
    schema = pa.schema([("stream_id", pa.string()), ("at", pa.int64()), ("seq", pa.int64()), ("chunk", pa.binary()), ("is_last", pa.bool_())])
    whole = pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
    for batches in ([whole], [whole.slice(0, 7), whole.slice(7, 0), whole.slice(7)]):
        got, sizes = [], []
        for b in responses.pack(iter(batches)):
            for r in b.to_pylist():
                chunks_of = list(responses.unpacked(r["entries"], r["data"]))
                sizes.append(sum(len(c[2]) for c in chunks_of[:-1]))
                assert r["_time"].year <= 9999
                got += [(r["stream_id"], at, seq, chunk, last) for at, seq, chunk, last in chunks_of]
        assert sorted(got, key=lambda r: r[2]) == [(*r[:4], bool(r[4])) for r in rows]
        assert max(sizes) < 16_384 and len(sizes) < 400
    assert [b.num_rows for b in responses.pack(iter([whole.slice(0, 0)]))] == []


def test_packs_are_smaller_than_their_chunks():
    """Texts shrink on their way; what does not, or is short, goes as it is."""
    text, noise = b"a text of some words, " * 4, random.Random(6).randbytes(88)
    rows = [{"stream_id": s, "at": 0, "seq": n, "chunk": c, "is_last": False} for s, c, m in (("text", text, 30), ("noise", noise, 1), ("short", text, 2)) for n in range(m)]
    schema = pa.schema([("stream_id", pa.string()), ("at", pa.int64()), ("seq", pa.int64()), ("chunk", pa.binary()), ("is_last", pa.bool_())])
    (batch,) = responses.pack(iter([pa.RecordBatch.from_pylist(rows, schema)]))
    packs = {r["stream_id"]: r for r in batch.to_pylist()}
    assert len(packs["text"]["data"]) < 30 * len(text) // 3
    assert packs["noise"]["data"] == noise and packs["short"]["data"] == text * 2
    assert [c for _, _, c, _ in responses.unpacked(packs["text"]["entries"], packs["text"]["data"])] == [text] * 30


def test_responses_forget_what_can_no_longer_meet():
    def after(rows):
        handle = Handle()
        recutter = responses.ResponseRecutter(None)
        recutter.init(handle)
        list(recutter.handleInputRows(("s",), iter(rows), None))
        return recutter, handle

    recutter, handle = after([pack_row((1, b"b", True, 1_500_900)), pack_row((0, b"a", False, 1_400_000))])
    assert handle.timers == [1501] and len(handle.states["held"]) == 2
    list(recutter.handleExpiredTimer(("s",), None, Expired(1500)))
    assert dict(handle.states["held"]) == {(1_500_900, 1): (b"b", True)}
    list(recutter.handleExpiredTimer(("s",), None, Expired(1501)))
    assert handle.is_empty()

    recutter, handle = after([head_row(), pack_row((1, b"b", True, 1_000_000))])
    assert handle.timers == [9001]
    list(recutter.handleExpiredTimer(("s",), None, Expired(8999)))
    assert not handle.is_empty()
    list(recutter.handleExpiredTimer(("s",), None, Expired(9001)))
    assert handle.is_empty()

    # A finished stream needs no timer and keeps its marker.
    recutter, handle = after([pack_row((0, b"a", True, 1_000_000)), head_row()])
    assert handle.timers == [] and not handle.is_empty()
    assert list(recutter.handleInputRows(("s",), iter([head_row(), pack_row((0, b"a", True, 1_000_000))]), None)) == []


def test_responses_take_little_disk(spark, tmp_path):
    """A body that comes with its head leaves one row in state, and re-cut chunks go once they are restored."""
    use_state_store(spark)
    began = datetime(2024, 5, 1)
    pieces = [(f"s{k}", began, i, bytearray(b"some text "), i == 19) for k in range(6) for i in range(20)]
    pieces += [(None, began, 0, bytearray(b"x"), True), ("s0", None, 0, bytearray(b"x"), True)]
    spark.createDataFrame(pieces, "stream_id string, ts timestamp, seq bigint, chunk binary, is_last boolean").write.parquet(str(tmp_path / "chunks"))
    heads = [(f"s{k}", began, 200, None, "salt") for k in range(6)] + [(None, began, 200, None, "salt")]
    spark.createDataFrame(heads, responses.HEAD_SCHEMA).write.parquet(str(tmp_path / "heads"))
    mapping = spark.createDataFrame([("salt", mint("x"), "x", 0)], MAPPING_SCHEMA)
    chunk = spark.readStream.schema("stream_id string, ts timestamp, seq bigint, chunk binary, is_last boolean").parquet(str(tmp_path / "chunks"))
    head = spark.readStream.schema(responses.HEAD_SCHEMA).parquet(str(tmp_path / "heads"))
    matched = responses.with_heads(chunk, head, "1 minute", "1 minute", 600)
    query = responses.restore_responses_to(matched, lambda: mapping, str(tmp_path / "out"), str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress) == 6
    assert spark.read.schema("stream_id string").parquet(str(tmp_path / "out-staged")).count() == 0
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("stream_id", "seq").collect()
    assert [(r.stream_id, r.seq, bytes(r.chunk)) for r in got] == [(s, i, bytes(c)) for s, at, i, c, _ in pieces if s and at]
    assert {r.skip_reason for r in got} == {None}


def test_late_heads_and_chunks_of_responses(spark, tmp_path):
    """What the watermark has passed meets nothing, and leaves the state."""
    use_state_store(spark)
    began = datetime(2024, 5, 1)
    chunk_schema = "stream_id string, ts timestamp, seq bigint, chunk binary, is_last boolean"
    mapping = spark.createDataFrame([("salt", mint("x"), "x", 0)], MAPPING_SCHEMA)
    folder = str(tmp_path)

    def run(heads, pieces):
        spark.createDataFrame([(s, began + timedelta(seconds=t), 200, None, "salt") for s, t in heads], responses.HEAD_SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/heads")
        rows = [(s, began + timedelta(seconds=t), n, bytearray(b"ab"), last) for s, t, n, last in pieces]
        spark.createDataFrame(rows, chunk_schema).coalesce(1).write.mode("append").parquet(f"{folder}/chunks")
        matched = responses.with_heads(
            spark.readStream.schema(chunk_schema).parquet(f"{folder}/chunks"), spark.readStream.schema(responses.HEAD_SCHEMA).parquet(f"{folder}/heads"),
            "10 seconds", "10 seconds", 60,
        )
        query = responses.restore_responses_to(matched, lambda: mapping, f"{folder}/out", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]

    # "half" lacks its end, "headless" its head.
    assert run([("half", 0), ("done", 0)], [("half", 0, 0, False), ("done", 0, 0, True), ("headless", 0, 0, True)]) > 1
    left = run([("new", 500)], [("new", 500, 0, True)])
    # Only the markers of "done" and "new" are left, and all that comes late is dropped.
    assert left == 2
    assert run([("headless", 0), ("new", 501)], [("half", 1, 1, True), ("new", 501, 0, True)]) == 2
    got = spark.read.parquet(f"{folder}/out").collect()
    assert sorted((r.stream_id, r.seq) for r in got) == [("done", 0), ("half", 0), ("new", 0)]


def test_chunks_meet_few_salts_without_a_shuffle(spark, tmp_path):
    """However large the mapping is, its salts say how large they are, and chunks are judged where they are."""
    use_state_store(spark)
    began = datetime(2024, 5, 1)
    chunk_schema = "stream_id string, ts timestamp, seq bigint, chunk binary, is_last boolean"
    body = f"a {mint('x')} b".encode()
    spark.createDataFrame([(f"s{k}", began, 0, bytearray(body), True) for k in range(4)], chunk_schema).write.parquet(str(tmp_path / "chunks"))
    heads = [(f"s{k}", began, 204 if k == 3 else 200, None, ["salt", "unused", None, "salt"][k]) for k in range(4)]
    spark.createDataFrame(heads, responses.HEAD_SCHEMA).write.parquet(str(tmp_path / "heads"))
    spark.range(30_000).select(F.lit("salt").alias("salt_id"), F.concat(F.lit("<<hs:"), F.md5(F.col("id").cast("string")), F.lit(">>")).alias("placeholder"), F.md5(F.uuid()).alias("secret"), F.col("id").alias("last_seq")).union(
        spark.createDataFrame([("salt", mint("x"), "x", 0)], MAPPING_SCHEMA)
    ).write.parquet(str(tmp_path / "mapping"))
    matched = responses.with_heads(
        spark.readStream.schema(chunk_schema).parquet(str(tmp_path / "chunks")), spark.readStream.schema(responses.HEAD_SCHEMA).parquet(str(tmp_path / "heads")), "1 minute", "1 minute", 60,
    )
    plans, judge = [], responses.judged

    def seen(safe_chunks, salts):
        df = judge(safe_chunks, salts)
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return df

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        responses.judged = seen
        query = responses.restore_responses_to(matched, lambda: spark.read.parquet(str(tmp_path / "mapping")), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        query.trigger(availableNow=True).start().awaitTermination()
    finally:
        responses.judged = judge
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plans and all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in plans)
    got = {r.stream_id: (bytes(r.chunk), r.skip_reason) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"s0": (b"a x b", None), "s1": (body, "nothing_to_restore"), "s2": (body, "nothing_to_restore"), "s3": (body, "no_content")}
