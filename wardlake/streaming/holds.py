"""Live holds: pause → approved, rejected, timed out, abandoned, or refused when full.

Events wait in state until the watermark has passed them and are then handled in time
order, so neither batch boundaries nor early resolutions change the outcome. Without a
cap, requests are independent and are dealt to many groups. A cap makes admission
sequential within a gateway, since every refusal changes what follows; only then is the
gateway the group.

State is kept by time: waiting events and deadlines lie in buckets of some minutes, with a small
index of the buckets, and open holds are looked up by request. A timer reads the buckets
that are due, one after the other, and what it finds; neither a long backlog nor many open
holds are ever read as a whole. Events are read and outcomes sent on in parts of fixed size.

A hold's approval id is the `seq` of its pause. A resolution ends every open hold of its
request. Events later than the stated lateness are dropped by Spark, which reports their
number as `numRowsDroppedByWatermark` in the query's progress. A job can begin with the holds
that an earlier one left open.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import islice
from math import inf

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wardlake.constants import HOLD_TIMEOUT_SECONDS
from wardlake.operators.admission import DECISIONS

# kind: pause, approve, reject, disconnect
HOLD_INPUT_SCHEMA = "gateway string, ts timestamp, seq bigint, kind string, request_id bigint"
HOLD_OUTPUT_SCHEMA = (
    "gateway string, at_ms bigint, request_id bigint, decision string, cause string, approval_id bigint"
)
OPEN_HOLD_SCHEMA = "gateway string, request_id bigint, approval_id bigint, deadline bigint"
# Parts that a gateway's independent requests are dealt to by default; a state call per request costs more.
PARTS = 64
BUCKET_SECONDS = 600
_BUCKETS = "buckets array<struct<bucket:bigint,first:bigint,slabs:bigint>>"
# Waiting events that are read before they are put into state, and outcomes that leave at once.
_ROWS_IN_MEMORY = 100_000
_OUTCOMES_AT_ONCE = 10_000


class _Buckets:
    """Rows of a map state by bucket, with an index of the buckets, their earliest time and number of slabs.

    Rows are added to a bucket as a further slab, so what lies there is not read or written again.
    """

    def __init__(self, handle: StatefulProcessorHandle, name: str, columns: str, bucket_ms: int) -> None:
        self._bucket_ms = bucket_ms
        self._rows = handle.getMapState(name, "bucket bigint, slab bigint", columns)
        self._listed = handle.getValueState(f"{name}_index", _BUCKETS)

    def index(self) -> dict[int, tuple[int, int]]:
        """bucket → earliest time, number of slabs."""
        stored = self._listed.get()
        return {b[0]: (b[1], b[2]) for b in stored[0]} if stored else {}

    def keep(self, index: dict[int, tuple[int, int]]) -> None:
        if index:
            self._listed.update((sorted((bucket, *entry) for bucket, entry in index.items()),))
        else:
            self._listed.clear()

    def add(self, index: dict[int, tuple[int, int]], rows: list[tuple]) -> None:
        """Put rows, whose first entry is their time, into their buckets."""
        parts: dict[int, list[tuple]] = {}
        for row in rows:
            parts.setdefault(row[0] // self._bucket_ms, []).append(row)
        for bucket, part in parts.items():
            earliest = min(r[0] for r in part)
            first, slabs = index.get(bucket, (earliest, 0))
            self._rows.updateValue((bucket, slabs), tuple(list(column) for column in zip(*part)))
            index[bucket] = (min(first, earliest), slabs + 1)

    def take(self, index: dict[int, tuple[int, int]], bucket: int) -> list[tuple]:
        """Remove a bucket and return its rows in order; one that came twice counts once."""
        rows: set[tuple] = set()
        for slab in range(index.pop(bucket)[1]):
            rows.update(zip(*self._rows.getValue((bucket, slab))))
            self._rows.removeKey((bucket, slab))
        return sorted(rows)


class HoldRegistry(StatefulProcessor):
    """Waiting events and open holds of one group."""

    def __init__(self, max_pending: int | None, timeout_seconds: int, bucket_seconds: int):
        self._max_pending = max_pending
        self._timeout_ms = timeout_seconds * 1000
        self._bucket_ms = bucket_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = _Buckets(handle, "waiting", "at_ms array<bigint>, seq array<bigint>, kind array<string>, request_id array<bigint>", self._bucket_ms)
        self._deadlines = _Buckets(handle, "deadlines", "deadline array<bigint>, approval_id array<bigint>, request_id array<bigint>", self._bucket_ms)
        # The watermark up to which everything was handled, and the number of open holds.
        self._handled = handle.getValueState("handled", "at_ms bigint")
        self._count = handle.getValueState("count", "open bigint")
        # Open holds of a request as approval id and deadline.
        self._open = handle.getMapState("open", "request_id bigint", "holds array<struct<approval_id:bigint,deadline:bigint>>")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        """One hold that an earlier job left open."""
        request, approval, deadline = initialState.request_id, initialState.approval_id, initialState.deadline
        stored = [tuple(h) for h in self._open.getValue((request,))[0]] if self._open.containsKey((request,)) else []
        self._open.updateValue((request,), (stored + [(approval, deadline)],))
        index = self._deadlines.index()
        self._deadlines.add(index, [(deadline, approval, request)])
        self._deadlines.keep(index)
        count = self._count.get()
        self._count.update(((count[0] if count else 0) + 1,))
        self._handle.registerTimer(deadline)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        index, events, first = self._waiting.index(), ((row.at_ms, row.seq, row.kind, row.request_id) for row in rows), None
        while new := list(islice(events, _ROWS_IN_MEMORY)):
            self._waiting.add(index, new)
            earliest = min(event[0] for event in new)
            first = earliest if first is None else min(first, earliest)
        if first is not None:
            self._waiting.keep(index)
            # The first timer that the watermark passes handles all that is due by then.
            self._handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Everything that the watermark has passed, in time order, at the first of its timers."""
        handled = self._handled.get()
        if handled and expiredTimerInfo.getExpiryTimeInMs() <= handled[0]:
            return
        now = timerValues.getCurrentWatermarkInMs()
        waiting, run = self._waiting.index(), _Run(self)
        for bucket in sorted(b for b, (first, _) in waiting.items() if first <= now):
            later = []
            for event in self._waiting.take(waiting, bucket):
                if event[0] > now:
                    later.append(event)
                    continue
                for outcome in run.handle(*event):
                    yield self._event(key, *outcome)
            self._waiting.add(waiting, later)
        for outcome in run.expire(now):
            yield self._event(key, *outcome)
        self._waiting.keep(waiting)
        ahead = [*(first for first, _ in waiting.values()), *run.store()]
        if ahead:
            self._handle.registerTimer(min(ahead))
            self._handled.update((now,))
        else:
            self._handled.clear()

    @staticmethod
    def _event(key, at_ms: int, request_id: int, decision: str, cause: str, approval_id: int | None) -> Row:
        return Row(
            gateway=key[0], at_ms=at_ms, request_id=request_id, decision=decision, cause=cause,
            approval_id=approval_id,
        )

    def close(self) -> None:
        pass


class _Run:
    """The open holds during one timer: those in state are read when they are met, new ones stay here."""

    def __init__(self, registry: HoldRegistry) -> None:
        self._max_pending, self._timeout_ms = registry._max_pending, registry._timeout_ms
        self._state, self._deadlines, self._count = registry._open, registry._deadlines, registry._count
        count = self._count.get()
        # How many of the open holds are in state: without any, it need not be asked.
        self._stored = count[0] if count else 0
        self._index = self._deadlines.index()
        self._next = self._earliest()
        self._read: deque[tuple[int, int, int]] = deque()
        self._fresh: deque[tuple[int, int, int]] = deque()
        self._of_request: dict[int, list[tuple[int, int]]] = {}
        self._open = 0

    def _earliest(self) -> float:
        """The first deadline that is in state."""
        return min((first for first, _ in self._index.values()), default=inf)

    def _in_state(self, request: int) -> list[tuple[int, int]]:
        if not self._stored or not self._state.containsKey((request,)):
            return []
        return sorted(tuple(h) for h in self._state.getValue((request,))[0])

    def expire(self, now_ms: int):
        """Holds whose deadline has come."""
        while self._next <= now_ms:
            # Buckets follow each other in time, so the earliest deadline lies in the first.
            self._read = deque(sorted([*self._read, *self._deadlines.take(self._index, min(self._index))]))
            self._next = self._earliest()
        while True:
            of_state = bool(self._read) and (not self._fresh or self._read[0] <= self._fresh[0])
            due = self._read if of_state else self._fresh
            if not due or due[0][0] > now_ms:
                return
            deadline, approval, request = due.popleft()
            held = self._in_state(request) if of_state else self._of_request.get(request, [])
            if (approval, deadline) not in held:
                continue  # resolved before
            held.remove((approval, deadline))
            if of_state:
                self._stored -= 1
                if held:
                    self._state.updateValue((request,), (held,))
                else:
                    self._state.removeKey((request,))
            else:
                self._open -= 1
                if not held:
                    del self._of_request[request]
            yield deadline, request, "rejected", "timeout", approval

    def handle(self, at_ms: int, seq: int, kind: str, request: int):
        """One event; a deadline at its very time comes after it."""
        yield from self.expire(at_ms - 1)
        if kind == "pause":
            if self._max_pending is not None and self._stored + self._open >= self._max_pending:
                yield at_ms, request, "rejected", "full", None
                return
            deadline = at_ms + self._timeout_ms
            self._fresh.append((deadline, seq, request))
            self._of_request.setdefault(request, []).append((seq, deadline))
            self._open += 1
            yield at_ms, request, "paused", "hold", seq
            return
        stored = self._in_state(request)
        if stored:
            self._state.removeKey((request,))
            self._stored -= len(stored)
        new = self._of_request.pop(request, [])
        self._open -= len(new)
        for approval, _ in sorted([*stored, *new]):
            yield at_ms, request, DECISIONS[kind], kind, approval

    def store(self) -> list[int]:
        """Write what is open; the earliest times at which deadlines come."""
        alive = {(d, a, r) for r, held in self._of_request.items() for a, d in held}
        self._deadlines.add(self._index, [*self._read, *(f for f in self._fresh if f in alive)])
        for request, held in self._of_request.items():
            self._state.updateValue((request,), (self._in_state(request) + held,))
        self._deadlines.keep(self._index)
        total = self._stored + self._open
        if total:
            self._count.update((total,))
        else:
            self._count.clear()
        return [first for first, _ in self._index.values()]


class _FramedHolds(HoldRegistry):
    """The same with pandas frames in and out: Spark sends them on one by one, but rows only when the last is there.

    Ids come as texts, since a frame would turn whole numbers beside a null into doubles.
    """

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for request, approval, deadline in _values(initialState, "request_id", "approval_id", "deadline"):
            super().handleInitialState(key, Row(request_id=_id(request), approval_id=_id(approval), deadline=deadline), timerValues)

    def handleInputRows(self, key, rows, timerValues):
        events = (
            Row(at_ms=at_ms, seq=_id(seq), kind=kind, request_id=_id(request))
            for frame in rows for at_ms, seq, kind, request in _values(frame, "at_ms", "seq", "kind", "request_id")
        )
        return super().handleInputRows(key, events, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        outcomes = super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        while part := list(islice(outcomes, _OUTCOMES_AT_ONCE)):
            yield pd.DataFrame(part, columns=list(part[0].__fields__), dtype=object)


def _values(frame, *columns: str) -> Iterator[tuple]:
    return zip(*(frame[c].tolist() for c in columns))


def _id(text: str | None) -> int | None:
    return int(text) if isinstance(text, str) else None


def hold_events(
    requests: DataFrame,
    lateness: str,
    max_pending: int | None = None,
    timeout_seconds: int = HOLD_TIMEOUT_SECONDS,
    parts: int = PARTS,
    open_holds: DataFrame | None = None,
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Audit events of holds from a stream of pauses and resolutions.

    `seq` must be unique within a gateway. `open_holds` (OPEN_HOLD_SCHEMA, see
    `left_open`) is what a new job begins with; it has no effect on one that continues
    from its checkpoint. A timer holds one bucket of `bucket_seconds` in memory at a time.
    """
    group = ["gateway"] if max_pending is not None else ["gateway", "part"]
    part = F.pmod(F.xxhash64("request_id"), F.lit(parts))

    def ids_as_texts(rows: DataFrame, *ids: str) -> DataFrame:
        return rows.withColumn("part", part).withColumns({c: F.col(c).cast("string") for c in ids})

    begin = {} if open_holds is None else {"initialState": ids_as_texts(open_holds, "request_id", "approval_id").groupBy(*group)}
    return (
        ids_as_texts(requests, "request_id", "seq")
        .withWatermark("ts", lateness)
        .withColumn("at_ms", F.unix_millis("ts"))
        .groupBy(*group)
        .transformWithStateInPandas(
            statefulProcessor=_FramedHolds(max_pending, timeout_seconds, bucket_seconds),
            outputStructType=HOLD_OUTPUT_SCHEMA,
            outputMode="append",
            timeMode="EventTime",
            **begin,
        )
    )


def left_open(outcomes: DataFrame, timeout_seconds: int = HOLD_TIMEOUT_SECONDS) -> DataFrame:
    """Holds that the events of `hold_events` leave open, as a later job's `open_holds`."""
    ended = outcomes.where(F.col("decision") != "paused").select("gateway", "approval_id").distinct()
    held = outcomes.where((F.col("decision") == "paused") & F.col("approval_id").isNotNull())
    return held.join(ended, ["gateway", "approval_id"], "left_anti").select(
        "gateway", "request_id", "approval_id", (F.col("at_ms") + timeout_seconds * 1000).alias("deadline")
    )


def open_in_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """OPEN_HOLD_SCHEMA rows of the holds that are open in a job's state as of its last batch.

    The state is read where the job keeps it, without touching the job: the live size of the
    approval queue is its count, and one hold by id is a filter.
    """
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "open").load()
    listed = state.select(F.col("key.gateway").alias("gateway"), F.col("user_map_key.request_id").alias("request_id"), F.explode("user_map_value.holds").alias("h"))
    return listed.select("gateway", "request_id", "h.*")
