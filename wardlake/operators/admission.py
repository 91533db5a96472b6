"""The approval queue in batch: which holds a full queue admits, exactly and in parallel.

A cap makes admission sequential within a gateway, since every refusal changes what follows.
A gateway's time is therefore cut into segments. Each is simulated from a guess of the holds
that are open when it begins, at first none, and passes on those that are open when it ends.
Segments whose beginning was guessed wrong run again, until no guess changes. A hold lasts
for the timeout at most, so a wrong guess is mostly forgotten within the next segment; in
the worst case there are as many rounds as segments, and the result is the same.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlake.constants import HOLD_TIMEOUT_SECONDS
from wardlake.runtime import shared_dir

ADMISSION_SCHEMA = "gateway string, at_ms bigint, request_id bigint, decision string, cause string, approval_id bigint"
DECISIONS = {"approve": "approved", "reject": "rejected", "disconnect": "rejected"}
_OPEN = "open"
_STEP_SCHEMA = f"{ADMISSION_SCHEMA}, segment bigint"

# (at_ms, request_id, decision, cause, approval_id)
Outcome = tuple[int, int, str, str, int | None]


class ApprovalQueue:
    """Open holds of a gateway, in the order of their deadlines."""

    def __init__(self, max_pending: int | None, timeout_ms: int) -> None:
        self.max_pending, self.timeout_ms = max_pending, timeout_ms
        # approval id → (request, deadline); the timeout is the same for all, so the first ends first.
        self.open: OrderedDict[int, tuple[int, int]] = OrderedDict()
        self._of_request: dict[int, list[int]] = {}

    def put(self, approval_id: int, request_id: int, deadline: int) -> None:
        self.open[approval_id] = (request_id, deadline)
        self._of_request.setdefault(request_id, []).append(approval_id)

    def expire(self, now_ms: int) -> Iterator[Outcome]:
        """Holds whose deadline has come."""
        while self.open:
            approval_id, (request_id, deadline) = next(iter(self.open.items()))
            if deadline > now_ms:
                return
            del self.open[approval_id]
            self._forget(request_id, approval_id)
            yield deadline, request_id, "rejected", "timeout", approval_id

    def _forget(self, request_id: int, approval_id: int) -> None:
        left = self._of_request[request_id]
        left.remove(approval_id)
        if not left:
            del self._of_request[request_id]

    def handle(self, at_ms: int, seq: int, kind: str, request_id: int) -> Iterator[Outcome]:
        """One event; a deadline at its very time comes after it."""
        yield from self.expire(at_ms - 1)
        if kind == "pause":
            if self.max_pending is not None and len(self.open) >= self.max_pending:
                yield at_ms, request_id, "rejected", "full", None
                return
            self.put(seq, request_id, at_ms + self.timeout_ms)
            yield at_ms, request_id, "paused", "hold", seq
            return
        for approval_id in sorted(self._of_request.pop(request_id, ())):
            del self.open[approval_id]
            yield at_ms, request_id, DECISIONS[kind], kind, approval_id


def _simulated(max_pending: int, timeout_ms: int, until_ms: int):
    """Runs through sorted rows of segments: first what is open, then the events."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        queue, current, is_end = None, None, False

        def ended() -> None:
            if queue is None:
                return
            if is_end:
                out.extend((current[0], *o, current[1]) for o in queue.expire(until_ms))
            out.extend((current[0], deadline, request, _OPEN, _OPEN, approval, current[1]) for approval, (request, deadline) in queue.open.items())

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 7
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            names = ["gateway", "at_ms", "request_id", "decision", "cause", "approval_id", "segment"]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
            out.clear()
            return batch

        for batch in batches:
            for gateway, segment, last, kind, at_ms, seq, request in zip(*(c.to_pylist() for c in batch.columns)):
                if (gateway, segment) != current:
                    ended()
                    queue, current, is_end = ApprovalQueue(max_pending, timeout_ms), (gateway, segment), last
                if kind == _OPEN:
                    queue.put(seq, request, at_ms)
                else:
                    out.extend((gateway, *o, segment) for o in queue.handle(at_ms, seq, kind, request))
                if len(out) >= 10_000:
                    yield flush()
        ended()
        yield flush()

    return run


def admissions(
    events: DataFrame, max_pending: int, segment_seconds: int, timeout_seconds: int = HOLD_TIMEOUT_SECONDS
) -> tuple[DataFrame, int]:
    """Outcome of every pause and resolution, and the number of rounds it took.

    `events` has (gateway, ts, seq, kind, request_id), kind one of pause, approve, reject and
    disconnect; `seq` is unique within a gateway and is a hold's approval id. Deadlines after
    the last event of all stay open. The rounds are jobs; each reads only the segments that
    run again.
    """
    spark = events.sparkSession
    path = shared_dir(spark, "admission")
    rows = events.select("gateway", F.unix_millis("ts").alias("at_ms"), "seq", "kind", "request_id")
    rows = rows.withColumn("segment", F.floor(F.col("at_ms") / (segment_seconds * 1000)))
    following = Window.partitionBy("gateway").orderBy("segment")
    segments = rows.select("gateway", "segment").distinct().withColumn("next", F.lead("segment").over(following))
    rows.join(segments, ["gateway", "segment"]).write.parquet(f"{path}/events")
    rows = spark.read.parquet(f"{path}/events")
    until_ms = rows.agg(F.max("at_ms")).first()[0]
    if until_ms is None:
        return spark.createDataFrame([], ADMISSION_SCHEMA), 0
    simulate = _simulated(max_pending, timeout_seconds * 1000, until_ms)
    none = F.array().cast("array<struct<approval_id:bigint,request_id:bigint,at_ms:bigint>>")
    # What each segment was last run with; at first, all run with nothing open.
    segments = rows.select("gateway", "segment", "next").distinct()
    segments.withColumn("held", none).write.parquet(f"{path}/run=0")
    rounds = 0
    while True:
        run = spark.read.parquet(f"{path}/run={rounds}")
        started = run.select(
            "gateway", "segment", F.col("next").isNull().alias("last"), F.explode("held").alias("h")
        ).select(
            "gateway", "segment", "last", F.lit(_OPEN).alias("kind"), F.col("h.at_ms").alias("at_ms"), F.col("h.approval_id").alias("seq"),
            F.col("h.request_id").alias("request_id"), F.lit(0).alias("order"),
        )
        again = rows.join(run.select("gateway", "segment"), ["gateway", "segment"], "left_semi").select(
            "gateway", "segment", F.col("next").isNull().alias("last"), "kind", "at_ms", "seq", "request_id", F.lit(1).alias("order")
        )
        dealt = again.unionByName(started).repartition("gateway", "segment").sortWithinPartitions("gateway", "segment", "order", "at_ms", "seq")
        dealt.drop("order").mapInArrow(simulate, _STEP_SCHEMA).withColumn("round", F.lit(rounds)).write.parquet(f"{path}/out/run={rounds}")
        # An open set is at most `max_pending` holds.
        passed = spark.read.parquet(f"{path}/out/run={rounds}").where(F.col("decision") == _OPEN).groupBy("gateway", "segment").agg(
            F.sort_array(F.collect_list(F.struct("approval_id", "request_id", "at_ms"))).alias("passed")
        )
        changed = run.where("next is not null").join(passed, ["gateway", "segment"], "left").select(
            "gateway", F.col("next").alias("segment"), F.coalesce("passed", none).alias("passed")
        )
        latest = _latest(spark, path, rounds)
        rerun = changed.join(latest, ["gateway", "segment"]).where(F.col("passed") != F.col("held"))
        rounds += 1
        rerun.select("gateway", "segment", "next", F.col("passed").alias("held")).write.parquet(f"{path}/run={rounds}")
        if spark.read.parquet(f"{path}/run={rounds}").isEmpty():
            break
    last = _latest(spark, path, rounds - 1).select("gateway", "segment", "round")
    outcomes = spark.read.parquet(*(f"{path}/out/run={n}" for n in range(rounds)))
    kept = outcomes.where(F.col("decision") != _OPEN).join(last, ["gateway", "segment", "round"], "left_semi")
    return kept.select("gateway", "at_ms", "request_id", "decision", "cause", "approval_id"), rounds


def _latest(spark, path: str, rounds: int) -> DataFrame:
    """(gateway, segment, next, held, round) of each segment's last run."""
    runs = None
    for n in range(rounds + 1):
        one = spark.read.parquet(f"{path}/run={n}").withColumn("round", F.lit(n))
        runs = one if runs is None else runs.unionByName(one)
    newest = F.max_by(F.struct("next", "held", "round"), "round").alias("r")
    return runs.groupBy("gateway", "segment").agg(newest).select("gateway", "segment", "r.*")
