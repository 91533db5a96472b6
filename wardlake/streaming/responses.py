"""Restoring responses: heads and chunks of bodies come as two streams.

A head says whether a body may be restored; its chunks meet it in one stateful step that
either side may reach first. Skipped bodies pass byte for byte; the others are re-cut, so
that no placeholder crosses a boundary, and restored with the mapping of the head's salt, as
it is at each batch.

Both sides have a watermark, and a chunk belongs to a head for a stated time, so the step
forgets heads and chunks that can no longer meet. Chunks without a head are dropped with it.
Only what has to wait lies in state: a body that comes with its head in one batch leaves a
marker and none of its bytes. Chunks travel in packs, since to shuffle a small chunk and to
make it a row in Python costs more than the chunk.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wardlake.functions.bodies import restore_skip_reason
from wardlake.operators.mappings import restore
from wardlake.streaming.chunks import RECUT_SCHEMA, ChunkOrder, write_restored

HEAD_SCHEMA = "stream_id string, ts timestamp, status int, encoding string, salt_id string"
RESPONSE_SCHEMA = f"{RECUT_SCHEMA}, salt_id string, skip string"

# Chunks whose head is not there yet are kept in memory up to this many, then in state.
_HELD_IN_MEMORY = 1024
# A pack is closed by the chunk that reaches so many bytes; its entries are time, number, bytes and whether it is the last.
# Its data are compressed if that makes them shorter, which is not tried on a few bytes.
_PACK_BYTES = 16_384
_LEAST_COMPRESSED = 256
PACK_ENTRY = "<qqi?"
_PACK_ENTRY = np.dtype([("at", "<i8"), ("seq", "<i8"), ("size", "<i4"), ("is_last", "?")])
_PACK_SCHEMA = "_time timestamp, stream_id string, entries binary, data binary"
_REPACKED_SCHEMA = "stream_id string, seq bigint, chunks array<binary>, restorable boolean, salt_id string, skip string"
# The years that Python's times have; others count as the first or the last, where the watermark never goes.
_TIMES = (-62_135_510_400_000_000, 253_402_128_000_000_000)


def _shortened(data: pa.Buffer, codec: pa.Codec) -> bytes:
    compressed = codec.compress(data, asbytes=True) if data.size >= _LEAST_COMPRESSED else None
    return compressed if compressed is not None and len(compressed) < data.size else data.to_pybytes()


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks `(stream_id, at, seq, chunk, is_last)` of a stream within a batch as packs, at the time of the latest of them."""
    codec = pa.Codec("zstd", compression_level=1)
    for batch in batches:
        if not batch.num_rows:
            continue
        streams = batch.column("stream_id").dictionary_encode().indices.to_numpy()
        order = np.argsort(streams, kind="stable")
        rows, streams, n = batch.take(pa.array(order)), streams[order], batch.num_rows
        chunks = rows.column("chunk").cast(pa.binary())
        ends = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset : chunks.offset + n + 1]
        entries = np.empty(n, _PACK_ENTRY)
        # A chunk without a time or a number is an error here.
        entries["at"], entries["seq"], entries["size"] = rows.column("at").to_numpy(), rows.column("seq").to_numpy(), np.diff(ends)
        entries["is_last"] = rows.column("is_last").fill_null(False).to_numpy(zero_copy_only=False)
        first = np.append(True, streams[1:] != streams[:-1])
        part = (ends[:-1] - ends[:-1][first][np.cumsum(first) - 1]) // _PACK_BYTES
        begin = np.flatnonzero(first | np.append(True, part[1:] != part[:-1]))
        data = chunks.buffers()[2] or pa.py_buffer(b"")
        bounds = np.append(begin, n).tolist()
        spans = list(zip(bounds, bounds[1:]))
        latest = np.clip(np.maximum.reduceat(entries["at"], begin), *_TIMES)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(latest).cast(pa.timestamp("us", "UTC")), rows.column("stream_id").take(pa.array(begin)),
                pa.array([entries[a:b].tobytes() for a, b in spans], pa.binary()),
                pa.array([_shortened(data.slice(ends[a], ends[b] - ends[a]), codec) for a, b in spans], pa.binary()),
            ],
            ["_time", "stream_id", "entries", "data"],
        )


def with_heads(chunks: DataFrame, heads: DataFrame, chunk_lateness: str, head_lateness: str, max_seconds: int) -> DataFrame:
    """Heads and packs of chunks `(stream_id, ts, seq, chunk, is_last)` as one stream.

    A chunk comes at the time of its head or up to `max_seconds` after it. What has no stream or
    no time meets nothing. A pack is late when all its chunks are.
    """
    heads, chunks = heads.dropna(subset=["stream_id", "ts"]), chunks.dropna(subset=["stream_id", "ts"])
    until = F.unix_micros(F.col("ts") + F.make_dt_interval(secs=F.lit(max_seconds)))
    time = F.timestamp_micros(F.greatest(F.least(F.unix_micros("ts"), F.lit(_TIMES[1])), F.lit(_TIMES[0])))
    head = heads.withColumn("_time", time).withWatermark("_time", head_lateness).select(
        "_time", "stream_id",
        F.struct(F.unix_micros("ts").alias("began"), until.alias("until"), "salt_id", restore_skip_reason("status", "encoding", F.lit(1)).alias("skip")).alias("head"),
    )
    packs = chunks.select("stream_id", F.unix_micros("ts").alias("at"), "seq", "chunk", "is_last").mapInArrow(pack, _PACK_SCHEMA)
    return head.unionByName(packs.withWatermark("_time", chunk_lateness), allowMissingColumns=True)


def unpacked(entries: bytes, data: bytes) -> Iterator[tuple[int, int, bytes, bool]]:
    """`(at, seq, chunk, is_last)` of a pack's chunks."""
    chunks = list(struct.iter_unpack(PACK_ENTRY, entries))
    total = sum(size for _, _, size, _ in chunks)
    if len(data) < total:
        data = pa.decompress(data, total, "zstd", asbytes=True)
    begin = 0
    for at, seq, size, is_last in chunks:
        yield at, seq, data[begin : begin + size], is_last
        begin += size


class ResponseRecutter(StatefulProcessor):
    """Per stream: chunks in the time of the head in their order, with moved boundaries; those of a skipped response as they came.

    A stream has one head; of several the first to come counts. A finished stream keeps only a
    marker. An unfinished one goes when the watermark has passed its head's time, a chunk without
    a head when it has passed the chunk; with a time to live, everything goes after it instead.
    """

    def __init__(self, ttl_seconds: int | None) -> None:
        self._ttl_ms = None if ttl_seconds is None else ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        position = "next_seq bigint, carry binary, is_text boolean, began bigint, until bigint, salt_id string, skip string"
        self._position = handle.getValueState("position", position, self._ttl_ms)
        self._early = handle.getMapState("early", "seq bigint", "chunk binary, is_last boolean", self._ttl_ms)
        self._held = handle.getMapState("held", "at bigint, seq bigint", "chunk binary, is_last boolean", self._ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        stored = self._position.get()
        began, until, salt_id, skip = stored[3:] if stored else (None, None, None, None)
        order = ChunkOrder(stored[:3] if stored else (0, b"", True), self._early, False)
        if order.finished:
            return
        # Asking the state costs a round trip, so ask only for streams that left something there.
        order.spilled = until is not None and self._early.exists()
        in_state = stored is not None and until is None
        held: dict[tuple[int, int], tuple[bytes, bool]] = {}
        last_held, new_head = None, False
        # Chunks that go out one after the other, as text or not.
        out, first, out_bytes, out_text = [], order.next_seq, 0, True

        def packed() -> Row:
            return Row(stream_id=key[0], seq=first, chunks=out, restorable=out_text, salt_id=salt_id, skip=skip)

        def ready(chunks) -> Iterator[Row]:
            nonlocal out, first, out_bytes, out_text
            for at, seq, chunk, is_last in chunks:
                if not began <= at <= until:
                    continue
                for n, emit, is_text in order.add(seq, chunk, is_last):
                    if out and (is_text != out_text or out_bytes >= _PACK_BYTES):
                        yield packed()
                        out, first, out_bytes = [], n, 0
                    out.append(emit)
                    out_bytes, out_text = out_bytes + len(emit), is_text

        for row in rows:
            if row.head is None:
                if until is not None:
                    yield from ready(unpacked(row.entries, row.data))
                    continue
                for at, seq, chunk, is_last in unpacked(row.entries, row.data):
                    held[at, seq] = (chunk, is_last)
                    last_held = at if last_held is None else max(last_held, at)
                    if len(held) > _HELD_IN_MEMORY:
                        self._keep(held)
                        in_state = True
            elif until is None:
                began, until, salt_id, skip = (row.head[name] for name in ("began", "until", "salt_id", "skip"))
                new_head, order.is_text = True, skip is None
                yield from ready((*at_seq, *entry) for at_seq, entry in held.items())
                if in_state:
                    yield from ready((*at_seq, *entry) for at_seq, entry in self._held.iterator())
                    self._held.clear()
        if out:
            yield packed()
        if until is None:
            self._keep(held)
            self._forget_after(last_held)
        elif new_head and not order.finished:
            self._forget_after(until)
        self._position.update((*order.position(), began, until, salt_id, skip))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = expiredTimerInfo.getExpiryTimeInMs() * 1000
        stored = self._position.get()
        if stored is None or ChunkOrder(stored[:3], None, False).finished:
            return iter(())
        if stored[4] is None:
            times = [tuple(k) for k in self._held.keys()]
            for at, seq in times:
                if at <= passed:
                    self._held.removeKey((at, seq))
            if all(at <= passed for at, _ in times):
                self._position.clear()
        elif stored[4] <= passed:
            self._early.clear()
            self._position.clear()
        return iter(())

    def _keep(self, held: dict[tuple[int, int], tuple[bytes, bool]]) -> None:
        for at_seq, entry in held.items():
            self._held.updateValue(at_seq, entry)
        held.clear()

    def _forget_after(self, micros: int) -> None:
        if self._ttl_ms is None:
            self._handle.registerTimer(micros // 1000 + 1)

    def close(self) -> None:
        pass


def recut_responses(matched: DataFrame, ttl_seconds: int | None = None) -> DataFrame:
    """Re-cut chunks with their salt and skip class; those of skipped responses are as they came."""
    packs = matched.groupBy("stream_id").transformWithState(
        statefulProcessor=ResponseRecutter(ttl_seconds),
        outputStructType=_REPACKED_SCHEMA,
        outputMode="append",
        timeMode="eventTime" if ttl_seconds is None else "processingTime",
    )
    return packs.select("*", F.posexplode("chunks").alias("_n", "chunk")).select(
        "stream_id", (F.col("seq") + F.col("_n")).alias("seq"), "chunk", "restorable", "salt_id", "skip"
    )


def judged(safe_chunks: DataFrame, salts: DataFrame) -> DataFrame:
    """Re-cut chunks with the reason to skip them; a salt without any mapping row is one more."""
    known = safe_chunks.join(salts.withColumn("_known", F.lit(True)), "salt_id", "left")
    reason = F.coalesce("skip", F.when(F.col("_known").isNull(), "nothing_to_restore"))
    return known.select("stream_id", "seq", "chunk", "restorable", "salt_id", reason.alias("skip_reason"))


def restored_responses(judged_chunks: DataFrame, mapping: DataFrame) -> DataFrame:
    """`(stream_id, seq, chunk, skip_reason)` of the judged chunks of one batch."""
    texts = judged_chunks.withColumns(
        {
            "_id": F.concat_ws(" ", "stream_id", "seq"),
            "_text": F.when(F.col("restorable") & F.col("skip_reason").isNull(), F.col("chunk").try_cast("string")),
        }
    )
    done = restore(texts, mapping, "_id", "_text", "salt_id")
    return done.select("stream_id", "seq", F.coalesce(F.col("_text").cast("binary"), F.col("chunk")).alias("chunk"), "skip_reason")


def restore_responses_to(
    matched: DataFrame, mapping: Callable[[], DataFrame], path: str, checkpoint: str, ttl_seconds: int | None = None
):
    """Streaming sink of restored responses, with the mapping as it is at each batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        now, spark = mapping(), batch.sparkSession
        # The salts are written first, since from a table's own size the planner sees whether all chunks
        # have to be shuffled to meet them; and chunks meet them once, not at each reading.
        now.select("salt_id").distinct().write.mode("overwrite").parquet(f"{path}-salts")
        salts = spark.read.schema("salt_id string").parquet(f"{path}-salts")
        write_restored(judged(batch, salts), lambda safe: restored_responses(safe, now), path, batch_id)

    return recut_responses(matched, ttl_seconds).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
