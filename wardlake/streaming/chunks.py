"""Restoring placeholders in chunked responses.

A placeholder may straddle chunks. One stateful step re-cuts each stream so that no
placeholder (and no character) crosses a boundary; it never sees a secret. The
re-cut chunks are then restored like any other text, by a join with the mapping.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wardlake.operators.mappings import restore

RECUT_SCHEMA = "stream_id string, seq bigint, chunk binary, restorable boolean"

# The longest end of a text that may still grow into a placeholder.
_OPEN_END = re.compile(rb"<(?:<(?:h(?:s(?::(?:[0-9a-f]{0,31}|[0-9a-f]{32}>?))?)?)?)?\Z")
_PLACEHOLDER_BYTES = 39
# Chunks that arrive early are kept in memory up to this many, then in state.
_EARLY_IN_MEMORY = 1024
# Next chunk of a stream whose last one was emitted.
_FINISHED = -1


def cut(carry: bytes, chunk: bytes, is_last: bool) -> tuple[bytes, bytes, bool]:
    """`(emit, new carry, is text)` for the next chunk of a text stream.

    The carry is an unfinished character or placeholder, at most 41 bytes. Bytes that
    are no UTF-8 end the text: everything held is emitted as it is.
    """
    data = carry + chunk
    text_end = len(data)
    try:
        data.decode("utf-8")
    except UnicodeDecodeError as error:
        if error.reason != "unexpected end of data":
            return data, b"", False
        text_end = error.start
    if is_last:
        return data, b"", True
    window = max(0, text_end - _PLACEHOLDER_BYTES + 1)
    held = _OPEN_END.search(data[window:text_end])
    emit_end = window + held.start() if held and text_end == len(data) else text_end
    return data[:emit_end], data[emit_end:], True


class ChunkOrder:
    """One stream within a batch: takes its chunks in any order and gives them in theirs, with moved boundaries."""

    def __init__(self, position: tuple[int, bytes, bool], early, spilled: bool) -> None:
        self.next_seq, self.carry, self.is_text = position[0], bytes(position[1]), position[2]
        self._early, self.spilled = early, spilled
        self._near: dict[int, tuple[bytes, bool]] = {}

    @property
    def finished(self) -> bool:
        return self.next_seq == _FINISHED

    def add(self, seq: int, chunk: bytes, is_last: bool) -> Iterator[tuple[int, bytes, bool]]:
        """`(seq, chunk, is text)` of what the new chunk lets go; repeated chunks are without effect."""
        if self.finished or seq < self.next_seq:
            return
        self._near[seq] = (bytes(chunk), bool(is_last))
        while not self.finished and (entry := self._waiting(self.next_seq)) is not None:
            emit, ends = entry
            if self.is_text:
                emit, self.carry, self.is_text = cut(self.carry, emit, ends)
            yield self.next_seq, emit, self.is_text
            self.next_seq = _FINISHED if ends else self.next_seq + 1
        if len(self._near) > _EARLY_IN_MEMORY:
            self._keep()

    def position(self) -> tuple[int, bytes, bool]:
        """What to remember; early chunks go to the state, and leave it when the stream is finished."""
        if not self.finished:
            self._keep()
            return self.next_seq, self.carry, self.is_text
        if self.spilled:
            self._early.clear()
        return _FINISHED, b"", self.is_text

    def _waiting(self, seq: int) -> tuple[bytes, bool] | None:
        if seq in self._near:
            return self._near.pop(seq)
        # Asking the state costs a round trip, so ask only when something was put there.
        if self.spilled and self._early.containsKey((seq,)):
            chunk, is_last = self._early.getValue((seq,))
            self._early.removeKey((seq,))
            return bytes(chunk), is_last
        return None

    def _keep(self) -> None:
        for seq, entry in self._near.items():
            self._early.updateValue((seq,), entry)
            self.spilled = True
        self._near.clear()


class ChunkRecutter(StatefulProcessor):
    """Per stream: puts chunks in order and moves their boundaries.

    A finished stream keeps only a marker, so that repeated chunks stay without effect.
    With a time to live, the marker and whatever an unfinished stream left go after it.
    """

    def __init__(self, ttl_seconds: int | None) -> None:
        self._ttl_ms = None if ttl_seconds is None else ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._position = handle.getValueState("position", "next_seq bigint, carry binary, is_text boolean", self._ttl_ms)
        self._early = handle.getMapState("early", "seq bigint", "chunk binary, is_last boolean", self._ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        stored = self._position.get()
        # A new stream has nothing in state.
        order = ChunkOrder(stored or (0, b"", True), self._early, stored is not None and stored[0] != _FINISHED and self._early.exists())
        if order.finished:
            return
        for row in rows:
            for seq, chunk, is_text in order.add(row.seq, row.chunk, row.is_last):
                yield Row(stream_id=key[0], seq=seq, chunk=chunk, restorable=is_text)
        self._position.update(order.position())

    def close(self) -> None:
        pass


def recut(chunks: DataFrame, ttl_seconds: int | None = None) -> DataFrame:
    """Chunks `(stream_id, seq, chunk, is_last)` with boundaries that are safe to restore at.

    A live job should state `ttl_seconds`: a stream that stays without a chunk for so long
    is forgotten. A run over available input has to leave it out, because a job with
    processing-time state never runs out of batches.
    """
    return chunks.groupBy("stream_id").transformWithState(
        statefulProcessor=ChunkRecutter(ttl_seconds),
        outputStructType=RECUT_SCHEMA,
        outputMode="append",
        timeMode="none" if ttl_seconds is None else "processingTime",
    )


def restored_chunks(safe_chunks: DataFrame, mapping: DataFrame, salt_id: str) -> DataFrame:
    """Restore re-cut chunks of one batch; binary ones pass through."""
    texts = safe_chunks.withColumns(
        {
            "_id": F.concat_ws(" ", "stream_id", "seq"),
            "_salt": F.lit(salt_id),
            "_text": F.when(F.col("restorable"), F.col("chunk").try_cast("string")),
        }
    )
    done = restore(texts, mapping, "_id", "_text", "_salt")
    return done.select("stream_id", "seq", F.coalesce(F.col("_text").cast("binary"), F.col("chunk")).alias("chunk"))


def write_restored(batch: DataFrame, restored: Callable[[DataFrame], DataFrame], path: str, batch_id: int) -> None:
    """Write what `restored` makes of a batch's re-cut chunks, one folder per batch, rewritten on a retry.

    The re-cut chunks are written first, because restoring reads them more than once and the
    stateful steps must run once. They take disk only until they are restored.
    """
    staged, spark = f"{path}-staged", batch.sparkSession
    compressed = {"mode": "overwrite", "compression": "zstd"}
    batch.write.parquet(staged, **compressed)
    restored(spark.read.schema(batch.schema).parquet(staged)).write.parquet(f"{path}/batch={batch_id}", **compressed)
    spark.createDataFrame([], batch.schema).write.parquet(staged, **compressed)


def restore_to(
    chunks: DataFrame, mapping: Callable[[], DataFrame], salt_id: str, path: str, checkpoint: str, ttl_seconds: int | None = None
):
    """Streaming sink of restored chunks; `mapping` is called for each batch, so placeholders minted meanwhile are known."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_restored(batch, lambda safe: restored_chunks(safe, mapping(), salt_id), path, batch_id)

    return recut(chunks, ttl_seconds).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
