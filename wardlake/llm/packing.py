"""Best-fit packing into sequences of several permitted lengths.

Rows are dealt evenly to partitions, and each task packs what it gets in pools of bounded
size, so neither a table nor a key is ever held whole. Within a pool, longest
pieces go first, each into the open bin that it fills best. Where none fits, a new bin
is opened at the size with the least cost per word that the bin can still hope to hold.
The pool is packed once by that rule and once with each permitted length preferred, so
that lengths are chosen jointly; the cheapest packing stays. Last, each bin shrinks to the
shortest permitted length that holds its contents.

A document longer than the longest length is cut into full pieces and a rest; no word is
lost. Defined results: a document of null or zero length gets one row without a bin; rows
with equal ids are packed as rows of their own; an empty table gives an empty result.
Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import durable, rows

LENGTHS = (256, 512, 1024, 2048, 4096)
# Cost of one sequence: its words, a fixed part for its handling, and attention's share.
PER_SEQUENCE = 32.0
QUADRATIC = 1 / 65_536
# Pieces packed together; rows per partition.
POOL = 32_768

PACKED = "doc_id long, piece int, start long, length long, bin_id long, bin_length int, offset int"


def cost(length: float) -> float:
    """Cost of a sequence of that length."""
    return PER_SEQUENCE + length + QUADRATIC * length * length


def _pack(sizes: list[int], permitted: tuple[int, ...], preferred: int | None) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of every size (in falling order), and the contents of every bin.

    Open bins are kept by the room they have left; a bit set finds the least sufficient room.
    """
    room: dict[int, list[int]] = {}
    rooms = 0
    bins, offsets, filled = [], [], []
    left = sum(sizes)
    for size in sizes:
        fitting = rooms >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            b = room[space].pop()
            if not room[space]:
                rooms ^= 1 << space
        else:
            allowed = [c for c in permitted if c >= size]
            if preferred is None:
                space = min(allowed, key=lambda c: (cost(c) / min(c, left), c))
            else:
                space = preferred if preferred in allowed else allowed[0]
            b = len(filled)
            filled.append(0)
        bins.append(b)
        offsets.append(filled[b])
        filled[b] += size
        left -= size
        space -= size
        if space:
            room.setdefault(space, []).append(b)
            rooms |= 1 << space
    return bins, offsets, filled


def pack_pool(sizes: list[int], permitted: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """The cheapest packing found: bin and offset per size, and the final length per bin."""
    permitted = tuple(sorted(permitted))
    ladder = np.array(permitted)
    best = None
    for preferred in (None, *permitted):
        bins, offsets, filled = _pack(sizes, permitted, preferred)
        lengths = ladder[np.searchsorted(ladder, filled)]
        total = float(cost(lengths).sum()) if len(lengths) else 0.0
        if best is None or total < best[0]:
            best = total, bins, offsets, lengths.tolist()
    return best[1:]


def pieces(docs: DataFrame, longest: int) -> DataFrame:
    """(doc_id, piece, start, length) of (doc_id, length): full pieces and a rest."""
    size = F.coalesce("length", F.lit(0))
    last = F.greatest(F.lit(0), F.ceil(size / longest) - 1).cast("int")
    cut = docs.select("doc_id", size.cast("bigint").alias("size"), F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("bigint") * longest
    return cut.select("doc_id", "piece", start.alias("start"), F.least(F.lit(longest), F.col("size") - start).alias("length"))


def pack(docs: DataFrame, permitted: tuple[int, ...] = LENGTHS, pool: int = POOL) -> DataFrame:
    """PACKED rows of (doc_id, length) rows."""
    permitted = tuple(sorted(permitted))
    cut = durable(pieces(docs, permitted[-1]))
    # Round robin over sorted rows: even parts however often a row repeats, the same in reruns.
    dealt = cut.repartition(rows(cut.count(), pool)).sortWithinPartitions(F.xxhash64("doc_id", "piece"), "doc_id", "piece", "length")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # Bins are numbered within their partition.
        first = TaskContext.get().partitionId() << 32

        def flush(pool_rows: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal first
            length = pool_rows["length"].to_numpy()
            order = np.argsort(-length, kind="stable")
            order = order[length[order] > 0]
            bins, offsets, lengths = pack_pool(length[order].tolist(), permitted)
            bin_id, bin_length, offset = (np.full(len(length), -1, np.int64) for _ in range(3))
            if len(order):
                bin_id[order] = np.array(bins) + first
                bin_length[order] = np.array(lengths)[bins]
                offset[order] = offsets
            first += len(lengths)
            absent = bin_id < 0
            out = pool_rows
            for name, values in (("bin_id", bin_id), ("bin_length", bin_length.astype(np.int32)), ("offset", offset.astype(np.int32))):
                out = out.append_column(name, pa.array(values, mask=absent))
            yield from out.combine_chunks().to_batches()

        held, count = [], 0
        for batch in batches:
            while batch.num_rows:
                taken = batch.slice(0, pool - count)
                held.append(taken)
                count += taken.num_rows
                batch = batch.slice(taken.num_rows)
                if count == pool:
                    yield from flush(pa.Table.from_batches(held))
                    held, count = [], 0
        if held:
            yield from flush(pa.Table.from_batches(held))

    return dealt.mapInArrow(packed, PACKED)
