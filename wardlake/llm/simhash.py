"""SimHash near-duplicate groups by a binary-trie self-join.

Fingerprints are grouped first, so copies cost one row. For at most k differing bits, two
fingerprints agree in one of k+1 bit runs at least: each run gives a trie in which that
run comes first, and only node pairs below a shared run can hold a link. Such a subtree
goes to one task, which walks node pairs level by level, adds up the bits in which the
two paths differ and drops a pair once they exceed the budget. A subtree with more than
`SUBTREE` fingerprints is cut again by the same rule in the bits still free; fingerprints
are distinct, so this ends, and no subtree, however hot, is kept whole in one task. A task
returns a spanning forest of its links, never all pairs. Links then meet in connected
components.

Defined results: null, empty and blank texts have fingerprint zero, which links like any
other. Rows with equal ids each keep their row. A null id gets a row; its component is the
smallest id reachable, null if there is none. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.llm.common import durable
from wardlake.llm.components import components

SHINGLE_WORDS = 3
MAX_DIFFERENT_BITS = 2
SEED = 42
# Distinct fingerprints that one task walks at once.
SUBTREE = 20_000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
# Shingles hashed per step, so that a very long text needs little memory.
_BLOCK = 65_536
_ALL_BITS = (1 << 64) - 1


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """SimHash of the shingles of a text, repeats included; 0 without words."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return 0
    if len(found) < width:
        shingles, count = iter([b" ".join(found)]), 1
    else:
        shingles, count = map(b" ".join, zip(*(found[i:] for i in range(width)))), len(found) - width + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    left = count
    while left:
        size = min(left, _BLOCK)
        hashes = np.fromiter((digest(next(shingles), SEED) for _ in range(size)), np.uint64, size)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        left -= size
    return int.from_bytes(np.packbits(ones * 2 > count, bitorder="little").tobytes(), "little")


def fingerprint_of(text: Column) -> Column:
    """SimHash of a text column, as the bit pattern of a bigint."""

    @F.arrow_udf("bigint")
    def hashed(column: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(v.as_py()) for v in column], np.uint64).view(np.int64))

    return hashed(text.cast("string"))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def bit_runs(mask: int, parts: int) -> list[int]:
    """The bits outside `mask`, cut into runs; each result is mask plus one run."""
    free = [b for b in range(63, -1, -1) if not mask >> b & 1]
    bounds = [len(free) * i // parts for i in range(parts + 1)]
    return [mask | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(bounds, bounds[1:])]


def subtrees(distinct: DataFrame, bits: int, most: int) -> DataFrame:
    """(fp, mask, key): the subtree of each trie in which a fingerprint can have links.

    `distinct` has each fp once. Only subtrees with two or more rows are kept.
    """
    masks = bit_runs(0, bits + 1)
    level = distinct.select(
        "fp", F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask")
    ).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    done = None
    while True:
        sizes = level.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        level = durable(level.join(sizes, ["mask", "key"]))
        small = level.where(F.col("n") <= most).drop("n")
        done = small if done is None else done.unionByName(small)
        large = level.where(F.col("n") > most)
        free = 64 - max(m.bit_count() for m in masks)
        if free <= bits or large.isEmpty():
            # With so few free bits a subtree holds no more than 2^free fingerprints.
            return done.unionByName(large.drop("n"))
        cuts = {m: bit_runs(m, bits + 1) for m in masks}
        finer = F.create_map(
            *(part for m, runs in cuts.items() for part in (F.lit(_signed(m)), F.array(*(F.lit(_signed(r)) for r in runs))))
        )
        level = large.select("fp", F.explode(finer[F.col("mask")]).alias("mask")).withColumn(
            "key", F.col("fp").bitwiseAND(F.col("mask"))
        )
        masks = sorted({r for runs in cuts.values() for r in runs})


def trie_pairs(values: np.ndarray, bits: int, leaf: int = 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a sorted array of distinct 64-bit values that differ in `bits` bits or fewer.

    The sorted array is the trie: a node at depth d is the range of values that share
    their first d bits. The frontier holds node pairs (two ranges, the bits in which
    their paths differ); it is cut into pieces, so memory stays bounded.
    """
    n = len(values)
    zero = np.zeros(1, np.int64)
    stack = [(0, zero, zero + n, zero, zero + n, zero)] if n > 1 else []
    while stack:
        depth, a0, a1, b0, b1, differ = stack.pop()
        ready = (a1 - a0) * (b1 - b0) <= leaf * leaf if depth < 64 else np.ones(len(a0), bool)
        if ready.any():
            yield from _leaf_pairs(values, a0[ready], a1[ready], b0[ready], b1[ready], bits)
        a0, a1, b0, b1, differ = (x[~ready] for x in (a0, a1, b0, b1, differ))
        if not len(a0):
            continue
        shift = np.uint64(63 - depth)

        def middle(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            prefix = values[lo] >> shift >> np.uint64(1)
            split = (prefix << np.uint64(1) | np.uint64(1)) << shift
            return np.clip(np.searchsorted(values, split), lo, hi)

        am, bm = middle(a0, a1), middle(b0, b1)
        same = (a0 == b0) & (a1 == b1)
        made = [(a0, am, b0, bm, differ), (am, a1, bm, b1, differ), (a0, am, bm, b1, differ + 1)]
        made.append(tuple(x[~same] for x in (am, a1, b0, bm, differ + 1)))
        parts = [np.concatenate(x) for x in zip(*made)]
        alive = (parts[1] > parts[0]) & (parts[3] > parts[2]) & (parts[4] <= bits)
        # A lone value has no pair with itself.
        alive &= ~((parts[0] == parts[2]) & (parts[1] == parts[3]) & (parts[1] - parts[0] == 1))
        parts = [x[alive] for x in parts]
        for at in range(0, len(parts[0]), 1 << 18):
            stack.append((depth + 1, *(x[at : at + (1 << 18)] for x in parts)))


def _leaf_pairs(values, a0, a1, b0, b1, bits) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Compare the values of small node pairs directly."""
    sizes = (a1 - a0) * (b1 - b0)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + (1 << 20), "right")))
        part = slice(start, stop)
        count = sizes[part]
        owner = np.repeat(np.arange(len(count)), count)
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        width = (b1 - b0)[part][owner]
        i, j = a0[part][owner] + within // width, b0[part][owner] + within % width
        # Within one node each pair counts once.
        once = (i < j) | (a0[part] != b0[part])[owner]
        i, j = i[once], j[once]
        near = np.bitwise_count(values[i] ^ values[j]) <= bits
        yield i[near], j[near]
        start = stop


class Forest:
    """Union-find over 0..n-1 that returns the links which joined two trees."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def add(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _links_below(values: np.ndarray, bits: int) -> list[tuple[int, int]]:
    values = np.unique(values)
    if len(values) < 2:
        return []
    forest, kept = Forest(len(values)), []
    for left, right in trie_pairs(values, bits):
        kept += [(i, j) for i, j in zip(left.tolist(), right.tolist()) if forest.add(i, j)]
    return [(int(values[i]), int(values[j])) for i, j in kept]


def trie_links(distinct: DataFrame, bits: int = MAX_DIFFERENT_BITS, most: int = SUBTREE) -> DataFrame:
    """(a, b): links that connect fingerprints exactly as all pairs within `bits` would."""

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(values: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
            found = []
            for lo, hi in zip(starts, [*starts[1:], len(values)]):
                if hi - lo == 2:
                    x, y = int(values[lo]), int(values[lo + 1])
                    if 0 < (x ^ y).bit_count() <= bits:
                        found.append((x, y))
                else:
                    found += _links_below(values[lo:hi], bits)
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]))
            block = np.concatenate(held, axis=1)
            edges = np.flatnonzero((block[1, 1:] != block[1, :-1]) | (block[2, 1:] != block[2, :-1])) + 1
            if len(edges):  # all but the last subtree are complete
                whole = block[0, : edges[-1]].view(np.uint64)
                yield linked(whole, np.concatenate([[0], edges[:-1]]))
                block = block[:, edges[-1] :]
            held = [block]
        if held and held[0].shape[1]:
            yield linked(held[0][0].view(np.uint64), np.array([0]))

    placed = subtrees(distinct, bits, most)
    return (
        placed.select("fp", "mask", "key").repartition("mask", "key").sortWithinPartitions("mask", "key")
        .mapInArrow(walked, "a long, b long")
    )


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = MAX_DIFFERENT_BITS) -> DataFrame:
    """(doc_id, fp, group, component_id) for every row; group is the smallest fp reachable."""
    hashed = durable(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), fingerprint_of(F.col(text)).alias("fp")))
    distinct = durable(hashed.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    labels = components(durable(trie_links(distinct.select("fp"), bits)))
    known = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("group")
    )
    smallest = known.groupBy("group").agg(F.min("first_id").alias("component_id"))
    return hashed.join(known.join(smallest, "group").select("fp", "group", "component_id"), "fp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = MAX_DIFFERENT_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row."""
    return groups(docs, doc_id, text, bits).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = MAX_DIFFERENT_BITS) -> DataFrame:
    """One row of each group, all columns as they were.

    It is the row with the smallest id (a null id only where there is no other), then the
    smallest fingerprint, then the smallest text.
    """
    member = F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "fp")
    stays = groups(docs, doc_id, text, bits).groupBy("group").agg(F.min(member).alias("m"))
    key = ["lost", "id", "fp"]
    stays = stays.select(F.col("m.lost").alias("lost"), F.coalesce("m.doc_id", F.lit(0)).alias("id"), F.col("m.fp").alias("fp"))
    number = F.col(doc_id).cast("bigint")
    keyed = docs.select(
        F.struct("*").alias("row"), F.col(text).alias("text"), number.isNull().alias("lost"),
        F.coalesce(number, F.lit(0)).alias("id"), fingerprint_of(F.col(text)).alias("fp"),
    )
    # The window shares the join's partitioning.
    order = Window.partitionBy(*key).orderBy(F.col("text").isNull(), "text")
    kept = keyed.join(stays, key, "left_semi").withColumn("nth", F.row_number().over(order))
    return kept.where("nth = 1").select("row.*")
