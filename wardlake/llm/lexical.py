"""Ranked lexical search over bit-sliced Bloom signatures.

One pass over the texts gives each document a Bloom signature of its terms: a key per term,
and more keys if it occurs twice, four or eight times. Documents of like length share a
block; a block is stored by bit, so that a slice is a bitmap of its documents. A query term
selects some slices, their conjunction overestimates which documents hold the term, and sums
of such bitmaps, weighted with the term and with the most that so many occurrences can add in
a document of that length, bound every document's score from above.

A search reads the signatures twice. First each task returns the documents with the highest
bounds of each item; they are scored exactly, and the k-th score is a threshold. Then every
document whose bound reaches the threshold is scored exactly, however many there are; all
others are provably below it.

Items are the stated query set: they are dealt by hash to blocks of about `ITEM_TERMS` terms
and searched block by block against all documents.

Score: each term weighs w = floor(1000 ln((2N+2)/(2df+1))); with tf occurrences in a document
of n terms it adds w * ((10^9 tf) div (1000 tf + 12 m)), m = 75 + (25 n N) div L, for N
documents with terms and L terms in all. Integers are exact.

Defined results: a null or blank text, or one of separators only, has no terms. Rows with
equal ids each take part, also those with equal texts; a null id comes last among equal
scores. Each row of items gets its own ranking. Documents with score 0 are left out; items
without any result have no rows. Extra columns are ignored. Terms beyond `WIDEST` bits of
signature only make a document be scored more often.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlake.llm.common import is_small, shared_folder

K = 20
# Bits of signature per key, and slices per key: about 1 in 100 absent keys seems present.
KEY_BITS = 10
SLICES = 4
# Occurrences from which a term gets a further key.
LEVELS = (1, 2, 4, 8)
# Documents and bits of a block at most, and bits of the widest signature.
BLOCK_DOCS = 1_024
BLOCK_BITS = 1 << 25
WIDEST = 1 << 22
# Terms of the items that are searched at once, and distinct terms that may be broadcast.
ITEM_TERMS = 20_000
BROADCAST_TERMS = 1_000_000
_SEED = 42
_CACHE_TERMS = 500_000
_LONGEST_KEPT = 48
_LEVEL_STEP = np.uint64(0x9E3779B97F4A7C15)
# Separators become spaces, A-Z become a-z, all else stays.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)

_DOCS = "array<struct<doc_id:bigint,digest:binary,n:bigint,top:bigint>>"
_SCHEMA = f"width int, slices binary, docs {_DOCS}, term binary, df long, n_docs long, n_terms long"


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class _Hashes(dict):
    """64-bit hashes of terms, remembered."""

    def __missing__(self, term: bytes) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(term, _SEED)
        if len(term) <= _LONGEST_KEPT:
            self[term] = value
        return value


def _places(hashes: np.ndarray, level: int, width: int) -> np.ndarray:
    """The slices of each key: one row per hash."""
    h = (hashes + np.uint64(level) * _LEVEL_STEP) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    first, step = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return ((first[:, None] + step[:, None] * np.arange(SLICES, dtype=np.uint64)) % np.uint64(width)).astype(np.int64)


class BlockWriter:
    """Gathers documents by length and turns them into blocks."""

    def __init__(self) -> None:
        self.held: dict[int, list[tuple]] = {}

    def add(self, doc: tuple, hashes: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
        """`doc` is (doc_id, digest, n); yields a block when one is full."""
        keys = sum(int((counts >= at).sum()) for at in LEVELS)
        # Widths grow by the square root of two.
        size = max(0, math.ceil(2 * math.log2(max(keys, 1))))
        width = min(WIDEST, max(64, math.ceil(KEY_BITS * 2 ** (size / 2))))
        block = self.held.setdefault(width, [])
        block.append(((*doc, int(counts.max())), hashes, counts))
        if len(block) >= BLOCK_DOCS or len(block) * width >= BLOCK_BITS:
            yield self._made(width, self.held.pop(width))

    def rest(self) -> Iterator[tuple]:
        while self.held:
            yield self._made(*self.held.popitem())

    @staticmethod
    def _made(width: int, block: list[tuple]) -> tuple:
        hashes = np.concatenate([b[1] for b in block])
        counts = np.concatenate([b[2] for b in block])
        owner = np.repeat(np.arange(len(block)), [len(b[1]) for b in block])
        bits = np.zeros((width, len(block)), bool)
        for level, least in enumerate(LEVELS):
            often = counts >= least
            places = _places(hashes[often], level, width)
            for i in range(SLICES):
                bits[places[:, i], owner[often]] = True
        return width, np.packbits(bits, axis=1).tobytes(), [b[0] for b in block]


def index(docs: DataFrame, wanted: frozenset[bytes] | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write signatures, document frequencies and totals; one pass over the texts.

    Frequencies are counted for the wanted terms, or for all.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(wanted)
    out_schema = pa.schema([
        ("width", pa.int32()), ("slices", pa.binary()),
        ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("top", pa.int64())]))),
        ("term", pa.binary()), ("df", pa.int64()), ("n_docs", pa.int64()), ("n_terms", pa.int64()),
    ])

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=out_schema)

    def signature(block: tuple) -> pa.RecordBatch:
        width, slices, members = block
        listed = [dict(zip(("doc_id", "digest", "n", "top"), m)) for m in members]
        return batch_of([{"width": width, "slices": slices, "docs": listed}])

    def frequencies(df: Counter) -> Iterator[pa.RecordBatch]:
        rows = [{"term": t, "df": n} for t, n in df.items()]
        for at in range(0, len(rows), 10_000):
            yield batch_of(rows[at : at + 10_000])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only, hashes, blocks = shared.value, _Hashes(), BlockWriter()
        df: Counter = Counter()
        n_docs = n_terms = 0
        for batch in batches:
            for row, doc in zip(batch.column(1), batch.column(0)):
                found = terms(value := row.as_py())
                if not found:
                    continue
                counted = Counter(found)
                n_docs += 1
                n_terms += len(found)
                df.update(counted.keys() if only is None else counted.keys() & only)
                hashed = np.fromiter(map(hashes.__getitem__, counted), np.uint64, len(counted))
                times = np.fromiter(counted.values(), np.int64, len(counted))
                digest = hashlib.md5(value.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
                for block in blocks.add((doc.as_py(), digest, len(found)), hashed, times):
                    yield signature(block)
                if len(hashes) > _CACHE_TERMS:
                    hashes = _Hashes()
                if len(df) > _CACHE_TERMS and only is None:
                    yield from frequencies(df)
                    df = Counter()
        for block in blocks.rest():
            yield signature(block)
        yield from frequencies(df)
        yield batch_of([{"n_docs": n_docs, "n_terms": n_terms}])

    read_docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    folder = f"{shared_folder(spark)}/lexical-{uuid.uuid4().hex}"
    read_docs.mapInArrow(read, _SCHEMA).write.parquet(folder)
    return spark.read.parquet(folder)


class Queries:
    """Items of one block with the weights of their terms."""

    def __init__(self, items: list[tuple], df: dict[bytes, int], n_docs: int, n_terms: int) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        self.ids = [i for i, _ in items]
        counted = [Counter(terms(t)) for _, t in items]
        weight = {
            t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for c in counted for t in c
        }
        # A term that no document holds, or that weighs nothing, adds nothing anywhere.
        useful = sorted(t for t, w in weight.items() if w > 0 and df.get(t, 0))
        self.weights = [{t: weight[t] * k for t, k in c.items() if weight[t] > 0 and df.get(t, 0)} for c in counted]
        at = {t: i for i, t in enumerate(useful)}
        self.hashes = np.array([_Hashes()[t] for t in useful], np.uint64)
        most = max((sum(w.values()) for w in self.weights), default=0)
        # Sums of whole weights are exact in either type.
        self.matrix = np.zeros((len(items), len(useful)), np.float32 if most < 1 << 24 else np.float64)
        for row, w in enumerate(self.weights):
            self.matrix[row, [at[t] for t in w]] = list(w.values())

    def length_part(self, n: int) -> int:
        return 75 + 25 * n * self.n_docs // self.n_terms

    def scores(self, text: str | None, chosen: list[int]) -> list[int]:
        """Exact scores of a document for some items."""
        found = terms(text)
        counted, m = Counter(found), self.length_part(len(found))
        out = []
        for item in chosen:
            w = self.weights[item]
            shorter, longer = (w, counted) if len(w) < len(counted) else (counted, w)
            held = [t for t in shorter if t in longer]
            out.append(sum(w[t] * ((1_000_000_000 * counted[t]) // (1000 * counted[t] + 12 * m)) for t in held))
        return out

    def bounds(self, width: int, slices: bytes, n: np.ndarray, top: np.ndarray) -> np.ndarray:
        """Upper bound of every item's score (rows) in every document of a block (columns)."""
        docs = len(n)
        planes = np.frombuffer(slices, np.uint8).reshape(width, -1)
        m = np.array([self.length_part(int(x)) for x in n], np.float64)
        total = np.zeros((len(self.ids), docs))
        rows, held, below = np.arange(len(self.hashes)), None, np.zeros(docs)
        for level in range(len(LEVELS)):
            places = _places(self.hashes[rows], level, width)
            bits = planes[places[:, 0]]
            for i in range(1, SLICES):
                bits &= planes[places[:, i]]
            if held is not None:
                bits &= held
            some = bits.any(axis=1)
            rows, held = rows[some], bits[some]
            if not len(rows):
                break
            most = np.minimum(top, LEVELS[level + 1] - 1) if level + 1 < len(LEVELS) else top
            most = np.maximum(most, 1).astype(np.float64)
            value = 1e9 * most / (1000 * most + 12 * m)
            present = np.unpackbits(held, axis=1, count=docs).astype(self.matrix.dtype)
            total += (self.matrix[:, rows] @ present) * np.maximum(value - below, 0)
            below = np.maximum(value, below)
        return np.where(total > 0, total * (1 + 1e-9) + 1, 0)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, list[dict]]]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield batch.column(0)[row].as_py(), batch.column(1)[row].as_py(), batch.column(2)[row].as_py()


def _bounded(queries: Queries, block: tuple[int, bytes, list[dict]]) -> np.ndarray:
    width, slices, members = block
    return queries.bounds(width, slices, np.array([d["n"] for d in members]), np.array([d["top"] for d in members]))


_FOUND = "doc_id long, digest binary, items array<int>"


def _listed(members: list[tuple]) -> pa.RecordBatch:
    ids, digests, items = zip(*members) if members else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(items, pa.list_(pa.int32()))], names=["doc_id", "digest", "items"]
    )


def _search_block(signatures: DataFrame, docs: DataFrame, queries: Queries, k: int) -> DataFrame:
    """(item, doc_id, score): all that may be among the k best of the items of a block."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(queries)

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        best: list[tuple[np.ndarray, list[tuple]]] = [(np.zeros(0), [])] * len(held.ids)
        for block in _blocks(batches):
            bound, members = _bounded(held, block), block[2]
            take = min(k, len(members))
            order = np.argpartition(-bound, take - 1, axis=1)[:, :take]
            for item in range(len(held.ids)):
                at = order[item][bound[item, order[item]] > 0]
                if not len(at) or (len(best[item][1]) >= k and bound[item, at].max() <= best[item][0].min()):
                    continue
                value = np.concatenate([best[item][0], bound[item, at]])
                named = [*best[item][1], *((members[i]["doc_id"], members[i]["digest"]) for i in at)]
                keep = np.argsort(-value, kind="stable")[:k]
                best[item] = (value[keep], [named[i] for i in keep])
        rows = [(item, v, *name) for item, (value, named) in enumerate(best) for v, name in zip(value.tolist(), named)]
        for at in range(0, len(rows), 10_000):
            items, value, ids, digests = zip(*rows[at : at + 10_000])
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.int32()), pa.array(value), pa.array(ids, pa.int64()), pa.array(digests, pa.binary())],
                names=["item", "bound", "doc_id", "digest"],
            )

    def scored(candidates: DataFrame) -> DataFrame:
        """Exact scores of (doc_id, digest, item) rows, which name each document once an item."""
        chosen = candidates.groupBy("doc_id", "digest").agg(F.collect_list("item").alias("items"))
        folder = f"{shared_folder(spark)}/lexical-{uuid.uuid4().hex}"
        chosen.write.parquet(folder)
        chosen = spark.read.parquet(folder)
        # A candidate's row is two keys and its items; it is sent to all tasks only if there are few.
        chosen = F.broadcast(chosen) if is_small(chosen) else chosen
        texts = docs.withColumn("digest", F.unhex(F.md5("text")))
        same = texts.doc_id.eqNullSafe(chosen.doc_id) & (texts.digest == chosen.digest)
        met = texts.join(chosen, same).select(texts.doc_id, "text", "items")

        def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = shared.value
            for batch in batches:
                ids, items, values = [], [], []
                for doc, text, wanted in zip(batch.column(0), batch.column(1), batch.column(2)):
                    wanted = wanted.as_py()
                    items += wanted
                    values += held.scores(text.as_py(), wanted)
                    ids += [doc.as_py()] * len(wanted)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(items, pa.int32()), pa.array(ids, pa.int64()), pa.array(values, pa.int64())], names=["item", "doc_id", "score"]
                )

        return met.mapInArrow(rated, "item int, doc_id long, score long").where("score > 0")

    found = signatures.mapInArrow(highest, "item int, bound double, doc_id long, digest binary")
    nth = Window.partitionBy("item").orderBy(F.desc("bound"), "doc_id", "digest")
    first = found.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= k).select("doc_id", "digest", "item").distinct()
    place = Window.partitionBy("item").orderBy(F.desc("score"))
    kth = scored(first).withColumn("nth", F.row_number().over(place)).where(F.col("nth") <= k)
    thresholds = np.ones(len(queries.ids))
    # One row per item of the block.
    for row in kth.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).collect():
        thresholds[row["item"]] = row["least"]
    reach = spark.sparkContext.broadcast(thresholds)

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, least = shared.value, reach.value[:, None]
        for block in _blocks(batches):
            near = (bound := _bounded(held, block)) >= least
            near &= bound > 0
            members = block[2]
            yield _listed(
                [(members[i]["doc_id"], members[i]["digest"], np.flatnonzero(near[:, i]).tolist()) for i in np.flatnonzero(near.any(axis=0))]
            )

    left = signatures.mapInArrow(reaching, _FOUND).select("doc_id", "digest", F.explode("items").alias("item")).distinct()
    return scored(left)


def search(
    docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, best first."""
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(terms(value.as_py()), pa.binary())], names=["term"])

    vocabulary = asked.select("text").mapInArrow(words, "term binary")
    size = vocabulary.count()
    distinct = vocabulary.distinct()
    wanted = frozenset(bytes(r[0]) for r in distinct.collect()) if size <= BROADCAST_TERMS else None
    written = index(texts, wanted)
    signatures = written.where("slices IS NOT NULL").select("width", "slices", "docs")
    totals = written.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("terms")).first()
    frequency = written.where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"))
    id_type = dict(asked.dtypes)["item_id"]
    out = spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    if not totals["docs"]:
        return out
    parts = max(1, -(-size // ITEM_TERMS))
    for part in range(parts):
        # A block of items is bounded by its terms; it is all that the driver holds.
        block = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        rows = [(r["item_id"], r["text"]) for r in block.collect()]
        if not rows:
            continue
        held = {t for _, value in rows for t in terms(value)}
        known = frequency if wanted is not None else frequency.join(block.select("text").mapInArrow(words, "term binary").distinct(), "term", "left_semi")
        df = {bytes(r["term"]): r["df"] for r in known.collect()}
        queries = Queries(rows, {t: df[t] for t in held if t in df}, totals["docs"], totals["terms"])
        if not len(queries.hashes):
            continue
        scores = _search_block(signatures, texts, queries, k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        best = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(n, i) for n, i in enumerate(queries.ids)], f"item int, item_id {id_type}")
        out = out.unionByName(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out
