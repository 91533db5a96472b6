"""Near copies by the Jaccard similarity of five-word shingles.

Candidates come from two places. The trie self-join over 64-bit fingerprints of the shingles
gives groups, and each text of a group meets the group's smallest one. Texts also share one
of `BANDS` keys, each made of `ROWS` minimum hashes; two texts of similarity 0.8 share none
with a chance of (1 - 0.8^ROWS)^BANDS, below one in 10,000. Each text meets the most central
one of each of its keys, the one that shares keys with the most texts. The similarity of all
candidates is computed from their whole sets of shingles, so no text goes that is no near
copy.

What shares a key and is still in different groups then meets through an exact prefix
filter: a text's shingles are ordered from rare to common, and two texts whose similarity is
0.8 have a shingle in common among the rarest few of each. Texts that share a passage, a line
or half of their words, however many they are, have only common shingles in common, which
come last, so they never become candidates. No pair that is similar is lost by the filter.

Defined results: letters are lowered in ASCII only; a text with fewer than five words is
one shingle; null, empty and blank texts are alike. Equal texts are one node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.llm.common import durable, joinable
from wardlake.llm.components import components
from wardlake.llm.simhash import trie_links

SHINGLE_WORDS = 5
LEAST_SIMILARITY = 0.8
BANDS = 24
ROWS = 5
# Differing bits of fingerprints that make candidates.
FINGERPRINT_BITS = 3
# Sizes of sets are dealt to classes: each size up to the first number has its own, then they
# grow by the ratio.
_EXACT_SIZES = 32
_CLASS_RATIO = 1.03
_SEED = 42
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
# Shingles hashed per step, so that a very long text needs little memory.
_BLOCK = 8_192
_RANDOM = np.random.default_rng(_SEED)
_MIX = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_TIMES = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles(text: str | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text; one for a text without words."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    digest = xxhash.xxh64_intdigest
    if len(found) <= width:
        return np.array([digest(b" ".join(found), _SEED)], np.uint64)
    parts = zip(*(found[i:] for i in range(width)))
    return np.unique(np.fromiter((digest(b" ".join(p), _SEED) for p in parts), np.uint64, len(found) - width + 1))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key per band, of the minimum hashes of a set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _BLOCK):
        least = np.minimum(least, ((hashes[at : at + _BLOCK] ^ _MIX[:, None]) * _TIMES[:, None]).min(axis=1))
    keys = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys


def node_of(text: Column) -> Column:
    """The node of a text: equal texts have the same."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set: a bit is 1 if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        bits = np.unpackbits(hashes[at : at + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def sketch_of(text: Column) -> Column:
    """struct<n, fp, bands>: number of distinct shingles, fingerprint and band keys."""

    @F.arrow_udf("struct<n:bigint,fp:bigint,bands:array<bigint>>")
    def sketched(column: pa.Array) -> pa.Array:
        sets = [shingles(v.as_py()) for v in column]
        keys = np.array([band_keys(s) for s in sets], np.uint64).reshape(-1).view(np.int64)
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys))
        prints = np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64)
        return pa.StructArray.from_arrays([pa.array([len(s) for s in sets], pa.int64()), pa.array(prints), bands], names=["n", "fp", "bands"])

    return sketched(text.cast("string"))


def shingles_of(text: Column) -> Column:
    """array<bigint> of the distinct shingles' hashes."""

    @F.arrow_udf("array<bigint>")
    def listed(column: pa.Array) -> pa.Array:
        return pa.array([shingles(v.as_py()).view(np.int64) for v in column], pa.list_(pa.int64()))

    return listed(text.cast("string"))


def _similar_sizes(n: Column, m: Column) -> Column:
    return F.least(n, m) >= LEAST_SIMILARITY * F.greatest(n, m) - 1e-9


def _sets(docs: DataFrame, needed: DataFrame, text: str) -> DataFrame:
    """(node, s): the shingles of the needed nodes, written once."""
    texts = docs.select(node_of(F.col(text)).alias("node"), F.col(text).alias("text"))
    sets = texts.join(joinable(needed), "node", "left_semi").select("node", shingles_of(F.col("text")).alias("s"))
    return durable(sets.groupBy("node").agg(F.first("s").alias("s")))


def similar(docs: DataFrame, pairs: DataFrame, text: str = "text") -> DataFrame:
    """The (a, b) pairs of nodes whose sets of shingles are similar; a pair is listed once."""
    needed = durable(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    sets = _sets(docs, needed, text)
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("s").alias("t")), "b").join(
        sets.select(F.col("node").alias("a"), "s"), "a"
    )
    sized = both.select("a", "b", F.size(F.array_intersect("s", "t")).alias("k"), (F.size("s") + F.size("t")).alias("n"))
    return sized.where(F.col("k") >= LEAST_SIMILARITY * (F.col("n") - F.col("k")) - 1e-9).select("a", "b")


def _least_common(n: Column, m: Column) -> Column:
    """Shingles that sets of sizes n and m have in common if they are similar."""
    return F.ceil(LEAST_SIMILARITY / (1 + LEAST_SIMILARITY) * (n + m) - 1e-9)


def _size_class(n: Column) -> Column:
    above = _EXACT_SIZES + F.floor(F.log(n / float(_EXACT_SIZES)) / float(np.log(_CLASS_RATIO)) + 1e-9)
    return F.when(n <= _EXACT_SIZES, n).otherwise(above).cast("int")


def _class_start(c: Column) -> Column:
    """A bound that no size in the class is below."""
    above = F.ceil(_EXACT_SIZES * F.pow(F.lit(_CLASS_RATIO), c - _EXACT_SIZES) - 1e-6)
    return F.when(c <= _EXACT_SIZES, c).otherwise(above)


def prefix_pairs(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) pairs of nodes in different groups that no prefix rules out; all similar ones are among them.

    `sets` has (node, s), `nodes` has (node, n, group). The smaller set of a pair offers its
    rarest shingles; the larger one offers, for each class of smaller sizes, as many of its
    own as that class needs.
    """
    listed = sets.join(nodes, "node").select("node", "n", "group", F.explode("s").alias("s"))
    # A shingle of a single set has no partner; such ones come first in their set's order.
    often = listed.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    ordered = listed.join(often, "s").groupBy("node", "n", "group").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("common"))
    placed = ordered.select("node", "n", "group", (F.col("n") - F.size("common")).alias("alone"), F.posexplode("common").alias("i", "e"))
    placed = placed.select("node", "n", "group", F.col("e.s").alias("s"), (F.col("alone") + F.col("i")).alias("i"))
    n, i = F.col("n"), F.col("i")
    smaller = placed.where(i <= n - _least_common(n, n)).select("*", _size_class(n).alias("c"), F.lit(True).alias("small"))
    least = F.ceil(LEAST_SIMILARITY * n - 1e-9)
    larger = placed.where(i <= n - _least_common(least, n)).select("*", F.explode(F.sequence(_size_class(least), _size_class(n))).alias("c"))
    larger = larger.where(i <= n - _least_common(F.greatest(_class_start(F.col("c")), least), n)).withColumn("small", F.lit(False))
    offers = durable(smaller.unionByName(larger))
    # Of a shingle's largest group no two members need meet; a shingle of one group is done.
    parts = offers.groupBy("s", "c", "group").agg(F.count("*").alias("size"))
    mixed = parts.groupBy("s", "c").agg(F.max_by("group", "size").alias("main"), F.count("*").alias("groups"))
    mixed = durable(mixed.where("groups > 1").select("s", "c", "main"))
    open_ = durable(offers.join(joinable(mixed), ["s", "c"]))
    x, y = open_.where("small").alias("x"), open_.where("not small").alias("y")

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        m, k = F.col("x.n"), F.col("y.n")
        same = (F.col("x.s") == F.col("y.s")) & (F.col("x.c") == F.col("y.c")) & (F.col("x.group") != F.col("y.group"))
        once = (m < k) | ((m == k) & (F.col("x.node") < F.col("y.node")))
        # The first shingle that two sets share leaves at most so many more.
        reach = 1 + F.least(m - F.col("x.i"), k - F.col("y.i")) - 1
        found = x.join(y, same & once & _similar_sizes(m, k) & (reach >= _least_common(m, k)))
        return found.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))

    rest = met(x.where("group <> main").alias("x"), y).unionByName(met(x.where("group = main").alias("x"), y.where("group <> main").alias("y")))
    return rest.distinct()


def _central_pairs(members: DataFrame) -> DataFrame:
    """(a, b): each member of a key with the most central one, which shares keys with the most texts."""
    ranked = members.withColumn("w", F.sum("size").over(Window.partitionBy("node")))
    middle = F.max_by(F.struct("node", "n"), F.struct("w", "node")).alias("first")
    centres = durable(ranked.groupBy("band", "key").agg(middle))
    stars = members.join(joinable(centres), ["band", "key"])
    stars = stars.where((F.col("node") != F.col("first.node")) & _similar_sizes(F.col("n"), F.col("first.n")))
    return stars.select(F.least("first.node", "node").alias("a"), F.greatest("first.node", "node").alias("b"))


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): each text of a group of the trie self-join with the group's smallest one."""
    labels = components(durable(trie_links(nodes.select("fp").distinct(), FINGERPRINT_BITS))).withColumnRenamed("node", "fp")
    keyed = durable(nodes.join(labels, "fp", "left").select("node", "n", F.coalesce("component", "fp").alias("key")))
    least = keyed.groupBy("key").agg(F.min(F.struct("node", "n")).alias("first"), F.count("*").alias("size"))
    least = durable(least.where("size > 1").select("key", "first"))
    met = keyed.join(joinable(least), "key").where((F.col("node") != F.col("first.node")) & _similar_sizes(F.col("n"), F.col("first.n")))
    return met.select(F.col("first.node").alias("a"), F.col("node").alias("b"))


def links(docs: DataFrame, nodes: DataFrame, text: str = "text") -> DataFrame:
    """(node, component) of every node that is like another one; nodes has (node, n, fp, bands)."""
    placed = nodes.select("node", "n", F.posexplode("bands").alias("band", "key"))
    sizes = durable(placed.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1"))
    members = durable(placed.join(joinable(sizes), ["band", "key"]))
    pairs = durable(_central_pairs(members).unionByName(_fingerprint_pairs(nodes)).distinct())
    found = durable(similar(docs, pairs, text))
    labels = components(found)
    labelled = members.join(labels, "node", "left").select("band", "key", "node", "n", F.coalesce("component", "node").alias("group"))
    labelled = durable(labelled)
    mixed = labelled.groupBy("band", "key").agg((F.min("group") != F.max("group")).alias("open")).where("open")
    open_ = labelled.join(joinable(durable(mixed.select("band", "key"))), ["band", "key"], "left_semi")
    open_ = durable(open_.select("node", "n", "group").distinct())
    more = durable(prefix_pairs(_sets(docs, open_.select("node"), text), open_).join(pairs, ["a", "b"], "left_anti"))
    if more.isEmpty():
        return labels
    return components(durable(found.unionByName(similar(docs, more, text))))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies, all columns as they were.

    It is the row with the smallest id (a null id only where there is no other), then the
    smallest node.
    """
    number = F.col(doc_id).cast("bigint")
    key = [number.isNull().alias("lost"), F.coalesce(number, F.lit(0)).alias("id"), node_of(F.col(text)).alias("node")]
    hashed = durable(docs.select(*key, sketch_of(F.col(text)).alias("s")))
    member = F.min(F.struct("lost", "id", "node")).alias("m")
    nodes = durable(hashed.groupBy("node").agg(member, F.first("s.n").alias("n"), F.first("s.fp").alias("fp"), F.first("s.bands").alias("bands")))
    labels = links(docs, nodes.drop("m"), text)
    grouped = nodes.join(labels, "node", "left").select(F.coalesce("component", "node").alias("group"), "m")
    stays = grouped.groupBy("group").agg(F.min("m").alias("m")).select("m.*")
    keyed = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"), *key)
    # The window shares the join's partitioning.
    names = ["lost", "id", "node"]
    order = Window.partitionBy(*names).orderBy(F.col("text").isNull(), "text")
    kept = keyed.join(stays, names, "left_semi").withColumn("nth", F.row_number().over(order))
    return kept.where("nth = 1").select("row.*")
