"""Approximate nearest neighbours by largest inner product, over balanced posting lists.

Centroids are fitted on a bounded sample; each list gets the vectors nearest to its
centroid, and vectors near a boundary go to several lists. Lists are cut into blocks of
equal size, so a centroid with very many vectors is many small tasks. A query walks a
graph that links each centroid to its nearest ones and selects every list whose centroid
is at most `PROBE_RATIO` times as far as the nearest; no number caps the lists. Blocks of
queries then meet blocks of lists, and the best of each meeting are merged. A query first
reads the nearest lists, about the square root of all; the k-th best score found there is a
bound, and the other lists return only what reaches it. So what is merged grows far slower
than the number of lists, and nothing that could be among the k best is left out.

One more component turns inner product into distance: vectors get sqrt(M² - |x|²) for the
largest norm M, queries get 0.

Defined results: a vector that is null, zero, or has a null or non-finite component, and
one without an id, takes no part. Nor does one whose number of components is not the most
frequent (the larger one, of two). Rows with the id of a query count as the query's own.
Of equal ids, the best row counts. With k candidates or fewer, all are returned. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlake.llm.common import durable

K = 20
# Rows that the centroids are fitted on: a bound on the driver's memory and time. Recall
# is measured against brute force over all rows.
SAMPLE_ROWS = 20_000
# Vectors per list that the number of lists aims at, and the most lists.
LIST_ROWS = 512
MOST_LISTS = 2_048
ROUNDS = 8
# A vector goes to up to MOST_REPLICAS lists whose distance is within the ratio of the least.
REPLICA_RATIO = 1.02
MOST_REPLICAS = 3
# A query reads the lists whose distance is within the ratio of the least.
PROBE_RATIO = 1.15
# Links of each centroid in the graph, and nodes where every walk starts.
LINKS = 16
ENTRIES = 8
# Vectors and queries that meet in one task's step.
BLOCK = 4_096
QUERY_BLOCK = 1_024


def _squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids."""
    d = (x * x).sum(1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(1)[None]
    return np.maximum(d, 0)


def fit_centroids(sample: np.ndarray, lists: int, seed: int = 0) -> np.ndarray:
    """K-means whose assignment charges a list for being larger than its share."""
    sample = np.unique(sample, axis=0)
    lists = max(1, min(lists, len(sample)))
    rng = np.random.default_rng(seed)
    centroids = sample[np.sort(rng.choice(len(sample), lists, replace=False))].copy()
    load = np.zeros(lists)
    for _ in range(ROUNDS if lists > 1 else 1):
        d = np.concatenate([_squared(sample[i : i + 2_048], centroids) for i in range(0, len(sample), 2_048)])
        scale = float(d.min(1).mean())
        owner = (d + scale * 0.2 * (load / (len(sample) / lists))[None]).argmin(1)
        load = np.bincount(owner, minlength=lists).astype(float)
        for dim in range(sample.shape[1]):
            sums = np.bincount(owner, sample[:, dim], lists)
            centroids[:, dim] = np.where(load > 0, sums / np.maximum(load, 1), centroids[:, dim])
    return centroids


class CentroidGraph:
    """Centroids, each linked to its nearest ones, searched in memory."""

    def __init__(self, **arrays: np.ndarray) -> None:
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, centroids: np.ndarray) -> CentroidGraph:
        """Link every centroid; as many steps as pairs of centroids, whose number is bounded."""
        n = len(centroids)
        links = min(LINKS, n - 1)
        near = np.zeros((n, links), np.int64)
        for at in range(0, n, 1_024):
            d = _squared(centroids[at : at + 1_024], centroids)
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            near[at : at + 1_024] = np.argsort(d, axis=1, kind="stable")[:, :links]
        # Links run both ways, and a ring makes every node reachable.
        pairs = {(i, int(j)) for i in range(n) for j in near[i]} | {(i, (i + 1) % n) for i in range(n) if n > 1}
        pairs |= {(j, i) for i, j in pairs}
        linked = sorted(pairs)
        return cls(
            centroids=centroids,
            targets=np.array([j for _, j in linked], np.int64),
            starts=np.searchsorted(np.array([i for i, _ in linked]), np.arange(n + 1)),
            entries=np.unique(np.linspace(0, n - 1, min(ENTRIES, n)).astype(np.int64)),
        )

    def search(self, x: np.ndarray, ratio: float) -> np.ndarray:
        """Distances to the centroids that the walk met; infinite for the others.

        Every node within `ratio` of the nearest so far is expanded, until none is left.
        """
        n = len(self.centroids)
        seen = np.full((len(x), n), np.inf)
        seen[:, self.entries] = np.sqrt(_squared(x, self.centroids[self.entries]))
        expanded = np.zeros((len(x), n), bool)
        while True:
            open_ = ~expanded & (seen <= ratio * seen.min(1, keepdims=True))
            row, node = np.nonzero(open_)
            if not len(row):
                return seen
            expanded |= open_
            count = self.starts[node + 1] - self.starts[node]
            owner = np.repeat(row, count)
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            target = self.targets[np.repeat(self.starts[node], count) + within]
            fresh = np.unique((owner * n + target)[np.isinf(seen[owner, target])])
            owner, target = fresh // n, fresh % n
            for at in range(0, len(owner), 65_536):
                o, t = owner[at : at + 65_536], target[at : at + 65_536]
                off = x[o] - self.centroids[t]
                seen[o, t] = np.sqrt((off * off).sum(1))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _vectors(x: np.ndarray) -> pa.Array:
    offsets = np.arange(0, x.size + 1, x.shape[1] or 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))


def sound_vectors(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part; v has doubles."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0.0)
    return rows.where(finite)


def nearest(
    vectors: DataFrame, is_query, k: int = K, vec_id: str = "vec_id", vector: str = "embedding",
    list_rows: int = LIST_ROWS, probe_ratio: float = PROBE_RATIO,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where `is_query` (a condition on vec_id) holds."""
    spark = vectors.sparkSession
    context = spark.sparkContext
    result = "query_id long, rank int, vec_id long, score double"
    sound = sound_vectors(vectors, vec_id, vector)
    common = sound.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if common is None:
        return spark.createDataFrame([], result)
    total, dims = common["n"], common["dims"]
    sound = sound.where(F.size("v") == dims)
    # Distances are taken in units of the largest component, so that squares stay finite.
    unit = sound.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    largest = sound.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(x / unit, 2.0)))).first()[0]
    share = int(min(1.0, SAMPLE_ROWS / total) * (1 << 53))
    drawn = sound.where(F.shiftrightunsigned(F.xxhash64("vec_id"), 11) < F.lit(share)).select("v").limit(2 * SAMPLE_ROWS)
    sample = _matrix(drawn.toArrow()["v"])
    if not len(sample):
        sample = _matrix(sound.select("v").limit(1).toArrow()["v"])

    def lifted(x: np.ndarray) -> np.ndarray:
        x = x / unit
        rest = np.sqrt(np.maximum(largest - (x * x).sum(1), 0))
        return np.concatenate([x, rest[:, None]], axis=1)

    def as_query(x: np.ndarray) -> np.ndarray:
        x = x / np.abs(x).max(1, keepdims=True)
        x = x * (np.sqrt(largest) / np.sqrt((x * x).sum(1)))[:, None]
        return np.concatenate([x, np.zeros((len(x), 1))], axis=1)

    lists = min(MOST_LISTS, -(-total // list_rows), -(-len(sample) // 8))
    built = CentroidGraph.build(fit_centroids(lifted(sample), lists))
    # At most MOST_LISTS centroids and their links.
    shared = context.broadcast(vars(built))
    n_lists = len(built.centroids)

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = CentroidGraph(**shared.value)
        for batch in batches:
            for part in (batch.slice(at, 512) for at in range(0, batch.num_rows, 512)):
                x = _matrix(part.column(1))
                seen = graph.search(lifted(x), REPLICA_RATIO)
                order = np.argsort(seen, axis=1, kind="stable")[:, :MOST_REPLICAS]
                far = np.take_along_axis(seen, order, 1)
                row, rank = np.nonzero((far <= REPLICA_RATIO * far[:, :1]) | (np.arange(order.shape[1]) == 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(order[row, rank]), pa.array(rank == 0), part.column(0).take(pa.array(row)), _vectors(x[row])],
                    names=["list", "first", "vec_id", "v"],
                )

    posting = durable(sound.mapInArrow(posted, "list long, first boolean, vec_id long, v array<double>"))
    # At most MOST_LISTS rows reach the driver.
    sizes = {r["list"]: (r["n"], r["own"]) for r in posting.groupBy("list").agg(F.count("*").alias("n"), F.count_if("first").alias("own")).collect()}
    owned = np.array([sizes.get(i, (0, 0))[1] for i in range(n_lists)])

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = CentroidGraph(**shared.value)
        for batch in batches:
            for part in (batch.slice(at, 512) for at in range(0, batch.num_rows, 512)):
                x = _matrix(part.column(1))
                seen = graph.search(as_query(x), probe_ratio)
                chosen = seen <= probe_ratio * seen.min(1, keepdims=True)
                # Lists that hold too few vectors for k results are joined by the next ones.
                for q in np.flatnonzero((chosen * owned).sum(1) <= k):
                    order = np.argsort(_squared(as_query(x[q : q + 1]), graph.centroids)[0], kind="stable")
                    needed = int(np.searchsorted(np.cumsum(owned[order]), k + 1)) + 1
                    chosen[q, order[:needed]] = True
                rank = np.argsort(np.argsort(np.where(chosen, seen, np.inf), axis=1, kind="stable"), axis=1)
                row, at = np.nonzero(chosen)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at), pa.array(rank[row, at] < near), part.column(0).take(pa.array(row)), _vectors(x[row])],
                    names=["list", "near", "query_id", "v"],
                )

    near = int(np.ceil(np.sqrt(n_lists)))
    queries = durable(sound.where(is_query).mapInArrow(probed, "list long, near boolean, query_id long, v array<double>"))
    first = _ranked(_met(posting, queries.where("near").withColumn("bound", F.lit(float("-inf"))), sizes, k), k)
    found = durable(first)
    bounds = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    rest = queries.where("not near").join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    others = _met(posting, durable(rest), sizes, k)
    return _ranked(found.select("query_id", "vec_id", "score").unionByName(others), k)


def _met(posting: DataFrame, queries: DataFrame, sizes: dict[int, tuple[int, int]], k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best that each query finds in each block, at its bound or above.

    Both frames are written ones; `sizes` has the rows of each list.
    """
    asked = {r["list"]: r["n"] for r in queries.groupBy("list").agg(F.count("*").alias("n")).collect()}
    # One row per list, and at most MOST_LISTS of them.
    cuts = F.broadcast(
        posting.sparkSession.createDataFrame(
            [(i, -(-sizes[i][0] // BLOCK), -(-asked[i] // QUERY_BLOCK)) for i in sorted(sizes.keys() & asked.keys())],
            "list long, blocks int, query_blocks int",
        )
    )

    def dealt(df: DataFrame, own: str, other: str, key: str) -> DataFrame:
        """Put each row in one of its own blocks, once for each block of the other side."""
        mine = F.pmod(F.xxhash64(key), F.col(own)).cast("int")
        return df.join(cuts, "list").withColumn("mine", mine).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    key = ["list", "block", "query_block"]
    left = dealt(posting, "blocks", "query_blocks", "vec_id").select("list", F.col("mine").alias("block"), F.col("theirs").alias("query_block"), "vec_id", "v")
    right = dealt(queries, "query_blocks", "blocks", "query_id").select(
        "list", F.col("theirs").alias("block"), F.col("mine").alias("query_block"), "query_id", "v", "bound"
    )

    def meet(posted: pa.Table, asked: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if posted.num_rows and asked.num_rows:
            found = best_pairs(
                asked["query_id"].to_numpy(), _matrix(asked["v"]), asked["bound"].to_numpy(),
                posted["vec_id"].to_numpy(), _matrix(posted["v"]), k,
            )
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found))))

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, "query_id long, vec_id long, score double")


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    """The k best vectors of each query; replicas count once."""
    # One deal by query serves both the merge of replicas and the ranking.
    merged = pairs.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_pairs(query_id, q, bound, vec_id, x, k: int) -> list[np.ndarray]:
    """The k best vectors of a block, at the bound or above, for each query of a block.

    A fast product finds all pairs near the k-th best; their scores are then added up in
    one fixed order, so equal vectors get equal scores and smaller ids win ties.
    """
    # Of equal vectors, only the k+1 smallest ids can be among anyone's k nearest.
    order = np.lexsort((vec_id, *x.T))
    vec_id, x = vec_id[order], x[order]
    changed = np.r_[True, (x[1:] != x[:-1]).any(1)]
    once = changed | np.r_[True, vec_id[1:] != vec_id[:-1]]  # a repeated row counts once
    vec_id, x, changed = vec_id[once], x[once], changed[once]
    start = np.flatnonzero(changed)
    rank = np.arange(len(x)) - np.repeat(start, np.diff(np.r_[start, len(x)]))
    vec_id, x = vec_id[rank <= k], x[rank <= k]
    # Only the best row of an id counts: look past as many rows as ids repeat.
    norm = np.linalg.norm(x, axis=1).max()
    deep = k + len(vec_id) - len(np.unique(vec_id))
    parts = []
    for at in range(0, len(q), 256):
        ids, some = query_id[at : at + 256], q[at : at + 256]
        rough = some @ x.T
        rough[ids[:, None] == vec_id[None]] = -np.inf
        if len(x) > deep:
            least = np.partition(rough, len(x) - deep, axis=1)[:, len(x) - deep]
        else:
            least = np.full(len(some), -np.inf)
        slack = 1e-9 * np.linalg.norm(some, axis=1) * norm
        slack[~np.isfinite(slack)] = np.inf
        least = np.maximum(least, bound[at : at + 256])
        i, j = np.nonzero((rough >= (least - slack)[:, None]) & (rough > -np.inf))
        score = np.zeros(len(i))
        for dim in range(x.shape[1]):
            score += some[i, dim] * x[j, dim]
        chosen = np.lexsort((vec_id[j], -score, i))
        i, j, score = i[chosen], j[chosen], score[chosen]
        seen = np.lexsort((np.arange(len(i)), vec_id[j], i))
        again = np.r_[False, (np.diff(i[seen]) == 0) & (np.diff(vec_id[j[seen]]) == 0)]
        best = np.sort(seen[~again[: len(seen)]])
        i, j, score = i[best], j[best], score[best]
        first = np.searchsorted(i, np.arange(len(some)))
        kept = (np.arange(len(i)) - first[i] < k) & (score >= bound[at : at + 256][i])
        parts.append((ids[i[kept]], vec_id[j[kept]], score[kept]))
    return [np.concatenate(p) for p in zip(*parts)]
