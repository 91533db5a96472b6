"""Embedding whitening by spectrum slicing.

Vectors become integers, floor(256 * c). Their covariance over the distinct vectors is
summed on the executors, from entries that are centred exactly (n * x - S) before they
are multiplied; only d x d sums travel. The leading eigenvalues are then found on the
driver, which holds d x d numbers and no rows: the signs of an LDL^T factorisation of
V - s I count the eigenvalues above s, bisection isolates the k-th one by such counts,
Rayleigh quotient iteration converges to it cubically, and counts on either side of the
result certify its number. Rows are whitened in parallel with d x 4 numbers.

Defined results: a vector that is null, empty, or has a null or non-finite component, or
one whose 256-fold leaves the range of a bigint, takes no part. Nor does one whose number
of components is not the most frequent (the larger one, of two). Rows with a null or
repeated id each keep their rows. Components whose eigenvalue is not above rounding error
are left out, so fewer than five distinct vectors, or vectors in a plane, give fewer than
four. Equal eigenvalues get some orthonormal vectors of their space. A deviation beyond
the range of a bigint is null. Of each component's two signs, its largest entry is
positive. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.functions.expressions import computed
from wardlake.llm.common import durable

COMPONENTS = 4
SCALE = 256.0
# Rows that a task multiplies at once.
BLOCK = 4_096
_EXACT = float(1 << 62)
_EPS = np.finfo(np.float64).eps


def factor_signs(matrix: np.ndarray) -> int:
    """Number of positive eigenvalues of a symmetric matrix, from the signs of L D L^T.

    Blocks of D are 1 x 1 or 2 x 2, chosen as Bunch and Kaufman do, so that factors of an
    indefinite matrix stay bounded. A zero pivot counts as not positive.
    """
    a = np.array(matrix, np.float64)
    alpha = (1 + np.sqrt(17)) / 8
    positive, k, n = 0, 0, len(a)

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        width = 1
        if k + 1 < n:
            below = np.abs(a[k + 1 :, k])
            r = k + 1 + int(below.argmax())
            largest = below[r - k - 1]
            if largest > 0 and abs(a[k, k]) < alpha * largest:
                row = np.abs(a[k:, r])
                row[r - k] = 0
                other = row.max()
                if abs(a[k, k]) * other >= alpha * largest * largest:
                    pass
                elif abs(a[r, r]) >= alpha * other:
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    width = 2
        block = a[k : k + width, k : k + width]
        if width == 1:
            positive += int(block[0, 0] > 0)
            if block[0, 0] != 0:
                column = a[k + 1 :, k]
                a[k + 1 :, k + 1 :] -= np.outer(column, column / block[0, 0])
        else:
            # Such a block is indefinite by its choice: one eigenvalue of either sign.
            positive += 1
            column = a[k + 2 :, k : k + 2]
            a[k + 2 :, k + 2 :] -= column @ np.linalg.solve(block, column.T)
        k += width
    return positive


def count_above(v: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of V above a shift."""
    return factor_signs(v - shift * np.eye(len(v)))


def _refine(v: np.ndarray, start: float, found: list[np.ndarray], seed: int) -> tuple[float, np.ndarray]:
    """An eigenpair from a shift beside it: two inverse steps, then Rayleigh quotient iteration."""
    size = len(v)
    eye, norm = np.eye(size), max(np.abs(v).sum(1).max(), np.finfo(float).tiny)
    basis = np.array(found).reshape(-1, size)

    def apart(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - basis.T @ (basis @ x)
        return x / np.linalg.norm(x)

    x, best = apart(np.random.default_rng(seed).normal(size=size)), None
    shift = start
    for step in range(40):
        try:
            z = np.linalg.solve(v - shift * eye, x)
        except np.linalg.LinAlgError:
            z = np.linalg.solve(v - (shift + 4 * _EPS * norm) * eye, x)
        if not np.isfinite(z).all():
            break
        x = apart(z / np.abs(z).max())
        value = float(x @ (v @ x))
        residual = np.linalg.norm(v @ x - value * x)
        if best is None or residual < best[0]:
            best = (residual, value, x)
        elif step > 4:
            break
        if step >= 2:
            shift = value
    return best[1], best[2]


def leading_pairs(v: np.ndarray, most: int = COMPONENTS) -> list[tuple[float, np.ndarray]]:
    """The largest eigenvalues with unit vectors, largest first; those above rounding error only."""
    size = len(v)
    bound = float(np.abs(v).sum(1).max()) if size else 0.0
    if not bound > 0:
        return []
    tolerance = 8 * size * _EPS * bound
    pairs: list[tuple[float, np.ndarray]] = []
    known = {-bound: size, bound * 1.01: 0}

    def counted(shift: float) -> int:
        if shift not in known:
            known[shift] = count_above(v, shift)
        return known[shift]

    for k in range(1, min(most, size) + 1):
        if counted(tolerance) < k:
            break
        low = max(s for s, c in known.items() if c >= k)
        high = min(s for s, c in known.items() if c < k)
        while True:
            # Counts isolate the k-th one, unless it has equals within rounding error.
            while high - low > tolerance and (counted(low) != k or counted(high) != k - 1):
                middle = (low + high) / 2
                low, high = (middle, high) if counted(middle) >= k else (low, middle)
            value, vector = _refine(v, (low + high) / 2, [p[1] for p in pairs], k)
            sure = counted(value - tolerance) >= k and counted(value + tolerance) < k
            if sure or high - low <= tolerance:
                break
            middle = (low + high) / 2
            low, high = (middle, high) if counted(middle) >= k else (low, middle)
        if not sure:
            raise ArithmeticError(f"counts do not certify eigenvalue {k}: {value} in [{low}, {high}]")
        pairs.append((value, vector if vector[np.abs(vector).argmax()] > 0 else -vector))
    return sorted(pairs, key=lambda p: -p[0])


def integer_vector(vector: Column) -> Column:
    """array<bigint> of floor(256 * c); null if the vector takes no part."""
    scaled = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))
    wide = F.transform(vector, lambda c: c.cast("double") * SCALE)
    fits = F.forall(wide, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(1 << 62)))
    return F.when((F.size(vector) > 0) & F.coalesce(fits, F.lit(False)), F.transform(scaled, lambda c: c.cast("bigint")))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S exactly: as int64 where that holds it, else as Python integers."""
    if n * float(np.abs(x).max(initial=0)) + max(map(abs, sums)) < _EXACT:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def covariance(fit: DataFrame, size: int, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of the vectors x of `fit`, divisor n; tasks send d x d sums, which Spark adds up."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            x = _matrix(batch.column(0), size)
            for at in range(0, len(x), BLOCK):
                y = _centred(x[at : at + BLOCK], n, sums).astype(np.float64) / n
                total += y.T @ y
        rows = pa.ListArray.from_arrays(np.arange(size + 1, dtype=np.int32) * size, pa.array(total.reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), rows], names=["i", "row"])

    # Integer keys and one sum per entry: the merge is an aggregation with map-side sums.
    parts = fit.select("x").mapInArrow(summed, "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "c")).groupBy("i", "j").agg(F.sum("c").alias("c")).collect()
    v = np.zeros((size, size))
    for cell in cells:
        v[cell.i, cell.j] = cell.c / n
    return (v + v.T) / 2


def whitened(
    x: DataFrame, size: int, n: int, sums: list[int], pairs: list[tuple[float, np.ndarray]], *carried: str
) -> DataFrame:
    """Add deviation and w, the whitened components, to (carried..., x)."""
    projection = np.array([vector / np.sqrt(value) for value, vector in pairs]).T

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _centred(_matrix(batch.column(len(carried)), size), n, sums)
            if y.dtype != object and size * float(np.abs(y).max(initial=0)) ** 2 < _EXACT:
                deviation = pa.array((y * y).sum(1))
            else:
                exact = [sum(int(c) ** 2 for c in row) for row in y]
                deviation = pa.array([d if d < 1 << 63 else None for d in exact], pa.int64())
            w = (y.astype(np.float64) / n) @ projection
            offsets = np.arange(len(w) + 1, dtype=np.int32) * projection.shape[1]
            columns = [batch.column(i) for i in range(len(carried))]
            yield pa.RecordBatch.from_arrays(
                [*columns, deviation, pa.ListArray.from_arrays(offsets, pa.array(w.reshape(-1)))], names=[*carried, "deviation", "w"]
            )

    kinds = dict(x.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carried), "deviation long", "w array<double>"])
    return x.select(*carried, "x").mapInArrow(projected, schema)


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row per vector and component."""
    spark = vectors.sparkSession
    x = computed(vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")), "x", integer_vector(F.col("v")))
    rows = durable(x.where("x IS NOT NULL").select("vec_id", "x"))
    sizes = rows.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    schema = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    schema = schema.format(dict(rows.dtypes)["vec_id"])
    if sizes is None:
        return spark.createDataFrame([], schema)
    size = sizes["size"]
    rows = rows.where(F.size("x") == size)
    fit = durable(rows.select("x").distinct())
    totals = (
        fit.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.count("*").alias("n"), F.sum(F.col("c").cast("decimal(38,0)")).alias("s"))
        .orderBy("i").collect()
    )
    n, sums = totals[0]["n"], [int(t["s"]) for t in totals]
    v = covariance(fit, size, n, sums)
    pairs = leading_pairs(v, most)
    if not pairs:
        return spark.createDataFrame([], schema)
    k = len(pairs)
    checked = whitened(fit, size, n, sums, pairs).select(*(F.col("w")[i].alias(f"w{i}") for i in range(k)))
    # covar_pop centres as it goes and merges partial results exactly in kind.
    entries = checked.agg(*(F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i in range(k) for j in range(i, k))).first()
    error = max(abs(entries[f"c{i}_{j}"] - (i == j)) for i in range(k) for j in range(i, k))
    shares = F.array(*(F.lit(float(value / np.trace(v))) for value, _ in pairs))
    return (
        whitened(rows, size, n, sums, pairs, "vec_id").select("vec_id", "deviation", F.posexplode("w").alias("p", "whitened"))
        .select(
            "vec_id", (F.col("p") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
            F.get(shares, F.col("p")).alias("explained"), F.lit(float(error)).alias("identity_error"),
        )
    )
