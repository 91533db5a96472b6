"""Quality rules: fixed limits, and robust outliers per language and source.

Per text, built-in expressions count words, symbols, repeated lines and repeated word
windows. Four transformed statistics form a vector. For each language and source, the
minimum covariance determinant is estimated by concentration steps: keep the half of the
rows that is nearest, take its mean and covariance, repeat until the determinant stays;
then reweight once. One start is medians and median deviations, the others are a few
distinct rows drawn by hash; the one that ends with the least determinant is taken. With
a core of half of the rows, up to nearly half of a group may be junk. Every step is an
aggregation over all rows with partial sums, so a source with most of the rows is no
burden. A row whose squared Mahalanobis distance exceeds the limit is rejected.

A variance is never taken below a floor: in clean text some statistics are constant, and
an exact fit would reject every row that differs at all. Groups with few rows are pooled.

Defined results: a null text has no words and fails the base rule. A null language or
source is a group of its own. Rows that fail the base rule do not enter the estimates.
Repeated rows count as often as they occur. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.functions.expressions import computed, let
from wardlake.llm.common import SPACE, durable, is_small, joinable, words

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
WINDOW = 3

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Standard deviations that the vector's components are never taken below. With the limit
# they let each share reject alone: about half of the lines repeated, or two fifths of the
# words in repeated windows (shares are squares of components).
FLOORS = (0.06, 0.05, 0.13, 0.115)
P = len(FLOORS)
# Share of the rows that the determinant is minimised over.
CORE = 0.5
# Concentration steps end when no log determinant changes by more than _STAYS, or here.
STEPS = 30
_STAYS = 1e-7
# Starts besides the medians, and distinct rows in each.
STARTS = 4
START_ROWS = P + 1
# Groups with fewer rows share one estimate.
LEAST_ROWS = 50
# Squared distance beyond which a row is rejected: chi-square with four degrees of freedom
# exceeds it with a chance of 5 in a million.
LIMIT = 30.0


def _repeated_words(found: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the array of words."""

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(placed, lambda s: let(F.sort_array(repeated(s)), spread))

    def repeated(s: Column) -> Column:
        def place(e: Column, i: Column) -> Column:
            twin = (e["h"] == F.get(s, i - 1)["h"]) | (e["h"] == F.get(s, i + 1)["h"])
            return F.when(twin, e["i"])

        return F.filter(F.transform(s, place), lambda x: x.isNotNull())

    def spread(at: Column) -> Column:
        gaps = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda total, g: total + g)

    def window(i: Column) -> Column:
        return F.xxhash64(*(F.get(found, i + k) for k in range(WINDOW)))

    hashes = F.transform(F.sequence(F.lit(0), F.size(found) - WINDOW), window)
    counted = let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h)),
    )
    return F.when(F.size(found) <= WINDOW, F.lit(0).cast("bigint")).otherwise(counted)


def text_statistics(text: Column) -> Column:
    """struct of STATS and n_lines of a whole text."""
    plain = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(plain, "\n", -1), lambda line: line.rlike(f"[^{SPACE}]"))

    def struct(found: Column, filled: Column) -> Column:
        return F.struct(
            F.size(found).cast("bigint").alias("n_words"),
            F.length(F.array_join(found, "")).cast("bigint").alias("word_chars"),
            (F.length(plain) - F.length(F.regexp_replace(plain, "[#*$%&|<>]", ""))).cast("bigint").alias("n_symbols"),
            (F.size(filled) - F.size(F.array_distinct(filled))).cast("bigint").alias("n_dup_lines"),
            _repeated_words(found).alias("n_repeat_words"),
            F.size(filled).cast("bigint").alias("n_lines"),
        )

    return let(words(plain), lambda found: let(lines, lambda filled: struct(found, filled)))


def base_failed() -> Column:
    """The fixed rule over the statistics."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def _vector(s) -> list[Column]:
    """Transformed statistics: log word length, roots of symbol, line and window shares."""
    some = F.greatest(s("n_words"), F.lit(1))
    chars = F.greatest(s("word_chars"), F.lit(1))
    return [
        F.log(chars / some),
        F.sqrt(s("n_symbols") / chars),
        F.sqrt(s("n_dup_lines") / F.greatest(s("n_lines"), F.lit(1))),
        F.sqrt(s("n_repeat_words") / some),
    ]


def _chi2(x: float, p: int) -> float:
    """Chi-square distribution function for even p."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))


def _chi2_quantile(q: float, p: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2(mid, p) < q else (low, mid)
    return low


_CORE_CUT = _chi2_quantile(CORE, P)
# The covariance of the core is too small for the whole by this factor.
_CORE_FACTOR = CORE / _chi2(_CORE_CUT, P + 2)
_REWEIGHT_CUT = _chi2_quantile(0.975, P)
_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _whitened(centres: DataFrame) -> DataFrame:
    """From m_i and covariances c_i_j: m_i and the inverse Cholesky factor w_i_j."""
    df = centres
    for i, j in _PAIRS:
        below = F.col(f"c_{i}_{j}") - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
        # Rounding must not take a pivot below a small part of its floor.
        factor = F.sqrt(F.greatest(below, F.lit((FLOORS[i] / 10) ** 2))) if i == j else below / F.col(f"l_{j}_{j}")
        df = df.withColumn(f"l_{i}_{j}", factor)
    for i in range(P):
        for j in range(i, -1, -1):
            if i == j:
                value = 1 / F.col(f"l_{i}_{i}")
            else:
                value = -sum((F.col(f"l_{i}_{k}") * F.col(f"w_{k}_{j}") for k in range(j, i)), F.lit(0.0)) / F.col(f"l_{i}_{i}")
            df = df.withColumn(f"w_{i}_{j}", value)
    return df.select("grp", "start", *(f"m_{i}" for i in range(P)), *(f"w_{i}_{j}" for i, j in _PAIRS))


def _log_determinant() -> Column:
    """Of the covariance whose inverse Cholesky factor is w_i_j."""
    return -2 * sum((F.log(f"w_{i}_{i}") for i in range(P)), F.lit(0.0))


def _distance(vector: list[Column]) -> Column:
    """Squared distance to the centre and spread in the row's own m_i and w_i_j."""
    off = [vector[i] - F.col(f"m_{i}") for i in range(P)]
    parts = [sum((F.col(f"w_{i}_{j}") * off[j] for j in range(i + 1)), F.lit(0.0)) for i in range(P)]
    return sum((y * y for y in parts), F.lit(0.0))


def _moments(rows: DataFrame, factor: float) -> DataFrame:
    """Mean and floored covariance per group and start of rows with x_i."""
    sums = [F.avg(f"x_{i}").alias(f"m_{i}") for i in range(P)]
    products = [F.covar_pop(f"x_{i}", f"x_{j}").alias(f"v_{i}_{j}") for i, j in _PAIRS]
    found = rows.groupBy("grp", "start").agg(*sums, *products)

    def floored(i: int, j: int) -> Column:
        value = factor * F.col(f"v_{i}_{j}")
        return (value + FLOORS[i] ** 2 if i == j else value).alias(f"c_{i}_{j}")

    return found.select("grp", "start", *(f"m_{i}" for i in range(P)), *(floored(i, j) for i, j in _PAIRS))


def _starts(rows: DataFrame, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A first model per group and start; start 0 is medians and median deviations."""
    ranks = [F.percentile_approx(f"x_{i}", 0.5, 2000).alias(f"m_{i}") for i in range(P)]
    middle = rows.groupBy("grp").agg(*ranks)
    spread = rows.join(small(middle), "grp").groupBy("grp").agg(
        *(F.first(f"m_{i}").alias(f"m_{i}") for i in range(P)),
        *(F.percentile_approx(F.abs(F.col(f"x_{i}") - F.col(f"m_{i}")), 0.5, 2000).alias(f"s_{i}") for i in range(P)),
    )
    # A normal distribution's deviation is 1.4826 times its median deviation.
    start = [
        (F.pow(1.4826 * F.col(f"s_{i}"), 2) + FLOORS[i] ** 2 if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in _PAIRS
    ]
    medians = spread.select("grp", F.lit(0).alias("start"), *(f"m_{i}" for i in range(P)), *start)
    # Equal rows have equal hashes, so copies of one text count once in a draw.
    x = [F.col(f"x_{i}") for i in range(P)]
    drawn = [F.min(F.struct(F.xxhash64(*x, F.lit(k)).alias("h"), *x)) for k in range(STARTS * START_ROWS)]
    listed = rows.groupBy("grp").agg(F.array(*drawn).alias("drawn")).select("grp", F.posexplode("drawn").alias("k", "row"))
    few = listed.select("grp", (F.floor(F.col("k") / START_ROWS) + 1).cast("int").alias("start"), "row.*")
    return _whitened(medians.unionByName(_moments(few, 1.0)))


def fit(rows: DataFrame, small: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Centre and inverse Cholesky factor per group, of rows with grp and x_i.

    `small` marks tables of a few rows per group for their joins with the rows.
    """
    vector = [F.col(f"x_{i}") for i in range(P)]
    key = ["grp", "start"]

    def placed(model: DataFrame) -> DataFrame:
        return rows.join(small(model), "grp").select(*key, *(f"x_{i}" for i in range(P)), _distance(vector).alias("d2"))

    model, done = durable(_starts(rows, small)), None
    for _ in range(STEPS):
        near = placed(model)
        cut = near.groupBy(*key).agg(F.percentile_approx("d2", CORE, 2000).alias("cut"))
        core = near.join(small(cut), key).where("d2 <= cut")
        was = model.select(*key, _log_determinant().alias("was"))
        after = _whitened(_moments(core, _CORE_FACTOR)).join(small(was), key)
        after = durable(after.withColumn("stays", F.abs(_log_determinant() - F.col("was")) <= _STAYS).drop("was"))
        ended = after.where("stays").drop("stays")
        done = ended if done is None else done.unionByName(ended)
        model = after.where("not stays").drop("stays")
        if model.isEmpty():
            break
    # Determinants that are equal up to rounding leave the earlier start.
    every = done.unionByName(model)
    best = F.min_by(F.struct(*every.columns), F.struct(F.round(_log_determinant(), 5), "start")).alias("best")
    model = durable(every.groupBy("grp").agg(best).select("best.*"))
    near = placed(model)
    # The nearest row stays in even where all are far, so that no group is lost.
    cut = near.groupBy(*key).agg(F.greatest(F.lit(_REWEIGHT_CUT), F.percentile_approx("d2", 0.5, 2000)).alias("cut"))
    core = near.join(small(cut), key).where("d2 <= cut")
    return durable(_whitened(_moments(core, 1.0)).drop("start"))


def _grouped(df: DataFrame, language: str, source: str) -> DataFrame:
    """Add the key of language and source; null is a value of its own."""
    parts = [part for c in (language, source) for part in (F.col(c).isNull(), F.col(c).cast("string"))]
    return df.withColumn("grp", F.xxhash64(*parts))


def _sound_vectors(stats: DataFrame) -> DataFrame:
    """Add the group key, base_failed and the vector x_i."""
    keyed = _grouped(stats, "lang", "source").withColumn("base_failed", base_failed())
    for i, x in enumerate(_vector(F.col)):
        keyed = keyed.withColumn(f"x_{i}", x)
    return keyed


def fit_groups(stats: DataFrame) -> DataFrame:
    """The estimate that holds for each group key; small groups share the one of key 0."""
    sound = _sound_vectors(stats).where(~F.col("base_failed")).select("grp", *(f"x_{i}" for i in range(P)))
    sizes = sound.groupBy("grp").agg(F.count("*").alias("n"))
    groups = durable(sizes.select("grp", F.when(F.col("n") >= LEAST_ROWS, F.col("grp")).otherwise(F.lit(0)).alias("own")))
    # Medians, cuts and estimates have no more rows than `groups`, whose size is checked.
    small = F.broadcast if is_small(groups) else lambda df: df
    rows = durable(sound.join(small(groups), "grp").select(F.col("own").alias("grp"), *(f"x_{i}" for i in range(P))))
    model = fit(rows, small)
    return durable(groups.join(model.withColumnRenamed("grp", "own"), "own").drop("own"))


def judge(stats: DataFrame, model: DataFrame, limit: float = LIMIT) -> DataFrame:
    """Add base_failed, d2 and kept to rows that have STATS, n_lines, lang and source."""
    judged = _sound_vectors(stats).join(joinable(model), "grp", "left").withColumn("d2", _distance([F.col(f"x_{i}") for i in range(P)]))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= limit)).drop(
        "grp", *(f"x_{i}" for i in range(P)), *(f"m_{i}" for i in range(P)), *(f"w_{i}_{j}" for i, j in _PAIRS)
    )


def _measured(docs: DataFrame, carried: Column, text: str, language: str, source: str) -> DataFrame:
    """`carried`, lang, source and the statistics of every row."""
    named = docs.select(
        carried, F.col(language).alias("lang"), F.col(source).alias("source"), F.col(text).cast("string").alias("text")
    )
    return computed(named, "s", text_statistics(F.col("text"))).drop("text").select("*", "s.*").drop("s")


def quality(docs: DataFrame, limit: float = LIMIT, doc_id: str = "doc_id", text: str = "text", language: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, STATS, base_failed, kept and the squared distance of every row."""
    stats = durable(_measured(docs, F.col(doc_id).alias("doc_id"), text, language, source))
    return judge(stats, fit_groups(stats), limit).select("doc_id", *STATS, "base_failed", "kept", "d2")


def keep_sound(docs: DataFrame, limit: float = LIMIT, text: str = "text", language: str = "lang", source: str = "source") -> DataFrame:
    """The rows that pass, all columns as they were.

    Texts are measured once for the estimates and once more for the decision, so that they
    need not be shuffled.
    """
    model = fit_groups(durable(_measured(docs, F.lit(0).alias("row"), text, language, source)))
    whole = _measured(docs, F.struct("*").alias("row"), text, language, source)
    return judge(whole, model, limit).where("kept").select("row.*")
