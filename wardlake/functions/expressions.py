"""Small Column helpers shared by every function module.

All of them compose built-in Spark expressions, so a plan that uses them stays
inside the JVM and never starts a Python worker.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str

# Array length handled by one quadratic scan in `running_totals`.
_SCAN_BLOCK = 256


def as_column(value: ColumnLike) -> Column:
    """A column from a name or an expression."""
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and hand it to `body`.

    Without it an expensive expression that is mentioned several times (a regex
    scan, an HMAC) is evaluated several times, because the optimizer inlines
    aliases into filters and only shares work outside conditionals.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is evaluated exactly once.

    A generator over a one-element array stays a plan node of its own, so the value
    is not inlined into later projections and filters that mention it several times.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def ascii_lower(text: Column) -> Column:
    """Lowercase only A-Z, as a case rule for hosts and identifiers needs."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_upper(text: Column) -> Column:
    """Uppercase only a-z."""
    return F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def trim_chars(text: Column, charset: str) -> Column:
    """Trim any of the given characters from both ends (regex class body)."""
    return F.regexp_replace(text, f"^[{charset}]+|[{charset}]+$", "")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units (Spark's `length` counts code points)."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("bigint")


@cache
def empty_array(element_type: str) -> Column:
    """A typed empty array; an unresolved expression, so one serves every plan."""
    return F.array().cast(f"array<{element_type}>")


def _scan(values: Column) -> Column:
    """Exclusive running sums plus the total of a short array."""
    start = F.struct(F.lit(0).cast("bigint").alias("total"), empty_array("bigint").alias("sums"))
    return F.aggregate(
        values,
        start,
        lambda acc, v: F.struct(
            (acc["total"] + v).alias("total"),
            F.concat(acc["sums"], F.array(acc["total"])).alias("sums"),
        ),
    )


def running_totals(values: Column) -> Column:
    """Exclusive running sums of an `array<bigint>`.

    Appending to an array inside `aggregate` copies it, so one pass over n
    elements costs n². Long arrays are cut into blocks that are scanned alone and
    then shifted by the scanned block totals, which keeps the cost near linear.
    """

    def blocked(arr: Column) -> Column:
        last_block = F.floor((F.size(arr) - 1) / F.lit(_SCAN_BLOCK)).cast("int")
        scans = F.transform(
            F.sequence(F.lit(0), last_block),
            lambda b: _scan(F.slice(arr, b * _SCAN_BLOCK + 1, F.lit(_SCAN_BLOCK))),
        )
        return let(
            scans,
            lambda s: F.flatten(
                F.zip_with(
                    s,
                    _scan(F.transform(s, lambda x: x["total"]))["sums"],
                    lambda block, offset: F.transform(block["sums"], lambda v: v + offset),
                )
            ),
        )

    return let(
        values,
        lambda arr: F.when(F.size(arr) <= _SCAN_BLOCK, _scan(arr)["sums"]).otherwise(blocked(arr)),
    )


def interleave(gaps: Column, fillers: Column) -> Column:
    """Join n+1 gaps and n fillers back into one string, alternating."""
    pairs = F.zip_with(gaps, fillers, lambda g, f: F.array(g, F.coalesce(f, F.lit(""))))
    return F.array_join(F.flatten(pairs), "")


def regex_quote(literal: Column) -> Column:
    r"""Quote a literal for a Java pattern; an embedded `\E` is re-opened."""
    return F.concat(F.lit("\\Q"), F.replace(literal, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
