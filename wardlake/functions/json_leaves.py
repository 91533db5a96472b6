"""String leaves of arbitrary JSON.

JSON of unknown shape has no built-in that walks it, so two small Arrow functions take
the leaves out and put them back. Only string values whose content changes are written
anew; every other byte of the text stays as it is. Detection and masking in between are
Spark expressions over `array<string>`, row by row and without a shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlake.functions.expressions import ColumnLike, as_column, computed, empty_array, let
from wardlake.functions.masking import redact

# The tokens of JSON.
_TOKEN = re.compile(
    r'[ \t\n\r]*+(?:(?P<string>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*+")'
    r"|(?P<mark>[][{},:])|(?P<plain>-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?+|true|false|null))"
)
_BLANK = re.compile(r"[ \t\n\r]*")
# Rows of an Arrow batch that are Python values at a time.
_ROWS_AT_ONCE = 64


def string_tokens(text: str, with_paths: bool = False) -> list[tuple[int, int, str | None, int]] | None:
    """(start, end, path, depth) of every string value, quotes included; None if the text is no JSON.

    Containers are kept on a stack of their own, so nesting may be of any depth. Strings
    that hold half a surrogate pair are no JSON. Paths, which may be long, are made on request.
    """
    found: list[tuple[int, int, str | None, int]] = []
    # Of each open container, the index or the key that the next value has in it.
    stack: list[int | str | None] = []
    at, state = 0, "value"
    while state != "end":
        token = _TOKEN.match(text, at)
        if token is None:
            return None
        at = token.end()
        mark, string = token["mark"], token["string"]
        if string is not None and "\\u" in string and not _whole_characters(string):
            return None
        if state in ("key", "key or }") and string is not None:
            stack[-1] = json.loads(string)
            state = ":"
        elif state == ":" and mark == ":":
            state = "value"
        elif state == ", or close" and mark == ",":
            if isinstance(stack[-1], int):
                stack[-1] += 1
                state = "value"
            else:
                state = "key"
        elif state in ("value", "value or ]") and mark in ("[", "{"):
            stack.append(0 if mark == "[" else None)
            state = "value or ]" if mark == "[" else "key or }"
        elif (
            state == ", or close" and mark == ("]" if isinstance(stack[-1], int) else "}")
            or (state, mark) in (("key or }", "}"), ("value or ]", "]"))
        ):
            stack.pop()
            state = ", or close" if stack else "end"
        elif state in ("value", "value or ]") and mark is None:
            if string is not None:
                path = "$" + "".join(f"[{k}]" if isinstance(k, int) else f".{k}" for k in stack) if with_paths else None
                found.append((*token.span("string"), path, len(stack)))
            state = ", or close" if stack else "end"
        else:
            return None
    return found if _BLANK.fullmatch(text, at) else None


def _whole_characters(token: str) -> bool:
    try:
        json.loads(token).encode("utf-8")
    except UnicodeEncodeError:
        return False
    return True


def _in_parts(rows: Iterator, kind: pa.DataType) -> pa.Array:
    """An Arrow array of many rows, of which only some are Python values at a time."""
    parts = []
    while part := list(islice(rows, _ROWS_AT_ONCE)):
        parts.append(pa.array(part, kind))
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


@F.arrow_udf(T.ArrayType(T.StringType()))
def string_leaves(values: pa.Array) -> pa.Array:
    """Contents of the string values, in order; NULL if the text is no JSON."""

    def rows():
        for value in values:
            raw = value.as_py()
            tokens = None if raw is None else string_tokens(raw)
            yield None if tokens is None else [json.loads(raw[s:e]) for s, e, _, _ in tokens]

    return _in_parts(rows(), pa.list_(pa.string()))


@F.arrow_udf(T.StringType())
def replace_leaves(values: pa.Array, replacements: pa.Array) -> pa.Array:
    """The text with the string values that differ from their replacements written anew."""

    def rows():
        for value, replacement in zip(values, replacements):
            raw, texts = value.as_py(), replacement.as_py()
            if raw is None or texts is None:
                yield raw
                continue
            parts, at = [], 0
            for (start, end, _, _), text in zip(string_tokens(raw), texts):
                if json.loads(raw[start:end]) != text:
                    parts += [raw[at:start], json.dumps(text, ensure_ascii=False)]
                    at = end
            yield "".join(parts) + raw[at:]

    return _in_parts(rows(), pa.string())


def redact_leaves(leaves: ColumnLike, pads: Column) -> Column:
    """Mask every leaf of `string_leaves` output.

    Returns `struct<texts, changed, mapping>`; the mapping joins those of all leaves.
    """

    def build(outcomes: Column) -> Column:
        entries = F.array_distinct(
            F.flatten(F.transform(outcomes, lambda o: F.map_entries(o["mapping"])))
        )
        return F.struct(
            F.transform(outcomes, lambda o: o["text"]).alias("texts"),
            F.exists(outcomes, lambda o: o["redacted"]).alias("changed"),
            F.map_from_entries(entries).alias("mapping"),
        )

    leaves = as_column(leaves)
    texts = F.coalesce(leaves, empty_array("string"))
    return F.when(leaves.isNotNull(), let(F.transform(texts, lambda t: redact(t, pads)), build))


def redact_json_column(df: DataFrame, column: str, pads: Column) -> DataFrame:
    """Mask the string leaves of a JSON text column; keys stay as they are.

    Adds `redacted_json` and `json_mapping`, both NULL where nothing changed or the
    text is no JSON.
    """
    leaves = df.withColumn("_leaves", string_leaves(column))
    # The masked leaves must be a column of their own before Python reads them.
    masked = computed(leaves, "_masked", redact_leaves("_leaves", pads))
    changed = F.coalesce(F.col("_masked.changed"), F.lit(False))
    rebuilt = masked.withColumn("_rebuilt", replace_leaves(column, F.when(changed, F.col("_masked.texts"))))
    return rebuilt.withColumns(
        {
            "redacted_json": F.when(changed, F.col("_rebuilt")),
            "json_mapping": F.when(changed, F.col("_masked.mapping")),
        }
    ).drop("_leaves", "_masked", "_rebuilt")


def leaf_table():
    """The UDTF `json_string_leaves(json)` → `(path, text, depth)`."""

    @F.udtf(returnType="path string, text string, depth int", useArrow=True)
    class JsonStringLeaves:
        def eval(self, value: str):
            for start, end, path, depth in (string_tokens(value, with_paths=True) if value is not None else None) or ():
                yield path, json.loads(value[start:end]), depth

    return JsonStringLeaves
