"""SQL facts: the verb and table of a statement, and PostgreSQL query frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlake.constants import SQL_OBJECT_WORDS
from wardlake.functions.expressions import (
    ColumnLike,
    as_column,
    ascii_lower,
    ascii_upper,
    let,
    trim_chars,
)

# Unicode white space, so that a no-break space also separates words.
_SPACE = r"(?U)\s+"


def clean_identifier(raw: ColumnLike) -> Column:
    """Unquoted, unqualified, lowercase relation name."""
    outer = trim_chars(as_column(raw), "\"`';")
    return ascii_lower(trim_chars(F.substring_index(outer, ".", -1), '"`'))


def _table_token(verb: Column, words: Column) -> Column:
    """The raw relation word for a verb; `words` are the tokens after it."""
    lowered = F.transform(words, ascii_lower)
    after_object_words = F.get(
        F.filter(words, lambda w: ~ascii_lower(w).isin(SQL_OBJECT_WORDS)), F.lit(0)
    )
    positions = F.filter(
        F.array(F.array_position(lowered, "from"), F.array_position(lowered, "into")),
        lambda p: p > 0,
    )
    # array_position is 1-based, so it indexes the following word 0-based.
    after_keyword = F.get(words, F.array_min(positions).cast("int"))
    return (
        F.when(verb.isin("DROP", "TRUNCATE"), after_object_words)
        .when(verb.isin("INSERT", "DELETE", "SELECT"), after_keyword)
        .when(verb == "UPDATE", F.get(words, F.lit(0)))
    )


def sql_facts(query: ColumnLike) -> Column:
    """`struct<verb, table>` of one SQL statement; NULL in, NULL out."""
    words = F.filter(F.split(as_column(query), _SPACE), lambda w: w != "")

    def build(tokens: Column) -> Column:
        verb = ascii_upper(F.coalesce(F.get(tokens, F.lit(0)), F.lit("")))
        rest = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens), F.lit(1)))
        table = clean_identifier(F.coalesce(_table_token(verb, rest), F.lit("")))
        return F.struct(verb.alias("verb"), table.alias("table"))

    return F.when(as_column(query).isNotNull(), let(words, build))


def postgres_query_text(packet: ColumnLike) -> Column:
    """SQL text of a well-formed simple-query frame, else NULL.

    A frame is the tag `Q`, a big-endian length that counts itself and the body,
    and a NUL-terminated UTF-8 string that ends exactly at the end of the packet.
    """
    packet = as_column(packet)
    size = F.octet_length(packet)
    declared = F.conv(F.hex(F.substring(packet, 2, 4)), 16, 10).cast("bigint")
    body = F.substring(packet, F.lit(6), size - 6)
    well_formed = (
        (F.hex(F.substring(packet, 1, 1)) == "51")
        & (size >= 6)
        & (declared + 1 == size)
        & (F.hex(F.substring(packet, size, F.lit(1))) == "00")
    )
    return F.when(well_formed, F.try_validate_utf8(body.cast("string")))


def postgres_facts(packet: ColumnLike) -> Column:
    """SQL facts of a query frame, or NULL when it is not one."""
    return let(postgres_query_text(packet), sql_facts)
