"""Request and response bodies: eligibility, text, and skip classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlake.functions.expressions import ColumnLike, as_column, ascii_lower, let

# Hex of an incomplete but so far legal UTF-8 sequence at the end of a body:
# one, two or three bytes of a longer character.
_X = "[0-9A-F]"
_TAIL_1 = "C[2-9A-F]|D[0-9A-F]|E[0-9A-F]|F[0-4]"
_TAIL_2 = (
    f"E0[AB]{_X}|E[1-9A-CEF][89AB]{_X}|ED[89]{_X}|F0[9AB]{_X}|F[1-3][89AB]{_X}|F48{_X}"
)
_TAIL_3 = f"(?:F0[9AB]{_X}|F[1-3][89AB]{_X}|F48{_X})[89AB]{_X}"
_OPEN_TAIL = rf"^(?:(?:[0-9A-F]{{2}})*?)({_TAIL_1}|{_TAIL_2}|{_TAIL_3})$"


def is_json_type(content_type: ColumnLike) -> Column:
    """`application/json` or any `+json` type; parameters are ignored."""
    mime = ascii_lower(F.trim(F.substring_index(as_column(content_type), ";", 1)))
    return F.coalesce((mime == "application/json") | mime.endswith("+json"), F.lit(False))


def body_size(body: ColumnLike, content_length: ColumnLike, limit: int | None = None) -> Column:
    """Size a policy sees: the real one of a body that is there, else the declared one.

    Under a limit, a longer body counts as not read: the declared size, else -1.
    """
    actual = F.octet_length(as_column(body)).cast("bigint")
    declared = as_column(content_length).cast("bigint")
    size = F.coalesce(actual, declared)
    if limit is None:
        return size
    return F.when(actual > limit, F.coalesce(declared, F.lit(-1).cast("bigint"))).otherwise(size)


def is_scannable(body: ColumnLike, content_length: ColumnLike, limit: int | None = None) -> Column:
    """Whether a body may be read for scanning: always, unless a limit in bytes is given."""
    if limit is None:
        return F.lit(True)
    return F.coalesce(F.octet_length(as_column(body)).cast("bigint"), as_column(content_length).cast("bigint")) <= limit


def inspectable_text(body: ColumnLike) -> Column:
    """Text of a body that is valid UTF-8, tolerating only a cut-off last character.

    Invalid bytes anywhere else mean the body is not text: NULL.
    """
    body = as_column(body)

    def cut(b: Column) -> Column:
        size = F.octet_length(b)
        last = F.hex(F.substring(b, F.greatest(size - 2, F.lit(1)), F.lit(3)))
        tail = (F.length(F.regexp_extract(last, _OPEN_TAIL, 1)) / 2).cast("int")
        return F.when(tail > 0, F.try_validate_utf8(F.substring(b, F.lit(1), size - tail).cast("string")))

    return F.coalesce(F.try_validate_utf8(body.cast("string")), let(body, cut))


def scan_bytes(body: Column, decoded: Column, decode_status: Column, scannable: Column) -> Column:
    """Bytes to scan: decoded ones, or the raw ones when decoding is unavailable."""
    return F.when(
        scannable,
        F.when(decode_status == "decoded", decoded).when(decode_status == "unavailable", body),
    )


def redaction_skip_reason(
    has_content_range: Column,
    scannable: Column,
    encoding_present: Column,
    encoding: Column,
    decode_status: Column,
    decoded: Column,
) -> Column:
    """Why a request body must be forwarded unchanged; NULL when it may be rewritten."""
    return (
        F.when(has_content_range, "partial_upload")
        .when(~scannable, "over_limit")
        .when(encoding_present & encoding.isNull(), "encoding_not_text")
        .when(decode_status != "decoded", "not_decodable")
        .when(F.try_validate_utf8(decoded.cast("string")).isNull(), "not_utf8")
    )


def restore_skip_reason(status: ColumnLike, encoding: ColumnLike, mapping_size: ColumnLike) -> Column:
    """Why a response body must not be restored; NULL when it may be."""
    status, encoding = as_column(status), F.trim(as_column(encoding))
    identity = encoding.isNull() | (encoding == "") | (ascii_lower(encoding) == "identity")
    return (
        F.when(status.between(100, 199), "informational")
        .when(status == 204, "no_content")
        .when(status == 206, "partial_content")
        .when(status == 304, "not_modified")
        .when(~identity, "encoded")
        .when(as_column(mapping_size) == 0, "nothing_to_restore")
    )
