"""Reversible masking: keyed placeholders, tokenization, redaction, restoration.

A placeholder is an HMAC-SHA256 of the secret under a session salt, built from
two nested `sha2` calls. The salt enters a plan as a *pad column* (`struct<inner,
outer>`), so that production jobs take it from a table and never show it in
`explain` output; see `salt_pads` for literals and `pads_from_key` for columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlake.constants import (
    PLACEHOLDER_HEX_DIGITS,
    PLACEHOLDER_PATTERN,
    PLACEHOLDER_PREFIX,
    PLACEHOLDER_SUFFIX,
    REDACTION_SEVERITY_FLOOR,
)
from wardlake.functions.expressions import (
    ColumnLike,
    as_column,
    empty_array,
    interleave,
    let,
    regex_quote,
    running_totals,
)
from wardlake.functions.pii import detect_located, severity_of
from wardlake.functions.secrets import detect_secrets

# Fixed values of HMAC: block size and pad bytes.
_BLOCK_BYTES = 64
_INNER, _OUTER = 0x36, 0x5C

REDACTION_TYPE = (
    "struct<text:string,redacted:boolean,secret_labels:array<string>,pii_labels:array<string>,"
    "max_pii_severity:bigint,mapping:map<string,string>>"
)


class EmptySaltError(ValueError):
    """The salt keys the placeholders; an empty one would make them forgeable."""


def pad_bytes(salt: bytes) -> tuple[bytes, bytes]:
    """Inner and outer HMAC pads of a salt; an empty salt is refused."""
    import hashlib

    if not salt:
        raise EmptySaltError("session salt must not be empty")
    key = hashlib.sha256(salt).digest() if len(salt) > _BLOCK_BYTES else salt
    key = key.ljust(_BLOCK_BYTES, b"\0")
    return bytes(b ^ _INNER for b in key), bytes(b ^ _OUTER for b in key)


def salt_pads(salt: bytes) -> Column:
    """Pad column from a salt known on the driver."""
    inner, outer = pad_bytes(salt)
    return F.struct(F.lit(inner).alias("inner"), F.lit(outer).alias("outer"))


def pads_from_key(key: ColumnLike) -> Column:
    """Pad column from a 32-byte binary key column (a derived session salt)."""
    digits = F.hex(as_column(key))

    def pad(byte: int) -> Column:
        # XOR four bytes at a time as integers, then fill the block with the pad byte.
        mask = int(f"{byte:02X}" * 4, 16)
        words = [
            F.lpad(
                F.hex(F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("bigint").bitwiseXOR(F.lit(mask))),
                8,
                "0",
            )
            for i in range(8)
        ]
        return F.unhex(F.concat(*words, F.lit(f"{byte:02X}" * 32)))

    return F.struct(pad(_INNER).alias("inner"), pad(_OUTER).alias("outer"))


def hmac_hex(message: ColumnLike, pads: Column) -> Column:
    """HMAC-SHA256 of a string or binary column, as lowercase hex."""
    inner = F.sha2(F.concat(pads["inner"], as_column(message).cast("binary")), 256)
    return F.sha2(F.concat(pads["outer"], F.unhex(inner)), 256)


def session_pads(session_context: ColumnLike, machine_pads: Column) -> Column:
    """Pads of a session's salt, the HMAC of its context under the machine secret.

    Computed per row from the context, so no salt table has to be joined in.
    """
    context = F.coalesce(as_column(session_context), F.lit(""))
    return let(F.unhex(hmac_hex(context, machine_pads)), pads_from_key)


def placeholder(secret: ColumnLike, pads: Column) -> Column:
    """The placeholder of a secret; the same secret and salt always give the same one."""
    return F.concat(
        F.lit(PLACEHOLDER_PREFIX),
        F.substring(hmac_hex(secret, pads), 1, PLACEHOLDER_HEX_DIGITS),
        F.lit(PLACEHOLDER_SUFFIX),
    )


def clean_surfaces(surfaces: Column) -> Column:
    """Distinct non-empty surfaces, first occurrence first."""
    return F.array_distinct(F.filter(surfaces, lambda s: s.isNotNull() & (s != "")))


def _mapping_of(matches: Column, pads: Column) -> Column:
    entries = F.transform(F.array_distinct(matches), lambda m: F.struct(placeholder(m, pads), m))
    return F.map_from_entries(entries)


def tokenize(text: ColumnLike, surfaces: ColumnLike, pads: Column) -> Column:
    """Replace every occurrence of every surface, leftmost and then longest.

    Returns `struct<text, mapping>`; the mapping holds only what was replaced.
    The pattern lists literal surfaces longest first, so the regex engine takes
    the longest one that starts at the leftmost position.
    """
    text = as_column(text)

    def build(found: Column) -> Column:
        longest_first = F.array_sort(
            F.transform(found, lambda s: F.struct((-F.length(s)).alias("k"), s.alias("s")))
        )
        pattern = F.array_join(F.transform(longest_first, lambda x: regex_quote(x["s"])), "|")
        return let(pattern, replace)

    def replace(pattern: Column) -> Column:
        return let(
            F.regexp_extract_all(text, pattern, F.lit(0)),
            lambda matches: F.struct(
                interleave(
                    F.split(text, pattern, -1), F.transform(matches, lambda m: placeholder(m, pads))
                ).alias("text"),
                _mapping_of(matches, pads).alias("mapping"),
            ),
        )

    untouched = F.struct(text.alias("text"), F.create_map().cast("map<string,string>").alias("mapping"))
    return let(
        clean_surfaces(as_column(surfaces)),
        lambda s: F.when(F.size(s) > 0, build(s)).otherwise(untouched),
    )


def _labels(items: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(items, lambda x: x["label"])))


def _texts(items: Column) -> Column:
    return F.transform(items, lambda x: x["text"])


def _outcome(text: Column, mapping: Column, secrets: Column, pii: Column) -> Column:
    severity = F.array_max(F.transform(pii, lambda s: severity_of(s["label"])))
    return F.struct(
        text.alias("text"),
        (F.size(mapping) > 0).alias("redacted"),
        _labels(secrets).alias("secret_labels"),
        _labels(pii).alias("pii_labels"),
        F.coalesce(severity, F.lit(0)).cast("bigint").alias("max_pii_severity"),
        mapping.alias("mapping"),
    )


def _at_or_above(spans: Column, floor: int) -> Column:
    return F.filter(spans, lambda s: severity_of(s["label"]) >= floor)


def redact_with_spans(
    text: ColumnLike, spans: ColumnLike, pads: Column, floor: int = REDACTION_SEVERITY_FLOOR
) -> Column:
    """Mask secrets, and personal data at or above `floor`, with spans already known.

    Secrets are always masked. Returns the redaction struct (`REDACTION_TYPE`).
    """
    text = as_column(text)

    def build(found: Column) -> Column:
        surfaces = F.concat(_texts(found["secrets"]), _texts(found["pii"]))
        return let(
            tokenize(text, surfaces, pads),
            lambda t: _outcome(t["text"], t["mapping"], found["secrets"], found["pii"]),
        )

    found = F.struct(
        detect_secrets(text).alias("secrets"), _at_or_above(as_column(spans), floor).alias("pii")
    )
    return F.when(text.isNotNull(), let(found, build))


def redact(text: ColumnLike, pads: Column, floor: int = REDACTION_SEVERITY_FLOOR) -> Column:
    """Detect and mask in one call."""
    return redact_with_spans(text, detect_located(text), pads, floor)


def all_labels(outcome: Column) -> Column:
    """Labels that fired, secrets first and each group sorted."""
    return F.concat(outcome["secret_labels"], outcome["pii_labels"])


def restore_text(text: ColumnLike, mapping: ColumnLike) -> Column:
    """Put secrets back for placeholders this mapping knows; others stay as they are."""
    text, mapping = as_column(text), as_column(mapping)
    return interleave(
        F.split(text, PLACEHOLDER_PATTERN, -1),
        F.transform(
            F.regexp_extract_all(text, F.lit(PLACEHOLDER_PATTERN), F.lit(0)),
            lambda p: F.coalesce(F.try_element_at(mapping, p), p),
        ),
    )


def placeholders_in(text: ColumnLike) -> Column:
    """Every placeholder-shaped substring, in order."""
    return F.regexp_extract_all(as_column(text), F.lit(PLACEHOLDER_PATTERN), F.lit(0))


# JSON bodies


def _occurrences(text: Column, surface: Column, rank: Column) -> Column:
    """Non-overlapping literal occurrences of one surface."""
    gaps = F.split(text, regex_quote(surface), -1)
    inner_gaps = F.slice(gaps, F.lit(1), F.size(gaps) - 1)
    width = F.length(surface).cast("bigint")
    totals = running_totals(F.transform(inner_gaps, lambda g: F.length(g) + width))
    return F.zip_with(
        totals,
        inner_gaps,
        lambda before, gap: _candidate(before + F.length(gap), surface, rank),
    )


def _candidate(start: Column, surface: Column, rank: Column) -> Column:
    """Sorts by start, then longer first, then registration."""
    width = F.length(surface).cast("bigint")
    return F.struct(
        start.cast("bigint").alias("start"),
        (-width).alias("neg_width"),
        rank.cast("bigint").alias("rank"),
        surface.alias("text"),
    )


# Candidates that are chosen from in one pass; a pass copies what it keeps.
_FOLD_BLOCK = 128


def _first_non_overlapping(candidates: Column) -> Column:
    """Leftmost, then longest candidates that do not overlap.

    Appending to an array copies it, so candidates are folded in blocks: the outer pass
    carries only the end of the last one kept and a list of blocks.
    """
    kept_type = "array<struct<start:bigint,neg_width:bigint,rank:bigint,text:string>>"

    def choose(block: Column, last_end: Column) -> Column:
        start = F.struct(last_end.alias("last_end"), F.array().cast(kept_type).alias("kept"))
        return F.aggregate(
            block,
            start,
            lambda acc, c: F.when(c["start"] < acc["last_end"], acc).otherwise(
                F.struct(
                    (c["start"] - c["neg_width"]).alias("last_end"),
                    F.concat(acc["kept"], F.array(c)).alias("kept"),
                )
            ),
        )

    def over_blocks(ordered: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(ordered) - 1) / _FOLD_BLOCK).cast("int")),
            lambda b: F.slice(ordered, b * _FOLD_BLOCK + 1, F.lit(_FOLD_BLOCK)),
        )
        start = F.struct(F.lit(0).cast("bigint").alias("last_end"), F.array().cast(f"array<{kept_type}>").alias("parts"))
        folded = F.aggregate(
            blocks,
            start,
            lambda acc, block: let(
                choose(block, acc["last_end"]),
                lambda done: F.struct(
                    done["last_end"].alias("last_end"), F.concat(acc["parts"], F.array(done["kept"])).alias("parts")
                ),
            ),
        )
        return F.flatten(folded["parts"])

    return let(
        F.array_sort(candidates),
        lambda ordered: F.when(F.size(ordered) <= _FOLD_BLOCK, choose(ordered, F.lit(0).cast("bigint"))["kept"]).otherwise(over_blocks(ordered)),
    )


def redact_json_with_spans(
    text: ColumnLike, located: ColumnLike, pads: Column, floor: int = REDACTION_SEVERITY_FLOOR
) -> Column:
    """Mask a JSON body without breaking its syntax.

    Secrets are replaced at every occurrence. Personal data is replaced only where
    it was found inside a quoted string, so a bare number stays a number.
    `located` comes from `detect_located`.
    """
    text = as_column(text)

    def build(found: Column) -> Column:
        secrets, pii = found["secrets"], found["pii"]
        surfaces = clean_surfaces(F.concat(_texts(secrets), _texts(pii)))
        return let(surfaces, lambda s: F.when(F.size(s) > 0, replace(s, secrets, pii)).otherwise(
            _outcome(text, F.create_map().cast("map<string,string>"), secrets, pii)
        ))

    def replace(surfaces: Column, secrets: Column, pii: Column) -> Column:
        everywhere = F.flatten(
            F.transform(
                clean_surfaces(_texts(secrets)),
                lambda s: _occurrences(text, s, F.array_position(surfaces, s)),
            )
        )
        in_place = F.transform(
            pii, lambda s: _candidate(s["char_start"], s["text"], F.array_position(surfaces, s["text"]))
        )
        return let(
            _first_non_overlapping(F.concat(everywhere, in_place)),
            lambda kept: _outcome(
                interleave(gaps_between(kept), F.transform(kept, lambda k: placeholder(k["text"], pads))),
                _mapping_of(F.transform(kept, lambda k: k["text"]), pads),
                secrets,
                pii,
            ),
        )

    def gaps_between(kept: Column) -> Column:
        ends = F.concat(
            F.array(F.lit(0).cast("bigint")),
            F.transform(kept, lambda k: k["start"] - k["neg_width"]),
        )
        starts = F.concat(
            F.transform(kept, lambda k: k["start"]), F.array(F.length(text).cast("bigint"))
        )
        return F.zip_with(
            ends, starts, lambda e, s: F.substring(text, (e + 1).cast("int"), (s - e).cast("int"))
        )

    eligible = F.filter(_at_or_above(as_column(located), floor), lambda s: s["quoted"])
    found = F.struct(detect_secrets(text).alias("secrets"), eligible.alias("pii"))
    return F.when(text.isNotNull(), let(found, build))


def redact_json(text: ColumnLike, pads: Column, floor: int = REDACTION_SEVERITY_FLOOR) -> Column:
    """Detect and mask a JSON body in one call."""
    return redact_json_with_spans(text, detect_located(text), pads, floor)


def unquoted_findings(located: ColumnLike) -> Column:
    """How many findings a JSON body keeps because they are not in a string."""
    return F.size(F.filter(as_column(located), lambda s: ~s["quoted"]))
