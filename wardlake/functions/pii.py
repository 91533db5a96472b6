"""Checksum-verified personal-data detection as Spark expressions.

A candidate pattern finds substrings, a validator confirms each one, and spans
carry UTF-16 offsets. Everything is regex and array functions on the JVM: one
row in, one `array<struct>` out, no shuffle and no Python worker.

Word boundaries are ASCII ones, so that a value written against Hangul is still
found. They are spelled as look-around because Java's `\\b` is not ASCII there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlake.constants import BRN_WEIGHTS, PHONE_PREFIXES, PII_SEVERITY, RRN_WEIGHTS
from wardlake.functions.expressions import (
    ColumnLike,
    as_column,
    empty_array,
    let,
    running_totals,
    utf16_length,
)

SPAN_TYPE = "struct<start:bigint,end:bigint,label:string,text:string,tier:bigint>"
LOCATED_TYPE = (
    "struct<start:bigint,end:bigint,label:string,text:string,tier:bigint,"
    "char_start:bigint,quoted:boolean>"
)
SUMMARY_TYPE = "struct<types:array<string>,count:bigint,max_severity:bigint>"

# Boundaries next to a word character need to look at one side only. The left
# one follows the first digit, so the scanner skips non-digits without it.
_END = r"(?![0-9A-Za-z_])"
_DIGIT_START = r"[0-9](?<![0-9A-Za-z_][0-9])"

# Candidate shapes.
PERSON_NUMBER_PATTERN = rf"{_DIGIT_START}[0-9]{{5}}-?[0-9]{{7}}{_END}"
BUSINESS_NUMBER_PATTERN = rf"{_DIGIT_START}[0-9]{{2}}-[0-9]{{2}}-[0-9]{{5}}{_END}"
CARD_PATTERN = rf"{_DIGIT_START}[0-9]{{3}}[- ]?[0-9]{{4}}[- ]?[0-9]{{4}}[- ]?[0-9]{{1,7}}{_END}"
# An address is group 1. It is tried once per run of its characters, at the first word
# character of the run or where the last address ended, so that a long run without an
# address costs one pass.
EMAIL_PATTERN = (
    r"(?:(?<![A-Za-z0-9._%+-])[.%+-]*+|(?!\A)\G)"
    rf"([A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{_END})"
)
IP_PATTERN = rf"{_DIGIT_START}[0-9]{{0,2}}\.(?:[0-9]{{1,3}}\.){{2}}[0-9]{{1,3}}{_END}"
PHONE_PATTERN = rf"0(?<![0-9A-Za-z_]0)(?:[0-9]{{1,2}}-[0-9]{{3,4}}-[0-9]{{4}}|10[0-9]{{8}}){_END}"


def digits(text: ColumnLike) -> Column:
    """Only the ASCII digits of a string."""
    return F.regexp_replace(as_column(text), "[^0-9]", "")


def _digit(number: Column, position: int) -> Column:
    """Digit at a 1-based position; no cast, so it cannot fail under ANSI."""
    return F.ascii(F.substring(number, position, 1)) - 48


def _weighted(number: Column, weights: list[int]) -> Column:
    """Weighted sum of the leading digits."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(len(weights))),
        F.lit(0),
        lambda acc, i: acc
        + (F.ascii(F.substring(number, i, F.lit(1))) - 48) * F.get(F.lit(weights), i - 1),
    )


def plausible_yymmdd(number: ColumnLike) -> Column:
    """Whether the first six digits are a calendar date; every February has 29 days."""
    number = as_column(number)
    month = _digit(number, 3) * 10 + _digit(number, 4)
    day = _digit(number, 5) * 10 + _digit(number, 6)
    longest = (
        F.when(month.isin(1, 3, 5, 7, 8, 10, 12), 31)
        .when(month.isin(4, 6, 9, 11), 30)
        .when(month == 2, 29)
        .otherwise(0)
    )
    return day.between(F.lit(1), longest)


def _is_person_number(number: Column, lowest: int, highest: int) -> Column:
    return (
        (F.length(number) == 13)
        & plausible_yymmdd(number)
        & _digit(number, 7).between(lowest, highest)
    )


def is_rrn(number: ColumnLike) -> Column:
    """Resident registration number, given as digits."""
    number = as_column(number)
    check = (11 - _weighted(number, RRN_WEIGHTS) % 11) % 10
    return _is_person_number(number, 1, 4) & (_digit(number, 13) == check)


def is_frn(number: ColumnLike) -> Column:
    """Foreign registration number, given as digits; it has no check digit."""
    return _is_person_number(as_column(number), 5, 8)


def is_brn(number: ColumnLike) -> Column:
    """Business registration number, given as digits."""
    number = as_column(number)
    carry = F.floor(_digit(number, 9) * 5 / 10)
    check = (10 - (_weighted(number, BRN_WEIGHTS) + carry) % 10) % 10
    return (F.length(number) == 10) & (_digit(number, 10) == check)


def luhn_ok(number: ColumnLike) -> Column:
    """Luhn checksum of a string of digits."""
    return F.call_function("luhn_check", as_column(number))


def is_card(number: ColumnLike) -> Column:
    """Card number, given as digits; a person number is never a card."""
    number = as_column(number)
    return (
        F.length(number).between(13, 19) & ~is_rrn(number) & ~is_frn(number) & luhn_ok(number)
    )


def is_ipv4(text: ColumnLike) -> Column:
    """Four dotted octets of at most 255."""
    octets = F.split(as_column(text), r"\.")
    return (F.size(octets) == 4) & F.forall(
        octets, lambda o: F.coalesce(o.try_cast("int").between(0, 255), F.lit(False))
    )


def is_phone(text: ColumnLike) -> Column:
    """Phone number with a real carrier or area code."""
    text = as_column(text)
    count = F.length(digits(text))
    hyphenated = F.substring_index(text, "-", 1).isin(PHONE_PREFIXES)
    bare = (count == 11) & text.startswith("010")
    return count.between(9, 11) & F.when(text.contains("-"), hyphenated).otherwise(bare)


def _person_label(text: Column) -> Column:
    return let(digits(text), lambda d: F.when(is_rrn(d), "RRN").when(is_frn(d), "FRN"))


def _label_if(label: str, test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda text: F.when(test(text), label)


def candidates(text: Column, pattern: str, label_of: Callable[[Column], Column]) -> Column:
    """Matches of one pattern as `struct<text, label, lead>`; the label of a rejected one is NULL.

    `lead` is how many (ASCII) characters the pattern skips before the text.
    """
    return F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda m: F.struct(m.alias("text"), label_of(m).alias("label"), F.lit(0).alias("lead")),
    )


def _addresses(text: Column) -> Column:
    """E-mail matches, in the same form."""
    return F.zip_with(
        F.regexp_extract_all(text, F.lit(EMAIL_PATTERN), F.lit(1)),
        F.regexp_extract_all(text, F.lit(EMAIL_PATTERN), F.lit(0)),
        lambda m, whole: F.struct(m.alias("text"), F.lit("EMAIL").alias("label"), (F.length(whole) - F.length(m)).alias("lead")),
    )


def _locate(text: Column, pattern: Column, found: Column) -> Column:
    """Positions of one pattern's confirmed matches, from the gaps between matches."""

    def widths(gaps: Column) -> Column:
        return F.array(
            F.zip_with(gaps, found, lambda g, m: utf16_length(g) + m["lead"] + utf16_length(m["text"])),
            F.zip_with(gaps, found, lambda g, m: (F.length(g) + m["lead"] + F.length(m["text"])).cast("bigint")),
            # A quote escaped by a backslash does not open or close a string.
            F.transform(
                gaps,
                lambda g: F.regexp_count(F.regexp_replace(g, r"(?s)\\.", ""), F.lit('"')).cast("bigint"),
            ),
        )

    def place(gaps: Column, arrays: Column) -> Column:
        return let(
            F.transform(arrays, running_totals),
            lambda sums: F.transform(found, lambda m, i: span(m, i, F.get(gaps, i), arrays, sums)),
        )

    def span(match: Column, i: Column, gap: Column, arrays: Column, sums: Column) -> Column:
        def before(kind: int) -> Column:
            return F.get(F.get(sums, F.lit(kind)), i)

        def through(kind: int) -> Column:
            return before(kind) + F.get(F.get(arrays, F.lit(kind)), i)

        return F.struct(
            (before(0) + utf16_length(gap) + match["lead"]).alias("start"),
            through(0).alias("end"),
            match["label"].alias("label"),
            match["text"].alias("text"),
            F.lit(1).cast("bigint").alias("tier"),
            (before(1) + F.length(gap) + match["lead"]).alias("char_start"),
            (through(2) % 2 == 1).alias("quoted"),
        )

    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    located = let(gaps, lambda g: let(widths(g), lambda arrays: place(g, arrays)))
    return F.filter(located, lambda s: s["label"].isNotNull())


def _with_label(spans: Column, label: str) -> Column:
    return F.filter(spans, lambda s: s["label"] == label)


def _rejected(matches: Column) -> Column:
    """Whether no candidate was confirmed."""
    return F.forall(matches, lambda m: m["label"].isNull())


def detect_located(text: ColumnLike) -> Column:
    """Spans in detector order, with code-point start and quote state added.

    Every pattern is matched once. Positions need a second pass over the text, so
    they are computed only for patterns with a confirmed match.
    """
    text = as_column(text)
    detectors = [
        # Both person numbers share one candidate pattern: scan it once.
        (PERSON_NUMBER_PATTERN, _person_label),
        (BUSINESS_NUMBER_PATTERN, _label_if("BUSINESS_REG_NO", lambda m: let(digits(m), is_brn))),
        (CARD_PATTERN, _label_if("CREDIT_CARD", lambda m: let(digits(m), is_card))),
        (EMAIL_PATTERN, None),
        (IP_PATTERN, _label_if("IP", is_ipv4)),
        (PHONE_PATTERN, _label_if("PHONE", is_phone)),
    ]

    def scan(t: Column) -> Column:
        groups = []
        for pattern, label_of in detectors:
            if pattern is EMAIL_PATTERN:
                found = F.when(t.contains("@"), _addresses(t)).otherwise(
                    empty_array("struct<text:string,label:string,lead:int>")
                )
            else:
                found = candidates(t, pattern, label_of)
            groups.append(F.struct(F.lit(pattern).alias("pattern"), found.alias("found")))
        confirmed = F.filter(F.array(*groups), lambda g: ~_rejected(g["found"]))
        return F.flatten(F.transform(confirmed, lambda g: _locate(t, g["pattern"], g["found"])))

    def in_detector_order(spans: Column) -> Column:
        # Person numbers share a pattern but RRN is listed before FRN.
        return F.when(
            F.exists(spans, lambda s: s["label"] == "FRN"),
            F.concat(
                _with_label(spans, "RRN"),
                F.filter(spans, lambda s: s["label"] != "RRN"),
            ),
        ).otherwise(spans)

    found = let(let(text, scan), in_detector_order)
    return F.when(text.isNotNull(), found).otherwise(empty_array(LOCATED_TYPE))


def public_spans(located: Column) -> Column:
    """Drop the internal position fields."""
    return F.transform(
        located,
        lambda s: F.struct(*[s[f].alias(f) for f in ("start", "end", "label", "text", "tier")]),
    )


def detect_spans(text: ColumnLike) -> Column:
    """`array<struct<start, end, label, text, tier>>` of every confirmed finding.

    Order is by detector, not position. NULL text has no findings.
    """
    return public_spans(detect_located(text))


def severity_of(label: ColumnLike) -> Column:
    """3 high, 2 medium, 1 low, 0 for an unknown label."""
    label = as_column(label)
    result = F.lit(0)
    for level in sorted(set(PII_SEVERITY.values())):
        names = [k for k, v in PII_SEVERITY.items() if v == level]
        result = F.when(label.isin(names), level).otherwise(result)
    return F.coalesce(result, F.lit(0)).cast("bigint")


def summarize_spans(spans: ColumnLike) -> Column:
    """`struct<types, count, max_severity>`, or NULL when there are no spans."""

    def build(s: Column) -> Column:
        return F.when(
            F.size(s) > 0,
            F.struct(
                F.array_sort(F.array_distinct(F.transform(s, lambda x: x["label"]))).alias("types"),
                F.size(s).cast("bigint").alias("count"),
                F.array_max(F.transform(s, lambda x: severity_of(x["label"]))).alias("max_severity"),
            ),
        )

    return let(as_column(spans), build)


def detect_pii(text: ColumnLike) -> Column:
    """Scan and summarize in one call; NULL when nothing is found."""
    return summarize_spans(detect_spans(text))
