"""Secrets in texts: fixed patterns, and novelty against a zstandard dictionary.

Base patterns find assignments to secret-like names, access key ids and long hex runs.
The method adds strings that no pattern names: in a sensitive context (a word such as
`password` or `credential` near on either side or on the same line, or another secret
shortly before), each candidate string is priced by the bytes
it adds to the compressed text around it, with a compressor primed by a dictionary of
identifiers. Words and names cost little; a string that stays near one byte per character
is reported. Other occurrences of the same string are taken out of the text around, so a
secret that stands twice is found twice.

Spans are code points, end exclusive. Defined results: null and empty texts have no
spans; whole texts are read, however long; repeated rows each get their spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")
SPANS = "array<struct<kind:string,start:int,end:int>>"

# The base patterns and their least lengths.
ASSIGN = re.compile(
    r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE = 8
LEAST_ACCESS = 16

# A candidate is within this many code points of a sensitive word, on its line, or within
# this many after another secret.
NEAR = 64
SENSITIVE = re.compile(
    r"(?ai:password|passwd|passphrase|secret|token|api[_-]?key|credential|private|bearer|authorization|signature|access[_-]?key)"
)
# One of these is in any text in which SENSITIVE matches.
_SENSITIVE_PARTS = ("passw", "passphrase", "secret", "token", "key", "credential", "private", "bearer", "authorization", "signature")
LEAST_LENGTH = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
# The short last line of an encoded block whose line before is a secret.
TAIL = re.compile(r"\r?\n[\x20\t]*([A-Za-z0-9+/_=]{1,15})(?=\r?\n[\x20\t]*-----END)")
# Text on either side that a candidate is compressed with.
AROUND = 1024
# Added bytes per character from which a string counts as incompressible.
LEAST_NOVELTY = 0.66
# What code and its identifiers look like; primes the compressor.
IDENTIFIERS = """
import from return class struct function def static const public private protected void string integer boolean
float double char byte null none true false while for each switch case break continue default try catch finally
raise throw new delete this self super extends implements interface package module export require include define
username password passwd secret token apikey api_key access_key client_id client_secret session cookie header
authorization bearer basic credential private_key public_key certificate signature license version description
config configuration settings environment variable parameter argument value values key keys name names index count
length size list array dict map set tuple object instance method property attribute request response server client
connection database table column query select insert update delete where group order limit join left right inner
http https www localhost example com org net user users admin root home path file folder directory open read write
close start stop begin end first last next previous current total result results error warning info debug log logger
message timestamp datetime created_at updated_at deleted_at is_active is_valid get_ set_ has_ to_string from_string
ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0123456789 00000000 11111111 12345678 xxxxxxxxxxxxxxxx
"""

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the fixed patterns, by start, then kind as listed."""
    lowered = text.lower()
    found: list[Span] = []
    if any(word in lowered for word in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


class Novelty:
    """Prices strings by the compressed bytes they add; built once per process."""

    def __init__(self, identifiers: str = IDENTIFIERS, level: int = 9) -> None:
        import zstandard

        primed = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=level)
        self._compress = zstandard.ZstdCompressor(
            level=level, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False
        ).compress

    def added(self, before: str, value: str, after: str) -> int:
        """Compressed bytes with the value less those without it; its other occurrences around do not count."""
        before, value, after = (x.encode("utf-8", "surrogatepass") for x in (before, value, after))
        before, after = before.replace(value, b""), after.replace(value, b"")
        return len(self._compress(before + value + after)) - len(self._compress(before + after))

    def spans(self, text: str, base: list[Span], least: float = LEAST_NOVELTY) -> list[Span]:
        """Incompressible strings in a sensitive context that no base span covers."""
        found: list[Span] = []
        lowered = text.lower()
        if not any(part in lowered for part in _SENSITIVE_PARTS):
            return found
        words = [m.span() for m in SENSITIVE.finditer(text)]
        if not words:
            return found
        firsts = [s for s, _ in words]
        breaks = [m.start() for m in re.finditer("\n", text)]
        covered = _merged(base)
        starts = [s for s, _ in covered]
        ran_on = -1  # up to here the context runs on from the last secret
        for start, end in _candidates(text, words, firsts):
            before = bisect_right(starts, end - 1) - 1  # the last base span that starts before the end
            if before >= 0 and covered[before][1] > start:
                ran_on = end + NEAR
                continue
            if start > ran_on and not _near_word(start, end, words, firsts, breaks):
                continue
            # Other long strings around, such as the lines of a key block, tell nothing about this one.
            around = (CANDIDATE.sub("", text[max(0, start - AROUND) : start]), CANDIDATE.sub("", text[end : end + AROUND]))
            cost = self.added(around[0], text[start:end], around[1])
            if cost >= least * (end - start):
                found.append((start, end, "novel"))
                ran_on = end + NEAR
                if tail := TAIL.match(text, end):
                    found.append((*tail.span(1), "novel"))
        return found


def _candidates(text: str, words: list[tuple[int, int]], firsts: list[int]) -> Iterator[tuple[int, int]]:
    """Spans of long strings, in order; sensitive words in a string cut it."""
    for m in CANDIDATE.finditer(text):
        at = m.start()
        for k in range(bisect_left(firsts, at), bisect_left(firsts, m.end())):
            if words[k][0] - at >= LEAST_LENGTH:
                yield at, words[k][0]
            at = words[k][1]
        if m.end() - at >= LEAST_LENGTH:
            yield at, m.end()


def _near_word(start: int, end: int, words: list[tuple[int, int]], firsts: list[int], breaks: list[int]) -> bool:
    """Whether a sensitive word is near on either side or on the same line."""
    k = bisect_right(firsts, start)
    if k and (start - words[k - 1][1] <= NEAR or bisect_left(breaks, words[k - 1][1]) == bisect_left(breaks, start)):
        return True
    return k < len(words) and (words[k][0] - end <= NEAR or bisect_left(breaks, words[k][0]) == bisect_left(breaks, end))


def _merged(spans: list[Span]) -> list[tuple[int, int]]:
    """Disjoint intervals, in order, that cover the same positions."""
    out: list[tuple[int, int]] = []
    for start, end, _ in spans:
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def all_spans(text: str | None, novelty: Novelty) -> list[Span]:
    """Base and added spans of a whole text, in order."""
    if not text:
        return []
    base = base_spans(text)
    added = novelty.spans(text, base)
    return sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))


def _scanned(column: pa.Array, apply) -> list:
    novelty = Novelty()
    return [apply(v.as_py(), novelty) for v in column]


def secret_spans(text: Column) -> Column:
    """array<struct<kind, start, end>> of a text."""

    @F.arrow_udf(SPANS)
    def spans(column: pa.Array) -> pa.Array:
        found = _scanned(column, all_spans)
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        return pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in x] for x in found], pa.list_(kind))

    return spans(text.cast("string"))


def masked(text: str | None, novelty: Novelty, mark: str = "[SECRET]") -> str | None:
    """The text with every secret, overlapping ones together, replaced by a mark."""
    out, at = [], 0
    for start, end, _ in all_spans(text, novelty):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return text if not out else "".join(out) + text[at:]


def mask_secrets(text: Column) -> Column:
    """The text without its secrets; a null stays null."""

    @F.arrow_udf("string")
    def mask(column: pa.Array) -> pa.Array:
        return pa.array(_scanned(column, masked), pa.string())

    return mask(text.cast("string"))


def joined(spans: Column, *kinds: str) -> Column:
    """`kind:start:end`, comma-joined, of spans of the given kinds."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(
        F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: counts of each kind, the digest of the base spans, and all spans."""

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    scanned = docs.select(F.col(doc_id).alias("doc_id"), secret_spans(F.col(text)).alias("found"))
    return scanned.select(
        "doc_id", *(count(k) for k in KINDS), F.sha2(joined(F.col("found"), *KINDS[:3]), 256).alias("base_sha256"),
        joined(F.col("found"), *KINDS).alias("spans"),
    )
