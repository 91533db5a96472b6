"""Host extraction, canonical form and domain matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlake.functions.expressions import ColumnLike, as_column, ascii_lower


def host_of(target: ColumnLike) -> Column:
    """Host of `host:port`, `[ipv6]:port` or a bare host."""
    target = as_column(target)
    bracketed = F.regexp_extract(target, r"^\[([^\]]*)", 1)
    without_port = F.regexp_replace(target, r"(?s):[^:]*\z", "")
    return F.when(target.startswith("["), bracketed).otherwise(without_port)


def _canonical(host: Column) -> Column:
    return ascii_lower(F.rtrim(host, F.lit(".")))


def canonical_host(target: ColumnLike) -> Column:
    """Host without port or trailing dots, in ASCII lowercase."""
    return _canonical(host_of(target))


def request_host(uri: ColumnLike, headers: ColumnLike) -> Column:
    """Host of the URI authority, else of the `Host` header, else empty.

    `headers` is a `map<string,string>` with lowercase names.
    """
    authority = F.regexp_extract(
        as_column(uri), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1
    )
    header = F.get(F.map_values(F.map_filter(as_column(headers), lambda k, _: k == "host")), F.lit(0))
    return (
        F.when(authority != "", _canonical(F.regexp_replace(authority, r":[0-9]*$", "")))
        .otherwise(F.coalesce(canonical_host(header), F.lit("")))
    )


def matches_domain(pattern: ColumnLike, domain: ColumnLike) -> Column:
    """Exact match, or `*.suffix` for the suffix itself and every subdomain."""
    pattern, domain = ascii_lower(as_column(pattern)), ascii_lower(as_column(domain))
    suffix = F.substring(pattern, 3, 2147483647)
    return F.when(
        pattern.startswith("*."),
        (domain == suffix) | F.endswith(domain, F.concat(F.lit("."), suffix)),
    ).otherwise(pattern == domain)


def in_domain_list(domain: ColumnLike, patterns: Sequence[str]) -> Column:
    """Whether a domain matches any pattern of a short list.

    Exact patterns become one set lookup. NULL domains match nothing.
    """
    domain = ascii_lower(as_column(domain))
    lowered = [p.translate(_ASCII_LOWER) for p in patterns]
    exact = sorted({p for p in lowered if not p.startswith("*.")} | {p[2:] for p in lowered if p.startswith("*.")})
    suffixes = sorted({p[1:] for p in lowered if p.startswith("*.")})
    hit = domain.isin(exact) if exact else F.lit(False)
    for suffix in suffixes:
        hit = hit | domain.endswith(suffix)
    return F.coalesce(hit, F.lit(False))


_ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def domain_suffixes(domain: ColumnLike) -> Column:
    """`a.b.c` as `[a.b.c, b.c, c]`: the lookup keys of a suffix join."""
    labels = F.split(ascii_lower(as_column(domain)), r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
