"""Short human-readable lines for audit views and approval queues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlake.functions.expressions import ColumnLike, as_column


def describe_facts(facts: ColumnLike) -> Column:
    """One line for a facts struct: sql, then k8s, http, domain, endpoint, dash."""
    facts = as_column(facts)
    sql, k8s, http = facts["sql"], facts["k8s"], facts["http"]
    filled = lambda c: F.when(c != "", c)
    return F.coalesce(
        F.when(
            sql["verb"] != "",
            F.trim(F.concat(F.lit("SQL "), sql["verb"], F.lit(" "), F.coalesce(sql["table"], F.lit("")))),
        ),
        F.when(
            k8s["verb"] != "",
            F.concat(F.lit("k8s "), k8s["verb"], F.lit(" "), k8s["resource"], F.lit(" in "), k8s["namespace"]),
        ),
        F.when(http["method"] != "", F.concat(http["method"], F.lit(" "), http["host"], http["path"])),
        filled(facts["domain"]),
        filled(facts["endpoint"]),
        F.lit("—"),
    )


def host_hold_summary(host: ColumnLike, rule: ColumnLike) -> Column:
    """Approval line of a held connection."""
    line = F.concat(F.lit("CONNECT "), as_column(host))
    rule = as_column(rule)
    return F.when(rule.isNull(), line).otherwise(F.concat(line, F.lit(" (rule: "), rule, F.lit(")")))


def body_hold_summary(
    method: ColumnLike, host: ColumnLike, path: ColumnLike, pii: ColumnLike, rule: ColumnLike
) -> Column:
    """Approval line of a held body: labels and a count, never values."""
    pii, rule = as_column(pii), as_column(rule)
    types = F.coalesce(F.array_join(pii["types"], ","), F.lit("none"))
    count = F.coalesce(pii["count"], F.lit(0)).cast("string")
    tail = F.when(rule.isNull(), F.lit(")")).otherwise(F.concat(F.lit(", rule: "), rule, F.lit(")")))
    return F.concat(
        as_column(method), F.lit(" "), as_column(host), as_column(path),
        F.lit(": PII ["), types, F.lit("] ("), count, F.lit(" finding(s)"), tail,
    )


def time_of_day(timestamp_text: ColumnLike) -> Column:
    """`HH:mm:ss` in the session time zone; text that is no timestamp stays as it is."""
    text = as_column(timestamp_text)
    return F.coalesce(F.date_format(F.try_to_timestamp(text), "HH:mm:ss"), text)


def rfc3339(ts: ColumnLike) -> Column:
    """A timestamp as RFC 3339 text in UTC with microseconds; years beyond 9999 have more digits and no sign.

    Made of numbers, since formats of dates sign such years and follow the session's time zone.
    """
    micros, day_micros = F.unix_micros(as_column(ts)), F.lit(86_400_000_000)
    rest = F.pmod(micros, day_micros)
    day = F.date_from_unix_date(F.call_function("div", micros - rest, day_micros).cast("int"))

    def digits(number: Column, width: int) -> Column:
        text = number.cast("string")
        return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)

    def clock(unit: int, below: int, width: int = 2) -> Column:
        return digits(F.call_function("div", rest, F.lit(unit)) % below, width)

    year = F.year(day)
    return F.concat(
        F.when(year < 0, year.cast("string")).otherwise(digits(year, 4)), F.lit("-"), digits(F.month(day), 2), F.lit("-"), digits(F.dayofmonth(day), 2),
        F.lit("T"), clock(3_600_000_000, 24), F.lit(":"), clock(60_000_000, 60), F.lit(":"), clock(1_000_000, 60), F.lit("."), clock(1, 1_000_000, 6),
        F.lit("Z"),
    )
