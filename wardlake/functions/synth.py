"""Synthetic values from a seeded stream of draws, as column arithmetic.

The generator's state after k draws is `seed + k * step`, so a draw is a pure
function of its number. Rows are independent: any partitioning gives the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlake.constants import RRN_WEIGHTS
from wardlake.functions.expressions import let

# Fixed values of the mulberry32 generator.
STEP = 0x6D2B79F5
_MASK = 0xFFFFFFFF

# Draw number j (1-based) of one value, as an unsigned 32-bit integer.
Draw = Callable[[int], Column]

# Draws that one value of each kind takes.
DRAWS = {"RRN": 9, "CREDIT_CARD": 14, "PHONE": 8, "EMAIL": 5, "ACCOUNT": 14, "IP": 4}

# E-mail name and domain stems; invented, six and four of them.
EMAIL_NAMES = ["minsu", "jiwoo", "haeun", "dohyun", "yuna", "sora"]
EMAIL_DOMAINS = ["gmail.com", "naver.com", "kakao.com", "daum.net"]


def _mul32(x: Column, y: Column) -> Column:
    """Product modulo 2³², in 16-bit halves so that it cannot overflow."""
    low = x * y.bitwiseAND(F.lit(0xFFFF))
    high = (x * F.shiftright(y, 16)).bitwiseAND(F.lit(0xFFFF))
    return (low + F.shiftleft(high, 16)).bitwiseAND(F.lit(_MASK))


def draw(seed: int, k: Column) -> Column:
    """Draw number `k` (1-based, bigint) of the stream of `seed`."""
    mask = F.lit(_MASK)
    state = (F.lit(seed & _MASK).cast("bigint") + k.cast("bigint").bitwiseAND(mask) * F.lit(STEP)).bitwiseAND(mask)

    def first(a: Column) -> Column:
        return _mul32(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1)))

    def second(t: Column) -> Column:
        mixed = _mul32(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))
        return (t + mixed).bitwiseAND(mask).bitwiseXOR(t)

    return let(let(let(state, first), second), lambda t: t.bitwiseXOR(F.shiftright(t, 14)))


def draws(seed: int, first: Column, count: int) -> Column:
    """`count` consecutive draws, starting at number `first`, as an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda j: draw(seed, first + j))


def below(u: Column, n: int) -> Column:
    """An integer in `[0, n)` from one draw."""
    return F.shiftright(u * n, 32)


def _padded(value: Column, width: int) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def _digits(u: Draw, first: int, count: int) -> Column:
    return F.concat(*[below(u(first + i), 10).cast("string") for i in range(count)])


def rrn_check_digit(first12: Column) -> Column:
    total = sum(
        ((F.ascii(F.substring(first12, i, 1)) - 48) * w for i, w in enumerate(RRN_WEIGHTS, start=1)), F.lit(0)
    )
    return (11 - total % 11) % 10


def rrn_is_valid(value: Column) -> Column:
    """Builder's own check: 13 digits and the check digit, nothing else."""
    number = F.replace(value, F.lit("-"), F.lit(""))
    return number.rlike("^[0-9]{13}$") & (
        rrn_check_digit(number) == F.ascii(F.substring(number, 13, 1)) - 48
    )


def luhn_is_valid(value: Column) -> Column:
    """Builder's own check: at least 12 digits and the Luhn sum."""
    number = F.regexp_replace(value, "[^0-9]", "")
    return (F.length(number) >= 12) & F.call_function("luhn_check", number)


def _luhn_check_digit(body: Column) -> Column:
    return F.get(
        F.filter(
            F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: c.cast("string")),
            lambda c: luhn_is_valid(F.concat(body, c)),
        ),
        F.lit(0),
    )


def _grouped(card: Column) -> Column:
    return F.regexp_replace(card, r"([0-9]{4})(?=[0-9])", "$1-")


def rrn(u: Draw) -> Column:
    front = F.concat(
        _padded(below(u(1), 100), 2), _padded(below(u(2), 12) + 1, 2), _padded(below(u(3), 28) + 1, 2)
    )
    back = F.concat((below(u(4), 4) + 1).cast("string"), _digits(u, 5, 5))
    return let(
        F.struct(front.alias("f"), back.alias("b")),
        lambda x: F.concat(
            x["f"], F.lit("-"), x["b"], rrn_check_digit(F.concat(x["f"], x["b"])).cast("string")
        ),
    )


def card(u: Draw) -> Column:
    return let(
        F.concat(F.lit("4"), _digits(u, 1, 14)), lambda b: _grouped(F.concat(b, _luhn_check_digit(b)))
    )


def mobile(u: Draw) -> Column:
    return F.concat(F.lit("010-"), _digits(u, 1, 4), F.lit("-"), _digits(u, 5, 4))


def account(u: Draw) -> Column:
    return F.concat(_digits(u, 1, 6), F.lit("-"), _digits(u, 7, 2), F.lit("-"), _digits(u, 9, 6))


def _choice(options: list[str], u: Column) -> Column:
    return F.get(F.lit(options), below(u, len(options)).cast("int"))


def email(u: Draw) -> Column:
    return F.concat(
        _choice(EMAIL_NAMES, u(1)), _digits(u, 2, 3), F.lit("@"), _choice(EMAIL_DOMAINS, u(5))
    )


def ipv4(u: Draw) -> Column:
    return F.concat_ws(".", *[(below(u(i), 254) + 1).cast("string") for i in range(1, 5)])


VALUES: dict[str, Callable[[Draw], Column]] = {
    "RRN": rrn, "CREDIT_CARD": card, "PHONE": mobile, "EMAIL": email, "ACCOUNT": account, "IP": ipv4,
}


def value_of(label: Column, stream: Column) -> Column:
    """The value of a label from an array of its draws."""
    u: Draw = lambda j: F.get(stream, F.lit(j - 1))
    result = None
    for name, make in VALUES.items():
        result = F.when(label == name, make(u)) if result is None else result.when(label == name, make(u))
    return result


# Hard negatives


def _hex(u: Draw, first: int, count: int) -> Column:
    return F.concat(*[F.lower(F.hex(below(u(first + i), 16))) for i in range(count)])


def _clean(prefix: Column, suffix: str, shift: Column, grouping: Callable[[Column], Column] = lambda v: v) -> Column:
    """`prefix + digit + suffix` with the first digit that makes no valid id or card.

    Each check accepts exactly one digit, so one of any three passes.
    """
    tries = F.transform(
        F.sequence(F.lit(0), F.lit(9)),
        lambda d: grouping(F.concat(prefix, pmod10(d + shift), F.lit(suffix))),
    )
    return F.get(F.filter(tries, lambda v: ~rrn_is_valid(v) & ~luhn_is_valid(v)), F.lit(0))


def pmod10(value: Column) -> Column:
    return (value % 10).cast("string")


def _invalid_rrn(u: Draw) -> Column:
    front = F.concat(
        _padded(below(u(1), 100), 2), _padded(below(u(2), 12) + 1, 2), _padded(below(u(3), 28) + 1, 2),
        F.lit("-"), (below(u(4), 4) + 1).cast("string"), _digits(u, 5, 5),
    )
    return _clean(front, "", below(u(10), 10))


def _bad_card(u: Draw) -> Column:
    shift = below(u(15), 8) + 1
    return let(
        F.concat(F.lit("4"), _digits(u, 1, 14)),
        lambda b: _grouped(F.concat(b, pmod10(_luhn_check_digit(b).cast("int") + shift))),
    )


def _uuid(u: Draw) -> Column:
    starts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[_hex(u, s, n) for s, n in starts])


NEGATIVE_DRAWS = 40

# Kinds of text that look like personal data and are not.
NEGATIVES: dict[str, Callable[[Draw], Column]] = {
    "invalid-rrn": _invalid_rrn,
    "luhn-fail-card": _bad_card,
    "order-no": lambda u: F.concat(F.lit("ORD-"), _digits(u, 1, 10)),
    "tracking-no": lambda u: _clean(_digits(u, 1, 12), "", below(u(13), 10)),
    "session-id": lambda u: _hex(u, 1, 32),
    "uuid": _uuid,
    "git-sha": lambda u: _hex(u, 1, 40),
    "rrn-like-date": lambda u: _clean(_digits(u, 1, 5), "-0000000", below(u(6), 10)),
}


def negative_of(kind: Column, stream: Column) -> Column:
    """The value of a negative kind from an array of its draws."""
    u: Draw = lambda j: F.get(stream, F.lit(j - 1))
    result = None
    for name, make in NEGATIVES.items():
        result = F.when(kind == name, make(u)) if result is None else result.when(kind == name, make(u))
    return result


# Surfaces


# Korean name and field name of each generated label.
LABEL_WORDS = {
    "RRN": ("주민등록번호", "rrn"),
    "CREDIT_CARD": ("카드번호", "card_no"),
    "PHONE": ("전화번호", "phone"),
    "EMAIL": ("이메일", "email"),
    "ACCOUNT": ("계좌번호", "account_no"),
    "IP": ("IP 주소", "ip"),
}

# Texts around a value, `{v}` value, `{k}` Korean name, `{f}` field.
POSITIVE_TEXTS = {
    "prose": "제 {k}는 {v} 입니다.",
    "http-json": '{"user":{"{f}":"{v}"}}',
    "http-form": "{f}={v}&submitted=true",
    "url-query": "/api/v1/submit?{f}={v}&lang=ko",
    "sql": "INSERT INTO users({f}) VALUES ('{v}');",
    "header": "X-{f}: {v}",
}
NEGATIVE_TEXTS = {
    "prose": "주문 처리 번호는 {v} 입니다.",
    "http-json": '{"ref":"{v}","ok":true}',
    "http-form": "ref={v}&ok=true",
    "url-query": "/track?ref={v}",
    "sql": "SELECT * FROM orders WHERE ref = '{v}';",
    "header": "X-Request-Id: {v}",
}


def _by_key(key: Column, table: dict[str, str]) -> Column:
    result = None
    for name, value in table.items():
        result = F.when(key == name, value) if result is None else result.when(key == name, value)
    return result


def positive_text(surface: Column, label: Column, value: Column) -> Column:
    """The text of a surface with a value in it."""
    text = F.replace(_by_key(surface, POSITIVE_TEXTS), F.lit("{f}"), _by_key(label, {k: w[1] for k, w in LABEL_WORDS.items()}))
    text = F.replace(text, F.lit("{k}"), _by_key(label, {k: w[0] for k, w in LABEL_WORDS.items()}))
    return F.replace(text, F.lit("{v}"), value)


def negative_text(surface: Column, value: Column) -> Column:
    return F.replace(_by_key(surface, NEGATIVE_TEXTS), F.lit("{v}"), value)
