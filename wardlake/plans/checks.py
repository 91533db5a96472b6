"""SQL building blocks of the checks: the same semantics, written for another engine."""

from __future__ import annotations

from wardlake.constants import BRN_WEIGHTS, PHONE_PREFIXES, PII_SEVERITY, RRN_WEIGHTS
from wardlake.functions import synth
from wardlake.functions.masking import pad_bytes
from wardlake.functions.secrets import GENERIC_SHAPE, MIN_ENTROPY_BITS, PLACEHOLDER_WORDS, PRIVATE_KEY_SHAPE, VENDOR_SHAPES


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def units(x: str) -> str:
    """UTF-16 length."""
    return f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def _digit(d: str, i: int) -> str:
    return f"TRY_CAST(substr({d}, {i}, 1) AS INTEGER)"


def _date(d: str) -> str:
    month, day = f"TRY_CAST(substr({d}, 3, 2) AS INTEGER)", f"TRY_CAST(substr({d}, 5, 2) AS INTEGER)"
    longest = f"(CASE WHEN {month} IN (1,3,5,7,8,10,12) THEN 31 WHEN {month} IN (4,6,9,11) THEN 30 WHEN {month} = 2 THEN 29 ELSE 0 END)"
    return f"{day} BETWEEN 1 AND {longest}"


def is_rrn(d: str) -> str:
    total = " + ".join(f"{_digit(d, i)} * {w}" for i, w in enumerate(RRN_WEIGHTS, 1))
    return f"(length({d}) = 13 AND {_date(d)} AND {_digit(d, 7)} BETWEEN 1 AND 4 AND {_digit(d, 13)} = (11 - ({total}) % 11) % 10)"


def is_frn(d: str) -> str:
    return f"(length({d}) = 13 AND {_date(d)} AND {_digit(d, 7)} BETWEEN 5 AND 8)"


def is_brn(d: str) -> str:
    total = " + ".join(f"{_digit(d, i)} * {w}" for i, w in enumerate(BRN_WEIGHTS, 1))
    return f"(length({d}) = 10 AND {_digit(d, 10)} = (10 - ({total} + ({_digit(d, 9)} * 5) // 10) % 10) % 10)"


def luhn(d: str) -> str:
    doubled = (
        f"list_sum(list_transform(range(1, length({d}) + 1), lambda i: "
        f"CASE WHEN (length({d}) - i) % 2 = 1 THEN (CAST(substr({d}, i, 1) AS INTEGER) * 2) // 10 + (CAST(substr({d}, i, 1) AS INTEGER) * 2) % 10 "
        f"ELSE CAST(substr({d}, i, 1) AS INTEGER) END))"
    )
    return f"({doubled} % 10 = 0)"


def is_card(d: str) -> str:
    return f"(length({d}) BETWEEN 13 AND 19 AND NOT {is_rrn(d)} AND NOT {is_frn(d)} AND {luhn(d)})"


def is_ip(m: str) -> str:
    return f"(len(list_filter(string_split({m}, '.'), lambda o: TRY_CAST(o AS INTEGER) BETWEEN 0 AND 255)) = 4)"


def is_phone(m: str) -> str:
    prefixes = ", ".join(quoted(p) for p in PHONE_PREFIXES)
    return f"(CASE WHEN contains({m}, '-') THEN split_part({m}, '-', 1) IN ({prefixes}) ELSE TRUE END)"


# The candidate shapes with plain word boundaries.
_B = r"\b"
PATTERNS = {
    "person": rf"{_B}[0-9]{{6}}-?[0-9]{{7}}{_B}",
    "brn": rf"{_B}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{5}}{_B}",
    "card": rf"{_B}[0-9]{{4}}[- ]?[0-9]{{4}}[- ]?[0-9]{{4}}[- ]?[0-9]{{1,7}}{_B}",
    "email": rf"{_B}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{_B}",
    "ip": rf"{_B}(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}{_B}",
    "phone": rf"{_B}0[0-9]{{1,2}}-[0-9]{{3,4}}-[0-9]{{4}}{_B}|{_B}010[0-9]{{8}}{_B}",
}
_LABELS = {
    "person": f"CASE WHEN {is_rrn('d')} THEN 'RRN' WHEN {is_frn('d')} THEN 'FRN' END",
    "brn": f"CASE WHEN {is_brn('d')} THEN 'BUSINESS_REG_NO' END",
    "card": f"CASE WHEN {is_card('d')} THEN 'CREDIT_CARD' END",
    "email": "'EMAIL'",
    "ip": f"CASE WHEN {is_ip('m')} THEN 'IP' END",
    "phone": f"CASE WHEN {is_phone('m')} THEN 'PHONE' END",
}


def spans(source: str) -> str:
    """Rows `(key, label, start, end, text, quoted)` of the findings in `source(key, text)`."""
    parts = []
    for name, pattern in PATTERNS.items():
        p = quoted(pattern)
        escaped = "regexp_replace(g, '(?s)\\\\.', '', 'g')"
        parts.append(f"""
SELECT key, {_LABELS[name]} AS label, CAST(u AS BIGINT) AS start, CAST(u + {units('m')} AS BIGINT) AS "end", m AS text, q % 2 = 1 AS quoted
FROM (SELECT key, ms[i] AS m, {digits('ms[i]')} AS d,
    list_sum(list_transform(gs[1:i], lambda g: {units('g')})) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: {units('x')})), 0) AS u,
    list_sum(list_transform(gs[1:i], lambda g: length({escaped}) - length(replace({escaped}, '"', '')))) AS q
  FROM (SELECT key, ms, string_split_regex(text, {p}) AS gs, unnest(range(1, len(ms) + 1)) AS i
    FROM (SELECT key, text, regexp_extract_all(text, {p}, 0) AS ms FROM ({source})) WHERE len(ms) > 0))
WHERE {_LABELS[name]} IS NOT NULL""")
    return " UNION ALL ".join(parts)


def severity(label: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in PII_SEVERITY.items())
    return f"(CASE {label} {cases} ELSE 0 END)"


def entropy(v: str) -> str:
    chars = f"string_split({v}, '')"
    share = f"(len(list_filter({chars}, lambda x: x = c)) / CAST(len({chars}) AS DOUBLE))"
    return f"(-list_sum(list_transform(list_distinct({chars}), lambda c: {share} * log2({share}))))"


def secrets(source: str) -> str:
    """Rows `(key, label, text)` of the credentials in `source(key, text)`."""
    parts = [
        f"SELECT key, '{label}' AS label, unnest(regexp_extract_all(text, {quoted(_B + shape)}, 0)) AS text FROM ({source})"
        for label, shape in VENDOR_SHAPES.items()
    ]
    parts.append(f"SELECT key, 'PRIVATE_KEY', unnest(regexp_extract_all(text, {quoted(PRIVATE_KEY_SHAPE)}, 0)) FROM ({source})")
    sample = " OR ".join(f"contains(lower(v), '{w}')" for w in PLACEHOLDER_WORDS)
    parts.append(
        f"SELECT key, 'GENERIC_SECRET', v FROM (SELECT key, unnest(regexp_extract_all(text, {quoted(GENERIC_SHAPE)}, 1)) AS v FROM ({source})) "
        f"WHERE NOT ({sample}) AND {entropy('v')} >= {MIN_ENTROPY_BITS}"
    )
    return " UNION ALL ".join(parts)


def hmac(text: str, salt: bytes) -> str:
    inner, outer = pad_bytes(salt)
    return f"sha256(unhex('{outer.hex()}') || unhex(sha256(unhex('{inner.hex()}') || encode({text}))))"


def placeholder(text: str, salt: bytes) -> str:
    return f"('<<hs:' || substr({hmac(text, salt)}, 1, 32) || '>>')"


def redactions(source: str, salt: bytes, floor: int = 2) -> str:
    """Rows `(key, text, masked, surfaces, secret_labels, pii_labels, severity)`."""
    return f"""
SELECT src.key, src.text, coalesce(f.surfaces, []) AS surfaces, coalesce(f.secret_labels, '') AS secret_labels,
  coalesce(f.pii_labels, '') AS pii_labels, CAST(coalesce(f.severity, 0) AS BIGINT) AS severity,
  list_reduce(coalesce(f.surfaces, []), lambda acc, s: replace(acc, s, {placeholder('s', salt)}), src.text) AS masked
FROM ({source}) src LEFT JOIN (
  SELECT key, list(DISTINCT text ORDER BY length(text) DESC, text) AS surfaces,
    string_agg(DISTINCT CASE WHEN kind = 's' THEN label END, ',' ORDER BY CASE WHEN kind = 's' THEN label END) AS secret_labels,
    string_agg(DISTINCT CASE WHEN kind = 'p' THEN label END, ',' ORDER BY CASE WHEN kind = 'p' THEN label END) AS pii_labels,
    max(CASE WHEN kind = 'p' THEN {severity('label')} END) AS severity
  FROM (SELECT key, label, text, 's' AS kind FROM ({secrets(source)})
        UNION ALL SELECT key, label, text, 'p' FROM ({spans(source)}) WHERE {severity('label')} >= {floor})
  GROUP BY key) f ON f.key = src.key"""


_MASK = "4294967295"


def _mul32(x: str, y: str) -> str:
    return f"((({x}) * (({y}) & 65535) + (((({x}) * (({y}) >> 16)) & 65535) << 16)) & {_MASK})"


def _bind(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def draw(seed: int, k: str) -> str:
    state = f"(({seed} + (({k}) & {_MASK}) * {synth.STEP}) & {_MASK})"
    first = _mul32("xor(a, a >> 15)", "a | 1")
    mixed = _mul32("xor(t, t >> 7)", "t | 61")
    second = f"xor((t + {mixed}) & {_MASK}, t)"
    return _bind(_bind(_bind(state, "a", first), "t", second), "z", "xor(z, z >> 14)")


def draws(seed: int, first: str, count: int) -> str:
    return f"list_transform(range({count}), lambda j: {draw(seed, f'{first} + j')})"


def below(u: str, n: int) -> str:
    return f"(({u} * {n}) >> 32)"


def _run(u: str, first: int, count: int) -> str:
    return " || ".join(f"{below(f'{u}[{first + i}]', 10)}" for i in range(count))


def _pad2(x: str) -> str:
    return f"lpad(CAST({x} AS VARCHAR), 2, '0')"


def _check12(x: str) -> str:
    total = " + ".join(f"CAST(substr({x}, {i}, 1) AS INTEGER) * {w}" for i, w in enumerate(RRN_WEIGHTS, 1))
    return f"((11 - ({total}) % 11) % 10)"


def synthetic_value(label: str, u: str) -> str:
    """The generated value of a label from its list of draws."""
    front = f"({_pad2(below(f'{u}[1]', 100))} || {_pad2(below(f'{u}[2]', 12) + ' + 1')} || {_pad2(below(f'{u}[3]', 28) + ' + 1')})"
    back = f"((({below(f'{u}[4]', 4)} + 1) || '') || {_run(u, 5, 5)})"
    rrn = _bind(f"{front} || {back}", "n", f"substr(n, 1, 6) || '-' || substr(n, 7) || {_check12('n')}")
    body = f"('4' || {_run(u, 1, 14)})"
    with_check = f"list_filter(list_transform(range(10), lambda c: b || c), lambda v: {luhn('v')})[1]"
    card = _bind(body, "b", _bind(with_check, "w", "substr(w,1,4) || '-' || substr(w,5,4) || '-' || substr(w,9,4) || '-' || substr(w,13,4)"))
    names = "[" + ", ".join(quoted(n) for n in synth.EMAIL_NAMES) + "]"
    domains = "[" + ", ".join(quoted(n) for n in synth.EMAIL_DOMAINS) + "]"
    email = f"({names}[{below(f'{u}[1]', 6)} + 1] || {_run(u, 2, 3)} || '@' || {domains}[{below(f'{u}[5]', 4)} + 1])"
    ip = " || '.' || ".join(f"({below(f'{u}[{i}]', 254)} + 1)" for i in range(1, 5))
    values = {
        "RRN": rrn, "CREDIT_CARD": card,
        "PHONE": f"('010-' || {_run(u, 1, 4)} || '-' || {_run(u, 5, 4)})",
        "EMAIL": email,
        "ACCOUNT": f"({_run(u, 1, 6)} || '-' || {_run(u, 7, 2)} || '-' || {_run(u, 9, 6)})",
        "IP": f"({ip})",
    }
    return "CASE " + label + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


def _case(key: str, table: dict[str, str]) -> str:
    return f"(CASE {key} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in table.items()) + " END)"


def positive_text(surface: str, label: str, value: str) -> str:
    text = _case(surface, synth.POSITIVE_TEXTS)
    fields = _case(label, {k: w[1] for k, w in synth.LABEL_WORDS.items()})
    words = _case(label, {k: w[0] for k, w in synth.LABEL_WORDS.items()})
    return f"replace(replace(replace({text}, '{{f}}', {fields}), '{{k}}', {words}), '{{v}}', {value})"


def negative_value(kind: str, u: str) -> str:
    """The value of a negative kind from its list of draws."""

    def hexes(first: int, count: int) -> str:
        return "(" + " || ".join(f"printf('%x', {below(f'{u}[{first + i}]', 16)})" for i in range(count)) + ")"

    def valid(v: str) -> str:
        digits = f"regexp_replace({v}, '[^0-9]', '', 'g')"
        as_id = f"(regexp_full_match(replace({v}, '-', ''), '[0-9]{{13}}') AND ({_check12('d')}) || '' = substr(d, 13, 1))"
        return _bind(digits, "d", f"({as_id} OR length(d) >= 12 AND {luhn('d')})")

    def clean(prefix: str, suffix: str, shift: str) -> str:
        tries = f"list_transform(range(10), lambda t: p || ((t + {shift}) % 10) || '{suffix}')"
        return _bind(prefix, "p", f"list_filter({tries}, lambda v: NOT {valid('v')})[1]")

    front = f"({_pad2(below(f'{u}[1]', 100))} || {_pad2(below(f'{u}[2]', 12) + ' + 1')} || {_pad2(below(f'{u}[3]', 28) + ' + 1')})"
    number = f"({front} || '-' || ({below(f'{u}[4]', 4)} + 1) || {_run(u, 5, 5)})"
    check = f"list_filter(range(10), lambda c: {luhn("(b || c)")})[1]"
    card = _bind(f"('4' || {_run(u, 1, 14)})", "b", f"b || (({check} + {below(f'{u}[15]', 8)} + 1) % 10)")
    parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    values = {
        "invalid-rrn": clean(number, "", below(f"{u}[10]", 10)),
        "luhn-fail-card": _bind(card, "w", "substr(w,1,4) || '-' || substr(w,5,4) || '-' || substr(w,9,4) || '-' || substr(w,13,4)"),
        "order-no": f"('ORD-' || {_run(u, 1, 10)})",
        "tracking-no": clean(f"({_run(u, 1, 12)})", "", below(f"{u}[13]", 10)),
        "session-id": hexes(1, 32),
        "uuid": "(" + " || '-' || ".join(hexes(*p) for p in parts) + ")",
        "git-sha": hexes(1, 40),
        "rrn-like-date": clean(f"({_run(u, 1, 5)})", "-0000000", below(f"{u}[6]", 10)),
    }
    return "CASE " + kind + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


def negative_text(surface: str, value: str) -> str:
    return f"replace({_case(surface, synth.NEGATIVE_TEXTS)}, '{{v}}', {value})"
