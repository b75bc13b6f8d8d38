"""PII pseudonyms by a keyed Feistel network, in SQL functions only.

Numbers and dates that pass their checks are permuted within their format: a
card stays a card with a right check digit, a date a date in the same notation
and width.
The permutation depends on the key alone, so equal values stay linked across
documents, and whoever has the key can undo it.  E-mail names and secrets, which
have no number format, become keyed digests of the same kind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm.common import spare

#: What is looked for, in order of preference, and its name.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    "iso_date": r"(?<![\d\-/])\d{4}-\d{2}-\d{2}(?![\d\-/])",
    "day_date": r"(?<![\d./\-])\d{1,2}([./])\d{1,2}\1\d{4}(?![\d/])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .\-]?)?\(\d{3}\)[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .\-]\d{2,4}){2,4}(?!\d)|(?<![\d+])\+\d{8,15}(?!\d)|(?<![\d\-.])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d\-])|(?<![\w.\-+])[2-9]\d{2}[2-9]\d{6}(?![\w\-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?=[A-Za-z0-9]*[A-Za-z])(?=[A-Za-z0-9]*\d)[A-Za-z0-9]{32,}(?![A-Za-z0-9])",
    "card": r"(?<![\d.\-])\d(?:[ \-]?\d){12,18}(?![\d])",
}

ANY = "|".join(f"(?:{p})" for p in PATTERNS.values()).replace(r"([./])\d{1,2}\1", r"[./]\d{1,2}[./]")

ROUNDS = 8


def permuted(digits: str, key: str) -> str:
    """SQL for a keyed permutation of all digit strings of one length (2 to 36)."""
    n = f"length({digits})"
    a, b = f"substr({digits}, 1, CAST({n} / 2 AS INT))", f"substr({digits}, CAST({n} / 2 AS INT) + 1)"
    step = f"named_struct('a', s.b, 'b', lpad(CAST(CAST(pmod(CAST(s.a AS DECIMAL(20, 0)) + CAST(conv(substr(sha2(concat('{key}', '|', i, '|', {n}, '|', s.b), 256), 1, 14), 16, 10) AS DECIMAL(20, 0)), CAST(rpad('1', length(s.a) + 1, '0') AS DECIMAL(20, 0))) AS DECIMAL(20, 0)) AS STRING), length(s.a), '0'))"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('a', {a}, 'b', {b}), (s, i) -> {step}, s -> concat(s.a, s.b))"


def unpermuted(digits: str, key: str) -> str:
    """SQL for the inverse of ``permuted``."""
    n = f"length({digits})"
    a, b = f"substr({digits}, 1, CAST({n} / 2 AS INT))", f"substr({digits}, CAST({n} / 2 AS INT) + 1)"
    step = f"named_struct('a', lpad(CAST(CAST(pmod(CAST(s.b AS DECIMAL(20, 0)) - CAST(conv(substr(sha2(concat('{key}', '|', i, '|', {n}, '|', s.a), 256), 1, 14), 16, 10) AS DECIMAL(20, 0)), CAST(rpad('1', length(s.b) + 1, '0') AS DECIMAL(20, 0))) AS DECIMAL(20, 0)) AS STRING), length(s.b), '0'), 'b', s.a)"
    return f"aggregate(reverse(sequence(1, {ROUNDS})), named_struct('a', {a}, 'b', {b}), (s, i) -> {step}, s -> concat(s.a, s.b))"


def luhn_sum(digits: str) -> str:
    """SQL for the Luhn sum of a digit string, counted from its end."""
    d = f"CAST(substr({digits}, length({digits}) - j, 1) AS INT)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (t, j) -> t + IF(j % 2 = 1, IF({d} > 4, 2 * {d} - 9, 2 * {d}), {d}))"


def _mod97(text: str) -> str:
    c = f"substr({text}, j, 1)"
    value = f"IF({c} rlike '[0-9]', CAST(ascii({c}) - 48 AS INT), CAST(ascii({c}) - 55 AS INT))"
    return f"aggregate(sequence(1, length({text})), 0, (t, j) -> CAST((t * IF({c} rlike '[0-9]', 10, 100) + {value}) % 97 AS INT))"


def _refill(shape: str, digits: str) -> str:
    """SQL that puts digits, in turn, where ``shape`` has digits."""
    return f"aggregate(sequence(1, length({shape})), named_struct('o', '', 'k', 1), (s, j) -> IF(substr({shape}, j, 1) rlike '[0-9]', named_struct('o', concat(s.o, substr({digits}, s.k, 1)), 'k', s.k + 1), named_struct('o', concat(s.o, substr({shape}, j, 1)), 'k', s.k)), s -> s.o)"


#: Dates are permuted inside blocks of so many years.
YEARS = 200


def permuted_date(date: str, days: str, months: str, key: str, after: int = 0) -> str:
    """SQL struct(y, m, d): a keyed permutation of the dates of a block of years.

    Days up to ``days`` and months up to ``months`` are what the notation has room
    for.  Year and day of that calendar take turns in the network; a result that is
    no date, or has no day past ``after``, goes through it again until one is.
    """
    base, r = f"(year({date}) - pmod(year({date}), {YEARS}))", f"({days} * {months})"
    mixed = lambda x: f"CAST(conv(substr(sha2(concat('{key}', '|date|', i, '|', {r}, '|', {x}), 256), 1, 8), 16, 10) AS BIGINT)"
    once = f"aggregate(sequence(1, {ROUNDS}), named_struct('a', w.a, 'b', w.b), (s, i) -> IF(i % 2 = 1, named_struct('a', CAST(pmod(s.a + {mixed('s.b')}, {YEARS}) AS INT), 'b', s.b), named_struct('a', s.a, 'b', CAST(pmod(s.b + {mixed('s.a')}, {r}) AS INT))))"
    fits = f"x.b % {days} >= {after} AND x.b % {days} < day(last_day(make_date({base} + x.a, CAST(x.b div {days} AS INT) + 1, 1)))"
    first = f"named_struct('a', CAST(pmod(year({date}), {YEARS}) AS INT), 'b', CAST((month({date}) - 1) * {days} + day({date}) - 1 AS INT), 'ok', false)"
    step = _let(once, "x", f"named_struct('a', x.a, 'b', x.b, 'ok', {fits})")
    return f"aggregate(sequence(1, 100), {first}, (w, k) -> IF(w.ok, w, {step}), w -> named_struct('y', {base} + w.a, 'm', CAST(w.b div {days} AS INT) + 1, 'd', w.b % {days} + 1))"


def _let(value: str, name: str, body: str) -> str:
    """SQL that names a value once inside an expression."""
    return f"transform(array({value}), {name} -> {body})[0]"


def walked(value: str, once: str, holds: str) -> str:
    """SQL that maps ``value`` by ``once`` (of ``w.v``), again and again until ``holds`` (of ``x``).

    The map is a permutation and the start holds, so its cycle leads back to a
    value that holds at the latest, and on those that hold this is a permutation.
    """
    step = _let(once, "x", f"named_struct('v', x, 'ok', {holds})")
    return f"aggregate(sequence(1, 200), named_struct('v', {value}, 'ok', false), (w, k) -> IF(w.ok, w, {step}), w -> w.v)"


def replacement(m: str, key: str) -> str:
    """SQL struct(kind, value) for one match; kind is null where a check fails."""
    is_ = {k: f"{m} rlike r'^(?:{p})$'" for k, p in PATTERNS.items()}
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    out = "CASE"

    def case(kind: str, test: str, value: str) -> str:
        return f" WHEN {is_[kind]} AND {test} THEN named_struct('kind', '{kind}', 'value', {value})"

    octets = f"split({m}, '[.]')"
    out += case("email", "true", f"concat('u', substr(sha2(concat('{key}', '|email|', lower({m})), 256), 1, 12), '@', 'masked.invalid')")
    #: An address is four octets: they are permuted as two 16-bit halves, so the result is one too.
    octet = lambda q: f"CAST(element_at({octets}, {q}) AS INT)"
    ip = f"aggregate(sequence(1, {ROUNDS}), named_struct('a', {octet(1)} * 256 + {octet(2)}, 'b', {octet(3)} * 256 + {octet(4)}), (s, i) -> named_struct('a', s.b, 'b', s.a ^ CAST(conv(substr(sha2(concat('{key}', '|ip|', i, '|', s.b), 256), 1, 4), 16, 10) AS INT)), s -> concat_ws('.', CAST(s.a / 256 AS INT), s.a % 256, CAST(s.b / 256 AS INT), s.b % 256))"
    out += case("ip", f"forall({octets}, o -> CAST(o AS INT) < 256)", ip)
    padded = lambda part, width: f"lpad({part}, {width}, '0')"
    iso = permuted_date(f"try_to_date({m}, 'yyyy-MM-dd')", "31", "12", key)
    out += case("iso_date", f"try_to_date({m}, 'yyyy-MM-dd') IS NOT NULL", _let(iso, "z", f"concat_ws('-', {padded('z.y', 4)}, {padded('z.m', 2)}, {padded('z.d', 2)})"))
    #: Day first where that is a date, else month first, which then has a day past 12; widths stay.
    part = lambda i: f"element_at(split({m}, '[./]'), {i})"
    sep = f"substr({m}, length({part(1)}) + 1, 1)"
    for day, month, fmt, after in ((1, 2, "d/M/yyyy", 0), (2, 1, "M/d/yyyy", 12)):
        parsed = f"try_to_date(regexp_replace({m}, '[.]', '/'), '{fmt}')"
        moved = permuted_date(parsed, f"IF(length({part(day)}) = 1, 9, 31)", f"IF(length({part(month)}) = 1, 9, 12)", key, after)
        names = {day: "z.d", month: "z.m"}
        out += case("day_date", f"{parsed} IS NOT NULL", _let(moved, "z", f"concat_ws({sep}, {padded(names[1], f'length({part(1)})')}, {padded(names[2], f'length({part(2)})')}, {padded('z.y', 4)})"))
    #: Area 000, 666 and 9xx, group 00 and serial 0000 are never given out.
    given = lambda d: f"substr({d}, 1, 3) NOT IN ('000', '666') AND substr({d}, 1, 1) <> '9' AND substr({d}, 4, 2) <> '00' AND substr({d}, 6, 4) <> '0000'"
    out += case("ssn", given(digits), _let(walked(digits, permuted("w.v", key), given("x")), "p", _refill(m, "p")))
    #: The country code stays; the national number is permuted.
    code = f"regexp_extract({m}, r'^[+](1|7|[0-9]{{1,3}}(?=[ .(-])|[0-9]{{2}})', 1)"
    national = f"right({digits}, length({digits}) - length({code}))"
    refilled = lambda p: _refill(m, f"concat(left({digits}, length({digits}) - length({p})), {p})")
    #: Bare numbers are found by their area code and exchange; those that have such ones keep them in any notation, so all notations of a number stay linked.
    bare = r"rlike '^[2-9][0-9]{2}[2-9][0-9]{6}$'"
    out += case("phone", f"length({digits}) BETWEEN 7 AND 15", _let(walked(national, permuted("w.v", key), f"(x {bare}) = ({national} {bare})"), "p", refilled("p")))
    moved = f"concat(substr({m}, 5), substr({m}, 1, 4))"
    body = _let(permuted(f"regexp_replace(substr({m}, 5), '[^0-9]', '')", key), "p", _let(_refill(f"substr({m}, 5)", "p"), "r", f"concat(substr({m}, 1, 2), lpad(98 - {_mod97(f'concat(r, substr({m}, 1, 2), "00")')}, 2, '0'), r)"))
    out += case("iban", f"length(regexp_replace(substr({m}, 5), '[^0-9]', '')) > 1 AND {_mod97(moved)} = 1", body)
    out += case("secret", "true", f"substr(array_join(transform(sequence(1, CAST(ceil(length({m}) / 64) AS INT)), i -> sha2(concat('{key}', '|s', i, '|', {m}), 256)), ''), 1, length({m}))")
    card = _let(permuted(f"substr({digits}, 1, length({digits}) - 1)", key), "p", _refill(m, f"concat(p, CAST((10 - {luhn_sum('concat(p, 0)')} % 10) % 10 AS STRING))"))
    out += case("card", f"{luhn_sum(digits)} % 10 = 0", card)
    return out + " ELSE named_struct('kind', CAST(NULL AS STRING), 'value', " + m + ") END"


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The documents with pseudonyms in place of personal values.

    All rows and columns stay.  Added (replacing columns of these names):
    ``pii`` array<struct<kind, value>> with the pseudonyms in order, and
    ``n_pii``.  Null texts stay null, with none found.  Matches that fail their
    check (Luhn, mod 97, calendar, octets) stay as they are.  Rows that repeat
    are treated each, alike; an empty table gives an empty one.
    """
    if not key or not key.isalnum():
        raise ValueError("the key must be letters and digits")
    names = [c for c in docs.columns if c.lower() not in ("pii", "n_pii")]
    match, new = spare("_matches", docs), spare("_new", docs)
    t = docs.select(*(F.col(f"`{c}`") for c in names), F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(f"({ANY})"), F.lit(0)).alias(match))
    t = t.withColumn(new, F.expr(f"CASE WHEN size({match}) > 0 THEN transform({match}, m -> {replacement('m', key)}) END"))
    gaps = F.split(F.col(f"`{text_col}`"), ANY, -1)
    text = F.when(F.col(new).isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(F.zip_with(gaps, F.col(new), lambda g, r: F.concat(g, F.coalesce(r["value"], F.lit("")))), ""))
    pii = F.expr(f"filter(coalesce({new}, array()), x -> x.kind IS NOT NULL)")
    return t.select(*(text.alias(c) if c.lower() == text_col.lower() else F.col(f"`{c}`") for c in names), pii.alias("pii")).withColumn("n_pii", F.size("pii").cast("long"))
