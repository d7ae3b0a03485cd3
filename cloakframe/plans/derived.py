"""Identifiers derived from order keys, and the checks of their families in DuckDB's SQL.

The test tables hold few identifiers of their own, so each family gets one candidate a row, made from
``o_orderkey`` by expressions that Spark and DuckDB both run. The checks are written against the published
rules, not against the Spark expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from ..families import ints

PRIME = 982451653


def n(digits: int, salt: int = 0) -> str:
    """A number of so many digits from the key."""
    return f"lpad(cast((o_orderkey * {PRIME} + {salt}) % {10**digits} as varchar(20)), {digits}, '0')"


def two(digits: int, salt: int = 7) -> str:
    """A longer number, from two parts."""
    return f"concat({n(9, salt)}, {n(digits - 9, salt * 31 + 5)})"


def letter(alphabet: str, salt: int = 0) -> str:
    return f"substr('{alphabet}', cast((o_orderkey * 7919 + {salt}) % {len(alphabet)} as int) + 1, 1)"


def cut(of: str, *parts: int | str) -> str:
    """A text cut into parts of these lengths, with what stands between them."""
    out, at = [], 1
    for p in parts:
        if isinstance(p, int):
            out.append(f"substr({of}, {at}, {p})")
            at += p
        else:
            out.append(f"'{p}'")
    return "concat(" + ", ".join(out) + ")"


@dataclass(frozen=True)
class Case:
    """``made``: the identifier; ``valid`` and ``masked`` in DuckDB over t, its digits d and their list D."""

    made: str
    valid: str = "true"
    masked: str = "repeat('*', length(t))"


def dot(weights: list[int], start: int = 1) -> str:
    return f"list_sum(list_transform(range(1, {len(weights) + 1}), lambda i: D[i + {start - 1}] * ({weights})[i]))"


def luhn(first: int, last: int, doubled: int) -> str:
    """The Luhn sum of the digits from first to last, doubled where place % 2 is ``doubled``."""
    return f"list_sum(list_transform(range({first}, {last + 1}), lambda i: CASE WHEN i % 2 = {doubled} THEN (2 * D[i]) // 10 + (2 * D[i]) % 10 ELSE D[i] END))"


def eleven(sum_: str, least: int = 2) -> str:
    return f"(CASE WHEN {sum_} % 11 < {least} THEN 0 ELSE 11 - {sum_} % 11 END)"


UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DNI = "TRWAGMYFPDXBNJZSQVHLCKE"
_DOTS = "regexp_replace(t, '[0-9]', '*', 'g')"
_IBAN = f"concat('DE', {n(2, 3)}, {two(18)})"
_CURP = f"concat({letter('BCDFG', 1)}, {letter('AEIOU', 2)}, {letter(UP, 3)}, {letter(UP, 4)}, {n(6)}, {letter('HM', 5)}, {letter(UP, 6)}, {letter(UP, 8)}, {letter('BCDFGHJKLMNPQRSTVWXYZ', 9)}, {letter('BCDFGHJKLMNPQRSTVWXYZ', 10)}, {letter('BCDFGHJKLMNPQRSTVWXYZ', 11)}, {letter(UP, 12)}, {n(1, 5)})"
_MBI = "ACDEFGHJKMNPQRTUVWXY"
_CF_ODD = ints("1 0 5 7 9 13 15 17 19 21 2 4 18 20 11 3 6 8 12 14 16 10 22 25 24 23")
_CF_AT = "(CASE WHEN substr(t, i, 1) >= 'A' THEN ord(substr(t, i, 1)) - 65 ELSE ord(substr(t, i, 1)) - 48 END)"
_DATE = "D[3] * 10 + D[4] BETWEEN 1 AND 12 AND D[5] * 10 + D[6] BETWEEN 1 AND 31"
_DAY = f"concat(lpad(cast(o_orderkey % 100 as varchar(20)), 2, '0'), lpad(cast(o_orderkey * 31 % 13 as varchar(20)), 2, '0'), lpad(cast(o_orderkey * 17 % 33 as varchar(20)), 2, '0'), {n(7, 11)})"

CASES = {
    "iban": Case(_IBAN, "CAST(concat(substr(t, 5), '1314', substr(t, 3, 2)) AS HUGEINT) % 97 = 1", "concat(substr(t, 1, 4), repeat('*', 18))"),
    "vat": Case(f"concat('PL', {n(10)})", masked="concat('PL', repeat('*', 10))"),
    "email": Case("concat('user.', cast(o_orderkey as varchar(20)), '@mail.example.org')", masked="concat(repeat('*', length(t) - 17), '@mail.example.org')"),
    "ip": Case(
        "concat(cast(o_orderkey % 300 as varchar(20)), '.', cast(o_orderkey * 7 % 300 as varchar(20)), '.12.', cast(o_orderkey * 13 % 270 as varchar(20)))",
        "list_max(list_transform(string_split(t, '.'), lambda p: p::int)) <= 255", "concat(string_split(t, '.')[1], '.', string_split(t, '.')[2], '.*.*')",
    ),
    "curp": Case(_CURP),
    "dni": Case(f"concat({n(8)}, {letter('TRWAGMYFPDXBNJZSQVHLCKE')})", f"'{_DNI}'[CAST(d AS INT) % 23 + 1] = t[9]", "concat(repeat('*', 8), t[9])"),
    "nie": Case(f"concat({letter('XYZ', 1)}, {n(7)}, {letter('TRWAGMYFPDXBNJZSQVHLCKE')})", f"'{_DNI}'[CAST(concat(instr('XYZ', t[1]) - 1, d) AS INT) % 23 + 1] = t[9]", "concat(repeat('*', 8), t[9])"),
    "nin": Case(f"concat({letter('ABGNKTZ')}, {letter('ABEGKNT', 1)}, ' ', {cut(n(6), 2, ' ', 2, ' ', 2)}, ' ', {letter('ABCD')})", "NOT contains('BG,GB,KN,NK,NT,TN,ZZ', t[1:2])", "concat(repeat('*', length(t) - 1), right(t, 1))"),
    "personalausweis": Case(f"concat({letter('CFGHJK')}, {n(8)}, {n(1, 3)})", "(list_sum(list_transform(range(2, 10), lambda i: CAST(t[i] AS INT) * ([7, 3, 1])[(i - 1) % 3 + 1])) + 7 * (ord(t[1]) - 55)) % 10 = CAST(t[10] AS INT)"),
    "us_passport": Case(f"concat({letter(UP)}, {n(8)})"),
    "mbi": Case(f"concat('1', {letter(_MBI)}, {letter('0123456789' + _MBI, 1)}, {n(1)}, {letter(_MBI, 2)}, {letter('0123456789' + _MBI, 3)}, {n(1, 2)}, {letter(_MBI, 4)}, {letter(_MBI, 5)}, {n(2, 9)})"),
    "nir": Case(f"concat('1', {n(2)}, '07', {n(2, 4)}, {n(6, 8)}, {n(2, 77)})", "CAST(right(t, 2) AS INT) = 97 - CAST(left(t, 13) AS BIGINT) % 97"),
    "codice_fiscale": Case(
        f"concat({', '.join(letter(UP, k) for k in range(6))}, {n(2)}, {letter(UP, 7)}, {n(2, 5)}, {letter(UP, 8)}, {n(3, 6)}, {letter(UP, 13)})",
        f"list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 1 THEN ({_CF_ODD})[{_CF_AT} + 1] ELSE {_CF_AT} END)) % 26 = ord(t[16]) - 65",
    ),
    "phone": Case(f"concat('+49 ', {cut(n(10), 3, ' ', 7)})", masked="concat('+49 ', '*** *******')"),
    "rut": Case(f"concat({cut(n(8), 2, '.', 3, '.', 3)}, '-', {letter('0123456789K')})", f"right(t, 1) = '0K987654321'[(list_sum(list_transform(range(1, 9), lambda i: D[9 - i] * ((i - 1) % 6 + 2))) % 11 + 1)::bigint]", "concat(repeat('*', 10), right(t, 2))"),
    "cpf": Case(cut(two(11), 3, ".", 3, ".", 3, "-", 2), f"len(list_distinct(D)) > 1 AND D[10] = {eleven(dot(ints("10 9 8 7 6 5 4 3 2")))} AND D[11] = {eleven(dot(ints("11 10 9 8 7 6 5 4 3 2")))}", "concat('*********-', right(t, 2))"),
    "cnpj": Case(cut(two(14), 2, ".", 3, ".", 3, "/", 4, "-", 2), f"len(list_distinct(D)) > 1 AND D[13] = {eleven(dot(ints("5 4 3 2 9 8 7 6 5 4 3 2")))} AND D[14] = {eleven(dot(ints("6 5 4 3 2 9 8 7 6 5 4 3 2")))}", "concat('************-', right(t, 2))"),
    "credit_card": Case(f"concat('4', {cut(two(15), 3, ' ', 4, ' ', 4, ' ', 4)})", f"{luhn(1, 16, 1)} % 10 = 0", "concat(d[1:6], '******', d[13:16])"),
    "ssn": Case(cut(n(9), 3, "-", 2, "-", 4), "d[1:3] NOT IN ('000', '666') AND D[1] < 9 AND d[4:5] <> '00' AND d[6:9] <> '0000' AND d NOT IN ('078051120', '219099999')", "'***-**-****'"),
    "arg_dni": Case(cut(n(8), 2, ".", 3, ".", 3), masked=_DOTS),
    "co_cc": Case(f"concat('1', {cut(n(9), '.', 3, '.', 3, '.', 3)})", masked=_DOTS),
    "co_nit": Case(f"concat({n(9)}, '-', {n(1, 3)})", "(CASE WHEN {s} % 11 < 2 THEN {s} % 11 ELSE 11 - {s} % 11 END) = D[10]".replace("{s}", dot(ints("41 37 29 23 19 17 13 7 3"))), "concat(repeat('*', 9), right(t, 2))"),
    "personnummer": Case(f"concat({n(6)}, '-', {n(4, 3)})", f"{luhn(1, 10, 1)} % 10 = 0", _DOTS),
    "ec_cedula": Case(n(10), f"D[1] * 10 + D[2] BETWEEN 1 AND 24 AND D[3] < 6 AND ({luhn(1, 9, 1)} + D[10]) % 10 = 0"),
    "pe_dni": Case(n(8)),
    "npi": Case(n(10), f"(24 + {luhn(1, 9, 1)} + D[10]) % 10 = 0"),
    "nhs": Case(cut(n(10), 3, " ", 3, " ", 4), f"(11 - {dot(ints("10 9 8 7 6 5 4 3 2"))} % 11) % 11 = D[10]", _DOTS),
    "uy_ci": Case(cut(n(8), 1, ".", 3, ".", 3, "-", 1), f"(10 - {dot(ints("2 9 8 7 6 3 4"))} % 10) % 10 = D[8]"),
    "sin": Case(f"concat('4', {cut(n(8), 2, '-', 3, '-', 3)})", f"{luhn(1, 9, 0)} % 10 = 0"),
    "tfn": Case(cut(n(9), 3, " ", 3, " ", 3), f"{dot(ints("1 4 3 7 5 8 6 9 10"))} % 11 = 0", "'*** *** ***'"),
    "pesel": Case(two(11), f"(10 - {dot(ints("1 3 7 9 1 3 7 9 1 3"))} % 10) % 10 = D[11]"),
    "bsn": Case(n(9), "{s} > 0 AND {s} % 11 = 0".replace("{s}", dot(ints("9 8 7 6 5 4 3 2 -1")))),
    "my_number": Case(cut(two(12), 4, "-", 4, "-", 4), f"{eleven(dot(ints("6 5 4 3 2 7 6 5 4 3 2")))} = D[12]", "'****-****-****'"),
    "rrn": Case(cut(_DAY, 6, "-", 7), f"{_DATE} AND (11 - {dot(ints("2 3 4 5 6 7 8 9 2 3 4 5"))} % 11) % 10 = D[13]"),
    "za_id": Case(_DAY, f"{_DATE} AND D[11] <= 2 AND {luhn(1, 13, 0)} % 10 = 0"),
    "il_id": Case(n(9), f"{luhn(1, 9, 0)} % 10 = 0"),
}


_VAT = {
    "AT": f"concat('U', {n(8)})", "BE": f"concat('0', {n(9)})", "BG": n(9), "CY": f"concat({n(8)}, 'L')", "CZ": n(8), "DE": n(9), "DK": n(8), "EE": n(9), "EL": n(9), "ES": f"concat('B', {n(7)}, 'K')",
    "FI": n(8), "FR": f"concat('X7', {n(9)})", "HR": two(11), "HU": n(8), "IE": f"concat({n(7)}, 'WA')", "IT": two(11), "LT": two(12), "LU": n(8), "LV": two(11), "MT": n(8), "NL": f"concat({n(9)}, 'B01')",
    "PL": n(10), "PT": n(9), "RO": n(6), "SE": two(12), "SI": n(8), "SK": n(10), "XX": n(9), "DEX": n(9),
}
_SCHEMES = [
    f"concat('37', {two(13)})", f"concat('5', {cut('concat(cast(1 + o_orderkey % 5 as varchar(20)), ' + two(14) + ')', 3, '-', 4, '-', 4, '-', 4)})", f"concat('6011', {two(12)})", f"concat('6304', {two(12)})",
    f"concat('9', {two(15)})",
]
_LUHN_ANY = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 1 THEN (2 * D[i]) // 10 + (2 * D[i]) % 10 ELSE D[i] END)) % 10 = 0"


def _by_turns(parts: list[str]) -> str:
    return f"CASE o_orderkey % {len(parts)} " + " ".join(f"WHEN {k} THEN {p}" for k, p in enumerate(parts)) + " END"


#: More ways to write what some families cover: name -> (family, case).
MORE = {
    "vat_countries": ("vat", Case(_by_turns([f"concat('{c}', {x})" for c, x in _VAT.items()]), "left(t, 2) <> 'XX' AND left(t, 3) <> 'DEX'", "concat(left(t, 2), repeat('*', length(t) - 2))")),
    "credit_card_schemes": ("credit_card", Case(_by_turns(_SCHEMES), f"left(t, 1) <> '9' AND {_LUHN_ANY}", "concat(left(d, 6), repeat('*', length(d) - 10), right(d, 4))")),
    "ip_v6": (
        "ip",
        Case(
            _by_turns(["concat('2001:db8:0:0:1:2:3:', cast(o_orderkey % 9999 as varchar(20)))", "concat('fe80::', cast(o_orderkey % 9999 as varchar(20)))", "concat('1:2:', cast(o_orderkey % 99 as varchar(20)))", "concat('::ffff:10.0.0.', cast(o_orderkey % 300 as varchar(20)))"]),
            "CASE o_orderkey % 4 WHEN 2 THEN false WHEN 3 THEN o_orderkey % 300 < 256 ELSE true END",
            "CASE o_orderkey % 4 WHEN 0 THEN '2001:db8:0:0:****:****:****:****' WHEN 1 THEN 'fe80:0:0:0:****:****:****:****' ELSE '0:0:0:0:****:****:****:****' END",
        ),
    ),
    "personnummer_long": ("personnummer", Case(f"concat('19', {n(6)}, '-', {n(4, 3)})", f"{luhn(3, 12, 1)} % 10 = 0", _DOTS)),
    "sin_plain": ("sin", Case(f"concat('4', {n(8)})", f"{luhn(1, 9, 0)} % 10 = 0")),
    "tfn_plain": ("tfn", Case(f"concat('4', {n(8)})", f"{dot(ints("1 4 3 7 5 8 6 9 10"))} % 11 = 0")),
    "my_number_plain": ("my_number", Case(f"concat('4', {two(11)})", f"{eleven(dot(ints("6 5 4 3 2 7 6 5 4 3 2")))} = D[12]")),
    "rrn_plain": ("rrn", Case(_DAY, f"{_DATE} AND (11 - {dot(ints("2 3 4 5 6 7 8 9 2 3 4 5"))} % 11) % 10 = D[13]")),
    "arg_dni_heads": ("arg_dni", Case(f"concat({cut(n(8), 2, '.', 3, '.', 3)}, CASE o_orderkey % 3 WHEN 0 THEN '-5' WHEN 1 THEN '/0001-81' ELSE '' END)", "o_orderkey % 3 = 2", _DOTS)),
    "co_cc_heads": ("co_cc", Case(f"concat({cut(n(7), 1, '.', 3, '.', 3)}, CASE o_orderkey % 3 WHEN 0 THEN '-k' WHEN 1 THEN '/0001-81' ELSE '' END)", "o_orderkey % 3 = 2", _DOTS)),
}


def oracle(family: str) -> str:
    c = CASES[family] if family in CASES else MORE[family][1]
    return f"""
WITH made AS (SELECT o_orderkey, {c.made} AS t FROM orders),
listed AS (SELECT *, regexp_replace(t, '[^0-9]', '', 'g') AS d, list_transform(regexp_extract_all(t, '[0-9]'), lambda c: c::int) AS D FROM (SELECT o_orderkey, t FROM made)),
checked AS (SELECT *, ({c.valid}) AS ok FROM listed)
SELECT o_orderkey, ok AS contained, CASE WHEN ok THEN t END AS found,
  concat('ref ', CASE WHEN ok THEN {c.masked} ELSE t END, ' end') AS masked, CAST(ok AS INT) AS n FROM checked
""".replace(" AS D FROM", " AS L FROM").replace("D[", "L[").replace("list_distinct(D)", "list_distinct(L)")
