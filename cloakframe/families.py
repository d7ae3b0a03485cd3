"""The 36 identifier families: candidate patterns, checks, and how each is masked and encrypted.

Everything here is plain Python over one value; ``functions/native.py`` has the same checks as
Spark SQL expressions, and the tests hold the two against each other.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from dataclasses import dataclass

import regex as re


def ints(text: str) -> list[int]:
    return [int(x) for x in text.split()]


#: Country calling codes in the order in which they are tried.
CALLING_CODES = [
    f"+{c}"
    for c in (
        ints("354 353 352 351 358 359") + [370, 371, 372, 385, 386] + [420, 421, 423] + [356, 357, 380, 381] + [595, 598, 591, 593] + list(range(502, 508))
        + ints("56 55 54 51 57 58 52") + ints("44 49 33 34 39 31 32 30 36 48 40 45 46 47 41 43") + [1, 7]
    )
]

#: What follows the country in a VAT number.
_VAT = {
    "AT": "U[0-9]{8}", "BE": "[01][0-9]{9}", "BG": "[0-9]{9,10}", "CY": "[0-9]{8}[A-Z]", "CZ": "[0-9]{8,10}", "DE": "[0-9]{9}", "DK": "[0-9]{8}", "EE": "[0-9]{9}", "EL": "[0-9]{9}",
    "ES": "[A-Z0-9][0-9]{7}[A-Z0-9]", "FI": "[0-9]{8}", "FR": "[A-Z0-9]{2}[0-9]{9}", "HR": "[0-9]{11}", "HU": "[0-9]{8}", "IE": "(?:[0-9]{7}[A-Z]{1,2}|[0-9][A-Z][0-9]{5}[A-Z])",
    "IT": "[0-9]{11}", "LT": "(?:[0-9]{9}|[0-9]{12})", "LU": "[0-9]{8}", "LV": "[0-9]{11}", "MT": "[0-9]{8}", "NL": "[0-9]{9}B[0-9]{2}", "PL": "[0-9]{10}", "PT": "[0-9]{9}",
    "RO": "[0-9]{2,10}", "SE": "[0-9]{12}", "SI": "[0-9]{8}", "SK": "[0-9]{10}",
}
_FOURS = r"(?:[\s\-]?[0-9]{4}){3}"
_CARDS = {
    "American Express": r"3[47][0-9]{2}[\s\-]?[0-9]{6}[\s\-]?[0-9]{5}",
    "Visa": "4[0-9]{3}" + _FOURS,
    "Mastercard": "(?:5[1-5][0-9]{2}|2(?:2[2-9][1-9]|[3-6][0-9]{2}|7[01][0-9]|720))" + _FOURS,
    "Discover": "(?:6011|65[0-9]{2}|64[4-9][0-9])" + _FOURS,
    "Maestro": "(?:6304|6759|676[1-3])[0-9]{12}",
}
_LOCAL, _HOST = r"[\-+%._a-zA-Z0-9]", r"[\-.a-zA-Z0-9]+\.[A-Za-z]{2,}"
#: A search for an address begins once in each run of the characters of a local part, where the run does or an address ended.
SKIPS = rf"(?:(?<!{_LOCAL})|\G)"
#: It passes over the run up to its first word boundary: there are several only behind characters of one kind.
_EMAIL = rf"{SKIPS}((?:(?<!\w)[\-+%.]++|(?<=\w)[a-zA-Z0-9_]++)?+)(\b{_LOCAL}++@{_HOST}\b)"


def digits(t: str) -> list[int]:
    return [ord(c) - 48 for c in t if "0" <= c <= "9"]


def starred(t: str) -> str:
    """ASCII digits become asterisks."""
    return "".join("*" if "0" <= c <= "9" else c for c in t)


def _weighted(d: list[int], weights: list[int]) -> int:
    return sum(a * b for a, b in zip(d, weights))


def _doubled(d: int) -> int:
    return 2 * d - 9 if d > 4 else 2 * d


def _luhn(d: list[int]) -> bool:
    return sum(_doubled(x) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0


def _pure(t: str, n: int) -> list[int] | None:
    """The digits of a token that is n digits of ASCII and nothing else."""
    return digits(t) if len(t) == n and len(digits(t)) == n else None


def iban_length(t: str) -> int | None:
    """Length of the valid number at the start of a candidate, which loses its last group until one is."""
    while True:
        c = t.replace(" ", "")
        if 15 <= len(c) <= 34 and c.isascii():
            n = "".join(str(int(x, 36)) for x in c[4:] + c[:4])
            if int(n) % 97 == 1:
                return len(t)
        if " " not in t:
            return None
        t = t[: t.rindex(" ")].rstrip()


def _v4(t: str) -> bool:
    return t.isascii() and all(int(x) <= 255 for x in t.split("."))


_RUN = re.compile("[" + ".:" + "0-9a-fA-F" + "]+")


def ipv6_spans(s: str) -> list[tuple[int, int, ipaddress.IPv6Address]]:
    out = []
    for m in _RUN.finditer(s):
        run = m[0]
        if run.count(":") < 2 or not any(c not in ":." for c in run):
            continue
        for c in dict.fromkeys((run, run.rstrip("."))):
            try:
                address = ipaddress.IPv6Address(c)
            except ValueError:
                continue
            end = m.start() + len(c)
            around = s[m.start() - 1 : m.start()] + s[end : end + 1]
            if not any(x.isascii() and x.isalnum() for x in around):
                out.append((m.start(), end, address))
            break
    return out


def mask_ipv6(address: ipaddress.IPv6Address) -> str:
    groups = [f"{int(address) >> k & 0xFFFF:x}" for k in (112, 96, 80, 64)]
    return ":".join(groups + ["****"] * 4)


def _dni(t: str) -> bool:
    return t.isascii() and "TRWAGMYFPDXBNJZSQVHLCKE"[int(t[:8]) % 23] == t[8]


def _nie(t: str) -> bool:
    return t.isascii() and _dni(str("XYZ".index(t[0])) + t[1:])


def _nin(t: str) -> bool:
    return t[:2] not in "BG GB KN NK NT TN ZZ".split()


def _personalausweis(t: str) -> bool:
    return sum(int(c, 36) * (7, 3, 1)[i % 3] for i, c in enumerate(t[:9])) % 10 == int(t[9])


def _nir(t: str) -> bool:
    if not t.isascii():
        return False
    return 97 - int(re.sub("2A|2B", lambda m: {"2A": "19"}.get(m[0], "18"), t[:13])) % 97 == int(t[13:])


#: By digit value or letter index, at even places counted from 0.
CF_ODD = ints("1 0 5 7 9 13 15 17 19 21 2 4 18 20 11 3 6 8 12 14 16 10 22 25 24 23")


def _codice_fiscale(t: str) -> bool:
    if not t.isascii():
        return False
    at = [ord(c) - (65 if c >= "A" else 48) for c in t]
    return sum(CF_ODD[v] if i % 2 == 0 else v for i, v in enumerate(at[:15])) % 26 == at[15]


def _rut(t: str) -> bool:
    body, dv = digits(t[:-2]), t[-1].upper()
    if not t.isascii():
        return False
    k = 11 - sum(d * (2 + i % 6) for i, d in enumerate(reversed(body))) % 11
    return dv == {11: "0", 10: "K"}.get(k, str(k))


def _cpf(t: str) -> bool:
    d = digits(t)
    if len(d) != 11 or len(set(d)) == 1:
        return False
    for n in (9, 10):
        r = _weighted(d[:n], list(range(n + 1, 1, -1))) % 11
        if d[n] != (0 if r < 2 else 11 - r):
            return False
    return True


def _cnpj(t: str) -> bool:
    d, w = digits(t), ints("6 5 4 3 2 9 8 7 6 5 4 3 2")
    if len(d) != 14 or len(set(d)) == 1:
        return False
    for n in (12, 13):
        r = _weighted(d[:n], w[13 - n :]) % 11
        if d[n] != (0 if r < 2 else 11 - r):
            return False
    return True


def _card(t: str) -> bool:
    return len(digits(t)) >= 12 and _luhn(digits(t))


def _mask_card(t: str) -> str:
    d = "".join(map(str, digits(t)))
    return d[:6] + "*" * (len(d) - 10) + d[-4:]


def _ssn(t: str) -> bool:
    d = "".join(c for c in t if c != "-")
    if not d.isascii():
        return False
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000" and d not in ("078051120", "219099999")


def _no_suffix(s: str, start: int, end: int) -> bool:
    """What follows doesn't make the candidate the head of a RUT or CNPJ."""
    return not re.match(r"-[0-9Kk]|/\d{4}-?\d{2}\b", s[end : end + 12])


def _no_dash_after(s: str, start: int, end: int) -> bool:
    return s[end : end + 1] != "-"


def _no_dash(s: str, start: int, end: int) -> bool:
    return s[end : end + 1] != "-" and s[max(0, start - 1) : start] != "-"


#: Words that make eight digits a Peruvian DNI.
CONTEXT = ("dni", "d[.]n[.]i[.]?", "documento nacional de identidad")
_DNI_CONTEXT = re.compile(r"(?i)\b(" + "|".join(CONTEXT) + r")\b")
CONTEXT_BYTES = 32


def _near(text: str, backwards: bool) -> str:
    """The characters next to a token that CONTEXT_BYTES bytes reach into."""
    n, k = 0, 0
    for c in reversed(text) if backwards else text:
        if n >= CONTEXT_BYTES:
            break
        n, k = n + len(c.encode("utf-8", "replace")), k + 1
    return text[len(text) - k :] if backwards else text[:k]


def _dni_context(s: str, start: int, end: int) -> bool:
    before, after = s[max(0, start - CONTEXT_BYTES) : start], s[end : end + CONTEXT_BYTES]
    return bool(_DNI_CONTEXT.search(_near(before, True) + s[start:end] + _near(after, False)))


def _co_nit(t: str) -> bool:
    d = digits(t)
    if len(d) != 10:
        return False
    r = _weighted(d[8::-1], ints("3 7 13 17 19 23 29 37 41")) % 11
    return d[9] == (r if r < 2 else 11 - r)


def _personnummer(t: str) -> bool:
    d = digits(t)[-10:]
    return len(digits(t)) in (10, 12) and len(t) - len(digits(t)) == 1 and sum(x if i % 2 else _doubled(x) for i, x in enumerate(d)) % 10 == 0


def _ec_cedula(t: str) -> bool:
    d = _pure(t, 10)
    if not d or not 1 <= d[0] * 10 + d[1] <= 24 or d[2] > 5:
        return False
    return sum(x if i % 2 else _doubled(x) for i, x in enumerate(d[:9])) % 10 == -d[9] % 10


def _npi(t: str) -> bool:
    d = _pure(t, 10)
    return bool(d) and (24 + sum(x if i % 2 else _doubled(x) for i, x in enumerate(d[8::-1])) + d[9]) % 10 == 0


def _nhs(t: str) -> bool:
    d = digits(t)
    if len(d) != 10:
        return False
    return (11 - _weighted(d, list(range(10, 1, -1))) % 11) % 11 == d[9]


def _uy_ci(t: str) -> bool:
    d = digits(t)
    return len(d) == 8 and -_weighted(d, ints("2 9 8 7 6 3 4")) % 10 == d[7]


def _nine(check: Callable[[list[int]], bool]) -> Callable[[str], bool]:
    return lambda t: len(digits(t)) == 9 and check(digits(t))


def _tfn(d: list[int]) -> bool:
    return _weighted(d, ints("1 4 3 7 5 8 6 9 10")) % 11 == 0


def _pesel(t: str) -> bool:
    d = _pure(t, 11)
    return bool(d) and -_weighted(d, [1, 3, 7, 9] * 2 + [1, 3]) % 10 == d[10]


def _bsn(t: str) -> bool:
    d = _pure(t, 9)
    total = _weighted(d, ints("9 8 7 6 5 4 3 2 -1")) if d else 0
    return total > 0 and total % 11 == 0


def _my_number(t: str) -> bool:
    d = digits(t)
    if len(d) != 12:
        return False
    r = _weighted(d, ints("6 5 4 3 2 7 6 5 4 3 2")) % 11
    return d[11] == (0 if r < 2 else 11 - r)


def _date(d: list[int]) -> bool:
    return 1 <= d[2] * 10 + d[3] <= 12 and 1 <= d[4] * 10 + d[5] <= 31


def _rrn(t: str) -> bool:
    d = digits(t)
    return len(d) == 13 and _date(d) and (11 - _weighted(d, ints("2 3 4 5 6 7 8 9 2 3 4 5")) % 11) % 10 == d[12]


def _za_id(t: str) -> bool:
    d = _pure(t, 13)
    return bool(d) and _date(d) and d[10] <= 2 and _luhn(d)


def _il_id(t: str) -> bool:
    d = _pure(t, 9)
    return bool(d) and sum(_doubled(x) if i % 2 else x for i, x in enumerate(d)) % 10 == 0


def calling_code(t: str) -> int:
    """How many characters of a phone number stay: its country's code, 2 if none is known."""
    plain = "".join(c for c in t if c == "+" or "0" <= c <= "9")
    return next((len(p) for p in CALLING_CODES if plain.startswith(p)), 2)


def _yes(t: str) -> bool:
    return True


def _all_stars(t: str) -> str:
    return "*" * len(t)


@dataclass(frozen=True)
class Form:
    """One way to write an identifier."""

    pattern: str
    valid: Callable[[str], bool] = _yes
    star: Callable[[str], str] = _all_stars
    around: Callable[[str, int, int], bool] | None = None
    #: Says the same as ``pattern`` in linear time, in two groups: what the search passes over, and the token.
    native: str | None = None

    @property
    def regex(self):
        if self.native:
            return re.compile(self.native.replace(r")(\b", r")(\K\b", 1))
        return re.compile(self.pattern)

    def accepts(self, s: str, m) -> bool:
        return self.valid(m[0]) and (self.around is None or self.around(s, *m.span()))


@dataclass(frozen=True)
class Family:
    """``place`` is that of its field in results; the registry is in the order of the cascade.

    ``split`` says which part of a token keeps its digits in the reversible modes: (kept head, kept tail) lengths.
    """

    name: str
    place: int
    law: str
    forms: tuple[Form, ...]
    reversible: bool = False
    split: Callable[[str], tuple[int, int]] = lambda t: (0, 0)


def _f(name: str, place: int, law: str, *forms: Form, **more) -> Family:
    return Family(name, place, law, forms, **more)


_EU, _US, _UK = "GDPR (EU)", "US — {}", "UK GDPR / DPA 2018"
_ANY = "General personal data (cross-jurisdiction)"

REGISTRY = [
    _f("iban", 3, "GDPR / financial (EU)", Form(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", lambda t: iban_length(t) is not None,
       lambda t: t[:4] + "".join(c if c == " " else "*" for c in t[4 : iban_length(t)]) + t[iban_length(t) :])),
    _f("vat", 4, _EU, Form(r"\b(?=[A-Z]{2}[0-9A-Z]{2})(?:" + "|".join(c + n for c, n in _VAT.items()) + r")\b", star=lambda t: t[:2] + "*" * (len(t) - 2))),
    _f("email", 0, _ANY, Form(rf"\b{_LOCAL}+@{_HOST}\b", star=lambda t: "*" * t.index("@") + t[t.index("@") :], native=_EMAIL)),
    _f("ip", 2, _ANY, Form(r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", _v4, lambda t: ".".join(t.split(".")[:2]) + ".*.*")),
    _f("curp", 20, "Mexico — LFPDPPP", Form(r"\b[A-Z][AEIOU][A-Z]{2}\d{6}[HM][A-Z]{2}[B-DF-HJ-NP-TV-Z]{3}[A-Z0-9]\d\b")),
    _f("dni", 5, "GDPR — Spain (LOPDGDD)", Form(r"\b\d{8}[A-HJ-NP-TV-Z]\b", _dni, lambda t: "*" * 8 + t[8:])),
    _f("nie", 6, "GDPR — Spain (LOPDGDD)", Form(r"\b[XYZ]\d{7}[A-HJ-NP-TV-Z]\b", _nie, lambda t: "*" * 8 + t[8:])),
    _f("nin", 7, _UK, Form(r"\b[ABCEGHJ-PRSTWXYZ][ABCEGHJ-NPRSTWXYZ]\s?\d{2}\s?\d{2}\s?\d{2}\s?[ABCD]\b", _nin, lambda t: "*" * (len(t) - 1) + t[-1])),
    _f("personalausweis", 8, "GDPR — Germany (BDSG)", Form(r"\b[A-Z][A-Z0-9]{8}[0-9]\b", _personalausweis)),
    _f("us_passport", 16, _US.format("Privacy Act"), Form(r"\b[A-Z][0-9]{8}\b")),
    _f("mbi", 28, _US.format("HIPAA"), Form(r"\b[1-9][ACDEFGHJKMNPQRTUVWXY][0-9ACDEFGHJKMNPQRTUVWXY][0-9][ACDEFGHJKMNPQRTUVWXY][0-9ACDEFGHJKMNPQRTUVWXY][0-9][ACDEFGHJKMNPQRTUVWXY]{2}[0-9]{2}\b")),
    _f("nir", 9, "GDPR — France (CNIL)", Form(r"\b[12]\d{2}(?:0[1-9]|1[0-2]|20)(?:\d{2}|2[AB])\d{8}\b", _nir)),
    _f("codice_fiscale", 10, "GDPR — Italy", Form(r"\b[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]\b", _codice_fiscale)),
    _f("phone", 1, _ANY, Form(r"\+[0-9]{1,3}[-\s.]?(?:[0-9][-\s.]?){6,14}[0-9]", star=lambda t: t[: calling_code(t)] + starred(t[calling_code(t) :])),
       reversible=True, split=lambda t: (calling_code(t), 0)),
    _f("rut", 17, "Chile — Ley 21.719", Form(r"\b\d{1,2}\.?\d{3}\.?\d{3}-[\dKk]\b", _rut, lambda t: "*" * (len(t) - 2) + t[-2:]), reversible=True, split=lambda t: (0, 2)),
    _f("cpf", 18, "Brazil — LGPD", Form(r"\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b", _cpf, lambda t: "*" * 9 + "-" + t[-2:]), reversible=True),
    _f("cnpj", 19, "Brazil — legal-entity confidentiality (LGPD-adjacent)", Form(r"\b\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}\b", _cnpj, lambda t: "*" * 12 + "-" + t[-2:]), reversible=True),
    _f("credit_card", 14, "PCI-DSS", Form(r"\b(?:" + "|".join(_CARDS.values()) + r")\b", _card, _mask_card), reversible=True),
    _f("ssn", 15, _US.format("GLBA / state privacy laws"), Form(r"\b\d{3}-\d{2}-\d{4}\b", _ssn, starred), reversible=True),
    _f("arg_dni", 21, "Argentina — Ley 25.326", Form(r"\b\d{1,2}\.\d{3}\.\d{3}\b", star=starred, around=_no_suffix), reversible=True),
    _f("co_cc", 22, "Colombia — Ley 1581", Form(r"\b\d{1,3}\.\d{3}\.\d{3}(?:\.\d{3})?\b", star=starred, around=_no_suffix), reversible=True),
    _f("co_nit", 23, "Colombia — Ley 1581", Form(r"\b\d{9}-\d\b", _co_nit, lambda t: "*" * 9 + t[9:]), reversible=True, split=lambda t: (0, 2)),
    _f("personnummer", 13, "GDPR — Sweden", Form(r"\b\d{6}[-+]\d{4}\b", _personnummer, starred), Form(r"\b\d{8}-\d{4}\b", _personnummer, starred), reversible=True),
    _f("ec_cedula", 24, "Ecuador — LOPDP", Form(r"\b\d{10}\b", _ec_cedula), reversible=True),
    _f("pe_dni", 25, "Peru — Ley 29733", Form(r"\b[0-9]{8}\b", around=_dni_context), reversible=True),
    _f("npi", 27, _US.format("HIPAA"), Form(r"\b\d{10}\b", _npi), reversible=True),
    _f("nhs", 29, _UK + " (NHS)", Form(r"\b\d{3} ?\d{3} ?\d{4}\b", _nhs, starred), reversible=True),
    _f("uy_ci", 26, "Uruguay — Ley 18.331", Form(r"\b\d\.\d{3}\.\d{3}-\d\b", _uy_ci), reversible=True),
    _f("sin", 30, "Canada — PIPEDA", Form(r"\b[1-9]\d{2}-\d{3}-\d{3}\b", _nine(_luhn)), Form(r"\b[1-9]\d{8}\b", _nine(_luhn), around=_no_dash_after), reversible=True),
    _f("tfn", 31, "Australia — Privacy Act 1988", Form(r"\b\d{3} \d{3} \d{3}\b", _nine(_tfn), lambda t: "*** *** ***"), Form(r"\b[1-9]\d{8}\b", _nine(_tfn)), reversible=True),
    _f("pesel", 11, "GDPR — Poland", Form(r"\b\d{11}\b", _pesel), reversible=True),
    _f("bsn", 12, "GDPR — Netherlands", Form(r"\b\d{9}\b", _bsn), reversible=True),
    _f("my_number", 32, "Japan — APPI", Form(r"\b\d{4}[ -]\d{4}[ -]\d{4}\b", _my_number, lambda t: t[4].join(["****"] * 3)), Form(r"\b[1-9]\d{11}\b", _my_number), reversible=True),
    _f("rrn", 33, "South Korea — PIPA", Form(r"\b\d{6}-\d{7}\b", _rrn), Form(r"\b\d{13}\b", _rrn), reversible=True),
    _f("za_id", 34, "South Africa — POPIA", Form(r"\b\d{13}\b", _za_id, around=_no_dash), reversible=True),
    _f("il_id", 35, "Israel — PPL (Protection of Privacy Law)", Form(r"\b\d{9}\b", _il_id, around=_no_dash), reversible=True),
]

BY_NAME = {f.name: f for f in REGISTRY}
#: Names in the order of the fields of ``extract_pii`` and ``mask_pii_audit``.
FIELDS = [f.name for f in sorted(REGISTRY, key=lambda f: f.place)]
REVERSIBLE = {f.name for f in REGISTRY if f.reversible}


def unconditional(family: Family) -> Family:
    """The family as it works where it is asked for by name: ``pe_dni`` then needs no context."""
    if family.name != "pe_dni":
        return family
    return Family(family.name, family.place, family.law, (Form(family.forms[0].pattern),), True)


def chosen(patterns: list[str] | None) -> list[Family]:
    """Families of ``patterns`` in their order; all in the order of the cascade for None."""
    if patterns is None:
        return REGISTRY
    if isinstance(patterns, str) or not patterns:
        raise ValueError("patterns must be a non-empty list of family names")
    for p in patterns:
        if p not in BY_NAME:
            raise ValueError(f"unknown pattern {p!r}, valid patterns: {', '.join(FIELDS)}")
    return [unconditional(BY_NAME[p]) for p in patterns]
