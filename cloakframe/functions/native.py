"""The families as Spark SQL expressions: what detection and asterisk masking compile to.

A stage splits the text at its candidates, checks each token with its surroundings, and joins the
pieces again; stages are chained by binding each result to a lambda variable, so that nothing is
evaluated twice. The expression becomes a temporary SQL function of the session, which Catalyst
inlines: the plan holds built-in expressions only.

In the fragments ``t`` is a token, ``d`` its ASCII digits, ``b`` the text before it and ``a`` the text after it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

from ..families import BY_NAME, CALLING_CODES, CF_ODD, CONTEXT, CONTEXT_BYTES, FIELDS, SKIPS, Family, ints


def _raw(pattern: str) -> str:
    """A regex as a literal; classes are those of Unicode, ranges as they are written."""
    return f"r'(?U){pattern}'"


def _digit(i: int, of: str = "d") -> str:
    return f"(ascii(substr({of},{i},1))-48)"


def _sum(weights: Sequence[int], order: Sequence[int] | None = None) -> str:
    """Weighted sum of digits 1, 2, ... or of those in ``order``."""
    order = order or range(1, len(weights) + 1)
    return "(" + "+".join(f"{w}*{_digit(i)}" for w, i in zip(weights, order)) + ")"


def _over_digits(n: str, check: str) -> str:
    """The check on a token whose ASCII digits number ``n``."""
    return f"exists(array(regexp_replace(t,'[^0-9]','')), d -> CASE WHEN length(d){n} THEN {check} ELSE false END)"


def _check11(sum_: str, at: int, low: int = 2) -> str:
    """The check digit that is 0 for remainders under ``low`` and else 11 less the remainder."""
    return f"{_digit(at)} = (CASE WHEN {sum_} % 11 < {low} THEN 0 ELSE 11 - {sum_} % 11 END)"


def _pure(n: int, check: str) -> str:
    return f"(length(t)={n} AND {_over_digits(f'={n}', check)})"


_DATE = f"({_digit(3)}*10+{_digit(4)} BETWEEN 1 AND 12 AND {_digit(5)}*10+{_digit(6)} BETWEEN 1 AND 31)"
_CF_VALUES = "array(" + ",".join(map(str, CF_ODD)) + ")"
_VALUE = "(CASE WHEN c >= 'A' THEN ascii(c)-55 ELSE ascii(c)-48 END)"
_LETTER = "(CASE WHEN c >= 'A' THEN ascii(c)-65 ELSE ascii(c)-48 END)"
_ASCII = "NOT t rlike r'[^\\x00-\\x7f]'"


def _chars(text: str) -> str:
    """Positions and characters of a text, as an array of (i from 0, c)."""
    return f"transform(sequence(1, length({text})), p -> named_struct('i', p-1, 'c', substr({text}, p, 1)))"


_MOD97 = "aggregate(transform(sequence(1, length(r)), p -> substr(r, p, 1)), 0, (m, c) -> CASE WHEN c >= 'A' THEN (m*100+ascii(c)-55)%97 ELSE (m*10+ascii(c)-48)%97 END)"
#: The number of a token without letters behind its country, which fits into 38 digits.
_PLAIN97 = "cast(concat(substr(w,5), ascii(w)-55, ascii(substr(w,2,1))-55, substr(w,3,2)) as decimal(38,0)) % 97 = 1"


def _valid97(v: str) -> str:
    return (
        f"exists(array(replace({v},' ','')), w -> CASE WHEN length(w) NOT BETWEEN 15 AND 34 OR w rlike '[^0-9A-Z]' THEN false WHEN w rlike '^[A-Z]{{2}}[0-9]+$' THEN {_PLAIN97} "
        f"ELSE exists(array(concat(substr(w,5),substr(w,1,4))), r -> {_MOD97} = 1) END)"
    )


#: The valid number at the start of a candidate, which loses its last group until one is.
_IBAN = (
    f"(CASE WHEN {_valid97('t')} THEN t WHEN contains(t,' ') THEN "
    f"get(filter(transform(sequence(size(split(t,' '))-1,0,-1), k -> array_join(slice(split(t,' '),1,k),' ')), v -> {_valid97('v')}),0) END)"
)
_CPF = [_check11(_sum(range(n + 1, 1, -1)), n + 1) for n in (9, 10)]
_W = ints("6 5 4 3 2 9 8 7 6 5 4 3 2")
_CNPJ = [_check11(_sum(_W[13 - n :]), n + 1) for n in (12, 13)]
_REPEATED = "d <> repeat(substr(d,1,1), length(d))"
_LUHN = "luhn_check(d)"
_RUT_SUM = "aggregate(transform(sequence(1,length(d)), p -> (2+(p-1)%6)*(ascii(substr(d,length(d)-p+1,1))-48)), 0, (m, x) -> m+x)"
_RUT = f"exists(array(regexp_replace(substr(t,1,length(t)-2),'[^0-9]','')), d -> exists(array(11 - {_RUT_SUM} % 11), k -> upper(right(t,1)) = (CASE WHEN k=11 THEN '0' WHEN k=10 THEN 'K' ELSE cast(k as string) END)))"
_PERSON = "luhn_check(right(d,10))"
_NEXT = "NOT a rlike " + _raw(r"^(?:-[0-9Kk]|/(?:\d\d){2}-?\d\d\b)")
_CODE = "length(regexp_extract(regexp_replace(t,'[^0-9+]',''), '^(?:" + "|".join(c.replace("+", "[+]") for c in CALLING_CODES) + ")', 0))"
_KEEP = f"get(transform(array({_CODE}), k -> CASE WHEN k = 0 THEN 2 ELSE k END),0)"


def _reach(text: str, side: str) -> str:
    """The characters at one end of a text that CONTEXT_BYTES bytes reach into."""
    return f"coalesce(get(filter(transform(sequence({CONTEXT_BYTES // 4},{CONTEXT_BYTES}), k -> {side}({text},k)), z -> octet_length(z) >= {CONTEXT_BYTES}),0), {text})"


_PERU = f"concat({_reach('b', 'right')}, t, {_reach('a', 'left')}) rlike " + _raw(r"(?i)\b(" + "|".join(CONTEXT) + r")\b")

_STARRED = "translate(t,'0123456789','**********')"
_STARS = "repeat('*',length(t))"

#: family -> the check of each form (None: every candidate counts).
CHECKS: dict[str, list[str | None]] = {
    "iban": [f"{_IBAN} IS NOT NULL"],
    "vat": [None],
    "email": [None],
    "ip": [f"({_ASCII} AND NOT exists(split(t,'[.]'), o -> cast(o as int) > 255))"],
    "curp": [None],
    "dni": [f"({_ASCII} AND substr('TRWAGMYFPDXBNJZSQVHLCKE', try_cast(left(t,8) as int)%23+1, 1) = right(t,1))"],
    "nie": [f"({_ASCII} AND substr('TRWAGMYFPDXBNJZSQVHLCKE', try_cast(concat(translate(left(t,1),'XYZ','012'),substr(t,2,7)) as int)%23+1, 1) = right(t,1))"],
    "nin": ["left(t,2) NOT IN (" + ",".join(f"'{x}'" for x in "BG GB KN NK NT TN ZZ".split()) + ")"],
    "personalausweis": [f"aggregate({_chars('left(t,9)')}, 0, (m, x) -> m + get(array(7,3,1), x.i%3) * exists_value) % 10 = ascii(right(t,1))-48".replace("exists_value", _VALUE.replace("c)", "x.c)").replace("WHEN c", "WHEN x.c"))],
    "us_passport": [None],
    "mbi": [None],
    "nir": [f"({_ASCII} AND 97 - try_cast(replace(replace(left(t,13),'2A','19'),'2B','18') as bigint)%97 = try_cast(right(t,2) as int))"],
    "codice_fiscale": [
        f"({_ASCII} AND aggregate(transform({_chars('left(t,15)')}, x -> named_struct('i',x.i,'v',{_LETTER.replace('c)', 'x.c)').replace('WHEN c', 'WHEN x.c')})), 0, (m, x) -> m + (CASE WHEN x.i%2=0 THEN get({_CF_VALUES}, x.v) ELSE x.v END)) % 26 = ascii(right(t,1))-65)"
    ],
    "phone": [None],
    "rut": [f"({_ASCII} AND {_RUT})"],
    "cpf": [_over_digits("=11", f"{_REPEATED} AND {_CPF[0]} AND {_CPF[1]}")],
    "cnpj": [_over_digits("=14", f"{_REPEATED} AND {_CNPJ[0]} AND {_CNPJ[1]}")],
    "credit_card": [_over_digits(">=12", _LUHN)],
    "ssn": [f"({_ASCII} AND left(t,3) NOT IN ('000','666') AND left(t,1) <> '9' AND substr(t,5,2) <> '00' AND right(t,4) <> '0000' AND t NOT IN ('078-05-1120','219-09-9999'))"],
    "arg_dni": [_NEXT],
    "co_cc": [_NEXT],
    "co_nit": [_over_digits("=10", _check11(_sum(ints("3 7 13 17 19 23 29 37 41"), range(9, 0, -1)), 10).replace("THEN 0", f"THEN {_sum(ints("3 7 13 17 19 23 29 37 41"), range(9, 0, -1))} % 11"))],
    "personnummer": [_over_digits("=10", _PERSON), _over_digits("=12", _PERSON)],
    "ec_cedula": [_pure(10, f"{_digit(1)}*10+{_digit(2)} BETWEEN 1 AND 24 AND {_digit(3)} < 6 AND {_LUHN}")],
    "pe_dni": [_PERU],
    "npi": [_pure(10, "luhn_check(concat('80840',d))")],
    "nhs": [_over_digits("=10", f"(11 - {_sum(range(10, 1, -1))} % 11) % 11 = {_digit(10)}")],
    "uy_ci": [_over_digits("=8", f"({_sum(ints("2 9 8 7 6 3 4"))}+{_digit(8)}) % 10 = 0")],
    "sin": [_over_digits("=9", _LUHN), _pure(9, _LUHN)],
    "tfn": [_over_digits("=9", f"{_sum(ints("1 4 3 7 5 8 6 9 10"))} % 11 = 0"), _pure(9, f"{_sum(ints("1 4 3 7 5 8 6 9 10"))} % 11 = 0")],
    "pesel": [_pure(11, f"({_sum(ints("1 3 7 9 1 3 7 9 1 3 1"))}) % 10 = 0")],
    "bsn": [_pure(9, f"{_sum(ints("9 8 7 6 5 4 3 2 -1"))} > 0 AND {_sum(ints("9 8 7 6 5 4 3 2 -1"))} % 11 = 0")],
    "my_number": [_over_digits("=12", _check11(_sum(ints("6 5 4 3 2 7 6 5 4 3 2")), 12))] * 2,
    "rrn": [_over_digits("=13", f"{_DATE} AND (11 - {_sum(ints("2 3 4 5 6 7 8 9 2 3 4 5"))} % 11) % 10 = {_digit(13)}")] * 2,
    "za_id": [_pure(13, f"{_DATE} AND {_digit(11)} <= 2 AND {_LUHN}")],
    "il_id": [_pure(9, _LUHN)],
}

#: family -> how a token is masked, where it isn't asterisks throughout.
STARS: dict[str, list[str]] = {
    "vat": ["concat(left(t,2), repeat('*',length(t)-2))"],
    "email": ["concat(repeat('*',instr(t,'@')-1), substr(t,instr(t,'@')))"],
    "ip": ["concat(substring_index(t,'.',2),'.*.*')"],
    "dni": ["concat(repeat('*',8), right(t,1))"],
    "nie": ["concat(repeat('*',8), right(t,1))"],
    "nin": ["concat(repeat('*',length(t)-1), right(t,1))"],
    "phone": [f"get(transform(array({_KEEP}), k -> concat(left(t,k), translate(substr(t,k+1),'0123456789','**********'))),0)"],
    "rut": ["concat(repeat('*',length(t)-2), right(t,2))"],
    "cpf": ["concat(repeat('*',9), '-', right(t,2))"],
    "cnpj": ["concat(repeat('*',12), '-', right(t,2))"],
    "credit_card": ["get(transform(array(regexp_replace(t,'[^0-9]','')), d -> concat(left(d,6), repeat('*',length(d)-10), right(d,4))),0)"],
    "ssn": [_STARRED],
    "arg_dni": [_STARRED],
    "co_cc": [_STARRED],
    "co_nit": ["concat(repeat('*',9), right(t,2))"],
    "personnummer": [_STARRED] * 2,
    "nhs": [_STARRED],
    "tfn": ["'*** *** ***'", _STARS],
    "my_number": ["concat('****',substr(t,5,1),'****',substr(t,5,1),'****')", _STARS],
}
STARS["iban"] = [f"get(transform(array({_IBAN}), v -> concat(left(v,4), regexp_replace(substr(v,5),'[^ ]','*'), substr(t,length(v)+1))),0)"]

#: The first token of an IBAN candidate is the valid span within it.
_TOKEN = {"iban": _IBAN}


def _let(value: str, name: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}),0)"


def _uses(check: str, name: str) -> bool:
    return re.search(rf"(?<![\w.']){name}(?![\w'(])", check) is not None


def _bind(check: str, token: str, before: str, after: str) -> str:
    """The check with its surroundings bound, those that it uses."""
    body = check
    for name, value in (("a", after), ("b", before), ("t", token)):
        if value != name and _uses(body, name):
            body = f"exists(array({value}), {name} -> {body})"
    return body


def _alone(check: str | None) -> bool:
    """Whether a check looks at the token only."""
    return check is None or not (_uses(check, "a") or _uses(check, "b"))


#: (family, form) whose surroundings are part of the pattern: a run of digits is a candidate as a whole, so that what stands
#: next to it can't change where candidates begin.
_EDGES = {("sin", 1): ("", "(?!-)"), ("za_id", 0): ("(?<!-)", "(?!-)"), ("il_id", 0): ("(?<!-)", "(?!-)")}


def _forms(family: Family) -> list[tuple[str, str | None, str]]:
    """(pattern, check, star) of each form."""
    checks = CHECKS[family.name] if family.forms[0].around or family.name != "pe_dni" else [None]
    stars = STARS.get(family.name, [_STARS] * len(family.forms))
    edges = [_EDGES.get((family.name, k), ("", "")) for k in range(len(family.forms))]
    return [(f.native if f.native else before + f.pattern + after, c, s) for f, c, s, (before, after) in zip(family.forms, checks, stars, edges)]


# Within a stage: s.g are the gaps around the tokens s.t, one more than there are tokens. What stands
# before token i are the gaps and tokens up to it, what stands after it the rest.
_BEFORE = "concat(array_join(transform(slice(s.t,1,i), (u, k) -> concat(get(s.g,k), u)),''), get(s.g,i))"
_BEFORE_SHORT = "get(s.g,i)"
_AFTER = "concat(get(s.g,i+1), coalesce(get(s.t,i+1),''))"
_AFTER_ALL = "concat(get(s.g,i+1), array_join(transform(slice(s.t,i+2,size(s.t)), (u, k) -> concat(u, get(s.g,i+k+2))),''))"


def _valid(name: str, check: str | None) -> str:
    if check is None:
        return "true"
    far = name == "pe_dni"
    return f"coalesce({_bind(check, 't', _BEFORE if far else _BEFORE_SHORT, _AFTER_ALL if far else _AFTER)}, false)"


def _tokens(x: str, pattern: str) -> str:
    """All candidates. A pattern of two groups has what isn't part of the token in the first."""
    return f"regexp_extract_all({x},{_raw(pattern)},{2 if pattern.startswith(SKIPS) else 0})"


def _gaps(x: str, pattern: str) -> str:
    """What stands around the candidates, one piece more than there are candidates."""
    gaps = f"split({x},{_raw(pattern)},-1)"
    if pattern.startswith(SKIPS):
        return f"zip_with({gaps}, regexp_extract_all({x},{_raw(pattern)},1), (g, k) -> concat(g, coalesce(k,'')))"
    return gaps


def _pieces(x: str, pattern: str) -> str:
    return f"named_struct('g', {_gaps(x, pattern)}, 't', {_tokens(x, pattern)})"


def _flags(name: str, check: str | None) -> str:
    """Which tokens of s count."""
    return f"transform(s.t, (t, i) -> {_valid(name, check)})"


def _simple(x: str, pattern: str, check: str | None, star: str) -> str:
    """The text after one form whose check looks at tokens only; the pattern runs once where there is no candidate."""
    if star == STARS["iban"][0]:
        put = f"coalesce({star}, t)"  # null where there is no valid number
    else:
        put = f"CASE WHEN coalesce({check}, false) THEN {star} ELSE t END" if check else star
    joined = f"array_join(zip_with({_gaps(x, pattern)}, transform(c, t -> {put}), (g, m) -> concat(g, coalesce(m,''))),'')"
    return _let(_tokens(x, pattern), "c", f"CASE WHEN size(c) = 0 THEN {x} ELSE {joined} END")


def _stage(x: str, name: str, pattern: str, check: str | None, star: str) -> str:
    """(x, n): the text after one form, and how many tokens it masked."""
    done = (
        f"named_struct('x', array_join(zip_with(s.g, zip_with(s.t, f, (t, v) -> CASE WHEN v THEN {star} ELSE t END), (g, m) -> concat(g, coalesce(m,''))),''), 'n', size(filter(f, v -> v)))"
    )
    return f"CASE WHEN {x} rlike {_raw(pattern)} THEN {_let(_pieces(x, pattern), 's', _let(_flags(name, check), 'f', done))} ELSE named_struct('x', {x}, 'n', 0) END"


# ---- IPv6 ----

_HEX = "^[0-9A-Fa-f]{1,4}$"
_V4_TAIL = "^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:[.](?!$)|$)){4}$"


def _groups(part: str, last: bool) -> str:
    """The groups of one side of ``::`` as hexadecimal strings; null if one isn't valid."""
    whole = f"(CASE WHEN {part} = '' THEN cast(array() as array<string>) ELSE split({part},':') END)"
    if last:
        # A dotted tail stands for two groups.
        tail = "element_at(h,-1)"
        octet = lambda k: f"cast(get(split({tail},'[.]'),{k}) as int)"
        two = f"array(hex({octet(0)}*256+{octet(1)}), hex({octet(2)}*256+{octet(3)}))"
        whole = _let(whole, "h", f"CASE WHEN size(h) > 0 AND {tail} rlike r'{_V4_TAIL}' THEN concat(slice(h,1,size(h)-1), {two}) ELSE h END")
    return _let(whole, "h", f"CASE WHEN exists(h, e -> NOT e rlike r'{_HEX}') THEN NULL ELSE h END")


def _parsed(run: str) -> str:
    """The eight groups of an address, or null."""
    sides = f"split({run},'::',-1)"
    one = _let(_groups("get(w,0)", True), "l", "CASE WHEN size(l) = 8 THEN l END")
    two = _let(_groups("get(w,0)", False), "l", _let(_groups("get(w,1)", True), "r", "CASE WHEN size(l)+size(r) <= 7 THEN concat(l, array_repeat('0', 8-size(l)-size(r)), r) END"))
    return _let(sides, "w", f"CASE WHEN size(w) = 1 THEN {one} WHEN size(w) = 2 THEN {two} END")


_RUN = "[0-9A-Fa-f:.]+"
_LONG = "(length(t) - length(replace(t,':','')) >= 2 AND t rlike '[0-9A-Fa-f]')"
_TRIMMED = "rtrim('.', t)"


def _v6(x: str) -> str:
    """(gaps g, tokens t, per token: the length and groups of its address) of a text."""
    near = "NOT right(get(s.g,i),1) rlike '[0-9A-Za-z]'"
    after = "NOT left(concat(substr(t,length(v)+1), get(s.g,i+1)),1) rlike '[0-9A-Za-z]'"
    found = _let(f"get(filter(transform(array(t, {_TRIMMED}), v -> named_struct('v', v, 'h', {_parsed('v')})), z -> z.h IS NOT NULL),0)", "z", _let("z.v", "v", f"CASE WHEN z IS NOT NULL AND {near} AND {after} THEN z END"))
    tokens = f"transform(s.t, (t, i) -> CASE WHEN {_LONG} THEN {found} END)"
    pieces = f"named_struct('g', split({x},r'{_RUN}',-1), 't', regexp_extract_all({x},r'{_RUN}',0))"
    return _let(pieces, "s", f"named_struct('g', s.g, 't', s.t, 'z', {tokens})")


def _has_v6(x: str) -> str:
    return f"{x} rlike '(?s):.*:'"


def _v6_stage(x: str) -> str:
    part = "concat(array_join(transform(slice(get(y.z,i).h,1,4), e -> coalesce(nullif(ltrim('0', lower(e)),''),'0')),':'), repeat(':****', 4), substr(get(y.t,i), length(get(y.z,i).v)+1))"
    text = f"array_join(transform(y.g, (g, i) -> concat(g, coalesce(CASE WHEN get(y.z,i) IS NOT NULL THEN {part} ELSE get(y.t,i) END,''))),'')"
    return f"CASE WHEN {_has_v6(x)} THEN {_let(_v6(x), 'y', f'''named_struct('x', {text}, 'n', size(filter(y.z, z -> z IS NOT NULL)))''')} ELSE named_struct('x', {x}, 'n', 0) END"


# ---- gates ----

# The shape of an ASCII text: in h digits are 0 and capitals A; y has the same with blanks for all that isn't part of a word, and
# one at either end; g is y without blanks. Texts with other characters, whose digits and blanks are more, have null shapes.
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_H = f"translate(x, '123456789{_UPPER}', '{'0' * 9}{'A' * 26}')"
_Y = r"concat(' ', regexp_replace(h, r'\W', ' '), ' ')"


def _has(of: str, *parts: str) -> str:
    return "(" + " OR ".join(f"contains(o.{of}, '{p}')" for p in parts) + ")"


def _alone_run(n: int) -> str:
    return _has("y", f" {'0' * n} ")


#: stage -> what the shape of every text with a candidate has; looking that up takes a small part of the time of a pattern.
GATES = {
    "iban_0": _has("h", "AA00"),
    "vat_0": f"({_has('h', 'AA')} AND {_has('h', '00')})",
    "email_0": "contains(o.x, '@')",
    "ip_v6": _has("h", ":"),
    "ip_0": _has("h", "0.0"),
    "curp_0": _has("h", "AAAA000000A"),
    "dni_0": _has("h", "00000000A"),
    "nie_0": _has("h", "A0000000A"),
    "nin_0": _has("g", "AA000000A"),
    "personalausweis_0": f"({_has('h', 'A')} AND contains(translate(o.h,'A','0'), '{'0' * 10}'))",
    "us_passport_0": _has("h", "A00000000"),
    "mbi_0": _has("h", "0AA00"),
    "nir_0": _has("h", "0" * 15, "000000A00000000"),
    "codice_fiscale_0": _has("h", "AAAAAA00A00A000A"),
    "phone_0": _has("h", "+0"),
    "rut_0": _has("h", "000-"),
    "cpf_0": _has("g", "0" * 11),
    "cnpj_0": _has("g", "0" * 14),
    "credit_card_0": _has("g", "0" * 15),
    "ssn_0": _has("h", "000-00-0000"),
    "arg_dni_0": _has("h", "0.000.000"),
    "co_cc_0": _has("h", "0.000.000"),
    "co_nit_0": _has("h", "000000000-0"),
    "personnummer_0": _has("h", "000000-0000", "000000+0000"),
    "personnummer_1": _has("h", "00000000-0000"),
    "ec_cedula_0": _alone_run(10),
    "pe_dni_0": _alone_run(8),
    "pe_dni_bare_0": _alone_run(8),
    "npi_0": _alone_run(10),
    "nhs_0": _has("y", " 000 000 0000 ", " 000000 0000 ", " 000 0000000 ", " 0000000000 "),
    "uy_ci_0": _has("h", "0.000.000-0"),
    "sin_0": _has("h", "000-000-000"),
    "sin_1": _alone_run(9),
    "tfn_0": _has("h", "000 000 000"),
    "tfn_1": _alone_run(9),
    "pesel_0": _alone_run(11),
    "bsn_0": _alone_run(9),
    "my_number_0": _has("y", " 0000 0000 0000 "),
    "my_number_1": _alone_run(12),
    "rrn_0": _has("h", "000000-0000000"),
    "rrn_1": _alone_run(13),
    "za_id_0": _alone_run(13),
    "il_id_0": _alone_run(9),
}


def _state(x: str, *more: str) -> str:
    """The state of a text that a stage may have changed: its shape is taken anew before the next part of the cascade."""
    return f"named_struct({','.join([f'{chr(39)}x{chr(39)},{x}', *(f'{chr(39)}{k}{chr(39)},cast(NULL as string)' for k in 'hyg'), *more])})"


def _shaped(*more: str) -> str:
    """The state o with its shape, where it has none and the text is ASCII. A text of as many bytes as characters is."""
    state = f"named_struct('x', o.x, 'h', h, 'y', y, 'g', replace(y,' ',''){''.join(', ' + m for m in more)})"
    shape = _let("o.x", "x", _let(_H, "h", _let(_Y, "y", state)))
    return f"CASE WHEN o.h IS NULL AND octet_length(o.x) = char_length(o.x) THEN {shape} ELSE o END"


def _gated(name: str, then: str) -> str:
    """The next state; the same where the shape shows that the stage has nothing to do. Null shapes show nothing."""
    return f"CASE WHEN NOT {GATES[name]} THEN o ELSE {then} END"


def _part(body: str, names: Sequence[str], *more: str) -> str:
    """Several stages over o, passed over together where none has anything to do."""
    gates = " OR ".join(dict.fromkeys(GATES[n] for n in names))
    return _let(_shaped(*more), "o", f"CASE WHEN NOT ({gates}) THEN o ELSE {body} END")


# ---- whole functions of x ----

#: Stages of the cascade in one function.
CHUNK = 6
_TEXT = "STRUCT<x:STRING,h:STRING,y:STRING,g:STRING>"
_STATE = "STRUCT<x:STRING,h:STRING,y:STRING,g:STRING,n:MAP<INT,INT>>"


def _stages(families: Sequence[Family], counted: bool = True) -> list[tuple[str, str, str]]:
    """(family, stage's name, expression over x) in order; of (x, n) if ``counted``, else of the text alone."""
    out = []
    for f in families:
        name = f"{f.name}{'_bare' if f.name == 'pe_dni' and not f.forms[0].around else ''}"
        if f.name == "ip":
            out.append(("ip", "ip_v6", _v6_stage("x") if counted else f"({_v6_stage('x')}).x"))
        for k, (pattern, check, star) in enumerate(_forms(f)):
            if counted:
                stage = _stage("x", f.name, pattern, check, star)
            else:
                stage = _simple("x", pattern, check, star) if _alone(check) else f"({_stage('x', f.name, pattern, check, star)}).x"
            out.append((f.name, f"{name}_{k}", stage))
    return out


def _has_ip(families: Sequence[Family]) -> bool:
    return any(f.name == "ip" for f in families)


def _chunks(stages: list[tuple[str, str, str]]) -> list[tuple[str, list[tuple[int, str, str]]]]:
    """(name, (place, name, expression) of stages) that make one function together. The analyser passes over a function
    once for each level of its nesting, and over nested functions once more for each, so both stay few."""
    out = []
    for k in range(0, len(stages), CHUNK):
        part = stages[k : k + CHUNK]
        name = f"{k}," + ",".join(n for _, n, _ in part)
        out.append((hashlib.sha256(name.encode()).hexdigest()[:16], [(k + i, n, e) for i, (_, n, e) in enumerate(part)]))
    return out


def mask(families: Sequence[Family], make) -> str:
    """Values without a digit or @ go through the stages as null and are then taken as they are."""
    run = f"CASE WHEN x rlike '[0-9@]' THEN {_state('x')} END"
    for name, stages in _chunks(_stages(families, False)):
        body = "o"
        for _, stage, text in stages:
            changed = _let(_let("o.x", "x", text), "w", f"CASE WHEN w = o.x THEN o ELSE {_state('w')} END")
            body = _let(body, "o", _gated(stage, changed)) if body != "o" else _gated(stage, changed)
        body = _part(body, [n for _, n, _ in stages])
        run = f"{make('masked_' + name, 'o ' + _TEXT, _TEXT, f'CASE WHEN o IS NOT NULL THEN {body} END')}({run})"
    alone = f"CASE WHEN {_has_v6('x')} THEN ({_v6_stage('x')}).x ELSE x END" if _has_ip(families) else "x"
    return f"coalesce(({run}).x, {alone})"


def audit(families: Sequence[Family], make) -> str:
    """The cascade with its counts: the state is the text, its shape and a map of counts, from the places of stages that masked something."""
    stages = _stages(families)
    none = "'n',map_from_arrays(cast(array() as array<int>), cast(array() as array<int>))"
    run = f"CASE WHEN x rlike '[0-9@]' THEN {_state('x', none)} END"
    for name, part in _chunks(stages):
        body = "o"
        for place, stage, done in part:
            counted = f"{chr(39)}n{chr(39)},map_concat(o.n, map({place}, w.n))"
            changed = _let(_let("o.x", "x", done), "w", f"CASE WHEN w.n = 0 THEN o ELSE {_state('w.x', counted)} END")
            body = _let(body, "o", _gated(stage, changed)) if body != "o" else _gated(stage, changed)
        body = _part(body, [n for _, n, _ in part], "'n', o.n")
        run = f"{make('counted_' + name, 'o ' + _STATE, _STATE, f'CASE WHEN o IS NOT NULL THEN {body} END')}({run})"
    clean = f"named_struct('masked', {{}}, 'counts', {_counts({})})"
    found = _counted([n for n, _, _ in stages], "o.x", "o.n")
    counted = make(f"named_{_key(families)}", f"o {_STATE}", _AUDIT, f"CASE WHEN o IS NULL THEN NULL WHEN size(o.n) = 0 THEN {clean.format('o.x')} ELSE {found} END")
    clean = clean.format("x")
    if _has_ip(families):
        alone = _let(_v6_stage("x"), "w", f"named_struct('masked', w.x, 'counts', {_counts({'ip': 'w.n'})})")
        clean = f"CASE WHEN {_has_v6('x')} THEN {alone} ELSE {clean} END"
    return f"coalesce({counted}({run}), {clean})"


def _counts(found: dict[str, str]) -> str:
    return "named_struct(" + ",".join(f"'{n}',{found.get(n, '0')}" for n in FIELDS) + ")"


def _counted(stages: list[str], text: str, counts: str) -> str:
    found: dict[str, list[str]] = {}
    for i, n in enumerate(stages):
        found.setdefault(n, []).append(f"coalesce(element_at({counts},{i}),0)")
    return f"named_struct('masked', {text}, 'counts', {_counts({n: '+'.join(c) for n, c in found.items()})})"


def _first(family: Family) -> str:
    found = []
    for pattern, check, _ in _forms(family):
        if check is None:
            found.append(f"nullif(regexp_extract(x,{_raw(pattern)},{2 if pattern.startswith(SKIPS) else 0}),'')")
            continue
        if _alone(check):
            value = _TOKEN[family.name] if family.name in _TOKEN else f"CASE WHEN {check} THEN t END"
            found.append(f"get(filter(transform({_tokens('x', pattern)}, t -> {value}), v -> v IS NOT NULL),0)")
            continue
        token = _let("t", "t", _TOKEN[family.name]) if family.name in _TOKEN else "t"
        hits = f"filter(transform(s.t, (t, i) -> CASE WHEN {_valid(family.name, check)} THEN {token} END), v -> v IS NOT NULL)"
        found.append(f"CASE WHEN x rlike {_raw(pattern)} THEN {_let(_pieces('x', pattern), 's', f'get({hits},0)')} END")
    if family.name == "ip":
        found.append(f"CASE WHEN {_has_v6('x')} THEN {_let(_v6('x'), 'y', 'get(filter(y.z, z -> z IS NOT NULL),0).v')} END")
    return f"coalesce({','.join(found)})" if len(found) > 1 else found[0]


def extract(families: Sequence[Family], make) -> str:
    wanted = {f.name: f for f in families}
    fields = []
    for n in FIELDS:
        value = "cast(NULL as string)"
        if n in wanted:
            gate = f"(x rlike '[0-9@]' OR {_has_v6('x')})" if n == "ip" else "x rlike '[0-9@]'"
            value = f"CASE WHEN {gate} AND {_possible(wanted[n])} THEN {_first(wanted[n])} END"
        fields.append(f"'{n}',{value}")
    return f"named_struct({','.join(fields)})"


def _possible(family: Family) -> str:
    """A cheap test that every text with a token of the family passes."""
    if family.name == "email":
        return "contains(x, '@')"
    if family.name == "ip":
        return f"(x rlike {_raw('[.].*[.]|:.*:').replace('(?U)', '(?s)')})"
    return f"x rlike {_raw(chr(92) + 'd')}"


def contains(families: Sequence[Family], make) -> str:
    """Families without a check go first: one pattern says it all."""
    tests = []
    for f in {f.name: f for f in families}.values():
        hits = []
        for pattern, check, _ in _forms(f):
            if check is None:
                hits.append(f"x rlike {_raw(pattern)}")
            elif _alone(check):
                hits.append(f"exists({_tokens('x', pattern)}, t -> coalesce({check}, false))")
            else:
                hits.append(f"(x rlike {_raw(pattern)} AND {_let(_pieces('x', pattern), 's', f'exists({_flags(f.name, check)}, v -> v)')})")
        if f.name == "ip":
            hits.append(f"({_has_v6('x')} AND {_let(_v6('x'), 'y', 'exists(y.z, z -> z IS NOT NULL)')})")
        cost = sum(c is not None for _, c, _ in _forms(f))
        tests.append((cost, f"({_possible(f)} AND ({' OR '.join(hits)}))"))
    tests = [t for _, t in sorted(tests, key=lambda t: t[0])]
    gate = "x rlike '[0-9@]'" + (" OR " + _has_v6("x") if _has_ip(families) else "")
    return f"CASE WHEN x IS NULL THEN NULL WHEN {gate} THEN ({' OR '.join(tests)}) ELSE false END"


_AUDIT = "STRUCT<masked:STRING,counts:STRUCT<" + ",".join(f"{n}:INT" for n in FIELDS) + ">>"
KINDS = {"mask": (mask, "STRING"), "contains": (contains, "BOOLEAN"), "extract": (extract, "STRUCT<" + ",".join(f"{n}:STRING" for n in FIELDS) + ">"), "audit": (audit, _AUDIT)}


def _key(families: Sequence[Family]) -> str:
    names = ",".join(f.name if f is BY_NAME[f.name] else f"{f.name}!" for f in families)
    return hashlib.sha256(names.encode()).hexdigest()[:16]


def sql_function(spark, kind: str, families: Sequence[Family], name: str | None = None) -> str:
    """The name of the session's function of this kind for these families, made where it isn't there yet."""

    def make(name: str, parameters: str, returns: str, body: str) -> str:
        name = f"cloakframe_{name}"
        if not spark.catalog.functionExists(name):
            spark.sql(f"CREATE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
        return name

    name = name or f"cloakframe_{kind}_{_key(families)}"
    if not spark.catalog.functionExists(name):
        build, returns = KINDS[kind]
        spark.sql(f"CREATE TEMPORARY FUNCTION {name}(x STRING) RETURNS {returns} RETURN {build(families, make)}")
    return name
