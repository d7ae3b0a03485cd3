"""Secret scans by assignment-aware lexing.

A text is lexed into names, string literals, numbers and operators, with the syntax that common
languages and configuration files share: ``name = "x"``, ``name: str = 'x'``, ``{"name": "x"}``,
``obj["name"] = x``, ``NAME => x``, ``export NAME=x`` and ``name: x``, ``<name>x</name>`` and ``key="name" value="x"``. Each
assignment becomes a name and an expression: literals and names of constants, joined by ``+``, literals next to each other, in
brackets also over lines, literals with names in them (``f"{NAME}x"``, ```${NAME}x```), or a bare word. Constants are
propagated until nothing changes, also ones that are assigned further down; a literal with a name that is no constant stays as it is. The resolved literals
are scored by how sensitive the name they end up in is, and by how much they look like secrets.

The lexer runs over whole texts, but only texts with a word that makes a name sensitive are sent to
it: no other text can score.

Defined cases: null and empty texts have no findings; a name that is assigned several times gives
a finding for each literal, a constant stands for the last literal it was given before, or else the
first after; cycles, chains of 1000 constants and values that constants are joined to beyond ``LONGEST``
characters stay unresolved, of the latter the literal parts are values each; an apostrophe within a word opens no literal, and
literals are of any length; placeholders and references to the environment (all of
``${NAME}``, ``$NAME``, ``$(...)``) aren't literals, nor is prose of five words, unless it is an armoured key or its name says
a passphrase; repeated rows give findings each, a null id is kept; an empty table gives an empty one; texts and names of any
length are lexed whole; other columns, whatever their names, aren't looked at.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUT = 0.5
#: Characters of a value that is joined from constants, at most; literals may be of any length.
LONGEST = 8192

#: Parts of names and how much they say.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "api_key": 1.0, "accesskey": 1.0,
    "access_key": 1.0, "privatekey": 1.0, "private_key": 1.0, "secretkey": 1.0, "secret_key": 1.0, "credential": 0.9, "authkey": 0.9, "auth_key": 0.9,
    "encryption_key": 1.0, "signing_key": 1.0, "authorization": 0.8, "bearer": 0.8, "connection_string": 0.8, "client_key": 0.8,
}
#: Parts that take the meaning back: names of limits, places and kinds, not of secrets.
_MILD = re.compile(r"(?:^|_)(?:max|min|num|n|count|length|len|limit|size|type|kind|name|url|uri|path|file|field|column|label|id|expiry|expires|ttl|hint|policy|regex|pattern)$")
_ANY = "|".join(sorted({re.sub("_", "[_.-]?", k) for k in SENSITIVE}))
_HAS = re.compile(_ANY, re.I)

_LEX = re.compile(
    r"""(?P<str>\"\"\"|\'\'\'|"|(?:(?<!\w)|(?<=\b[rbfu]))'|`)
|(?P<name>(?!\d)[\w$]+(?:[.-][\w$]+)*)
|(?P<op>===?|!=|<=|>=|=>|:=|\?=|\+=|=|:(?!//)|\+|[\[\](){},;])
|(?P<num>\d[\w.]*)
|(?P<nl>\n)
|(?P<other>[^\s\w"'`=:+\[\](){},;\n])""",
    re.X | re.S,
)
#: The rest of a literal after its opening quote, and its closing quote if it has one.
_BODY = {
    '"""': re.compile(r'(?:[^"\\]|\\.|"(?!""))*+("""|)', re.S),
    "'''": re.compile(r"(?:[^'\\]|\\.|'(?!''))*+('''|)", re.S),
    '"': re.compile(r'(?:[^"\\\n]|\\.)*+("|)', re.S),
    "'": re.compile(r"(?:[^'\\\n]|\\.)*+('|)", re.S),
    "`": re.compile(r"[^`\n]*+(`|)"),
}
_BARE = re.compile(r"[^\s,;\"'`(){}\[\]<>]+")
_APOSTROPHE = re.compile(r"(?:(?<!\w)|(?<=\b[rbfu]))'")
_ASSIGN = {"=", ":=", "=>", ":", "?=", "+="}
_DUMMY = re.compile(
    r"(?i)^(?:x+|\*+|\.+|-+|_+|null|none|nil|true|false|undefined|todo|changeme|change[-_]me|example|sample|dummy|test|secret|password|your[-_ ].*|my[-_](?:password|token|secret)|enter[-_ ].*|insert[-_ ].*|redacted|"
    r"\$\{[^{}]*\}|\$(?-i:[A-Z_][A-Z0-9_]*|[a-z_]+)|\$\(.*\)|%\(?\w+\)?s?%?|\{\{.*\}\}|<.*>|process\.env.*|os\.environ.*|env\(.*)$"
)
#: An armoured key has spaces, and so has a passphrase under a name that promises one.
_PEM = re.compile(r"\s*-----BEGIN [A-Z0-9 ]+-----")
_PHRASE = re.compile(r"pass_?phrase")
_PREFIX = re.compile(r"(?i)[rbuf]|rb|br|rf|fr")
#: Names within a literal, by the kind of the term.
_FIELDS = {"fill": re.compile(r"(?<!\{)\{\s*([A-Za-z_][\w.]*)\s*\}(?!\})"), "tmpl": re.compile(r"\$\{\s*([A-Za-z_$][\w$.]*)\s*\}")}
_ELEMENT = re.compile(
    r"<([A-Za-z_][\w.:-]*)(?:\s[^<>]*)?>([^<>]+)</\1\s*>|\b(?:key|name)\s*=\s*(['\"])([^'\"<>]*)\3\s+value\s*=\s*(['\"])([^'\"<>]*)\5"
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}


def _tokens(text: str) -> list[tuple[str, str, int]]:
    """(kind, token, place) in order."""
    out, at, fails = [], 0, dict.fromkeys(_BODY, -1)
    while m := _LEX.search(text, at):
        kind, token, place = m.lastgroup, m[0], m.start()
        at = m.end()
        if kind == "str":
            at = place + 1
            for q in dict.fromkeys((token, token[0])):
                # A quote within what an unclosed one of its kind ran over isn't closed either.
                if place < fails[q] or not (q != "'" or _APOSTROPHE.match(text, place)):
                    continue
                body = _BODY[q].match(text, place + len(q))
                if body[1]:
                    token, at = text[place : body.end()], body.end()
                    break
                fails[q] = body.end()
            else:
                continue
        out.append((kind, token, place))
    return out


def _plain(token: str, raw: bool = False) -> tuple[str, int]:
    """The value of a string token, and how long its opening quote is."""
    q = 3 if token[:3] in ('"""', "'''") and len(token) >= 6 else 1
    body = token[q:-q]
    return (re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), body, flags=re.S) if "\\" in body and not raw else body), q


def _elements(text: str) -> list[tuple[str, list[tuple[str, str, int]], int]]:
    """Assignments by markup: elements with text, and pairs of a key and a value."""
    out = []
    for m in _ELEMENT.finditer(text) if "<" in text else ():
        name, k = (m[1], 2) if m[1] else (m[4], 6)
        value = m[k].strip()
        if name and value:
            out.append((name, [("lit", html.unescape(value), m.start(k) + m[k].index(value))], m.start()))
    return out


def _literal(toks: list, k: int) -> int:
    """How many tokens the literal at ``k`` takes, a prefix included; 0 where there is none."""
    if k < len(toks) and toks[k][0] == "str":
        return 1
    if k + 1 < len(toks) and toks[k][0] == "name" and toks[k + 1][0] == "str" and toks[k + 1][2] == toks[k][2] + len(toks[k][1]) and _PREFIX.fullmatch(toks[k][1]):
        return 2
    return 0


def assignments(text: str) -> list[tuple[str, list[tuple[str, str, int]], int]]:
    """(name, [(kind, value, place)], place) in order; kind is ``lit``, ``ref`` or ``word``, a name that may
    as well be a literal without quotes."""
    toks = _tokens(text)
    out, i, n = [], 0, len(toks)
    while i < n - 1:
        kind, value, place = toks[i]
        if kind == "name":
            name, j = value, i + 1
            # obj["name"] and a type between ":" and "=".
            while j + 2 < n and toks[j][1] == "[" and toks[j + 1][0] in ("str", "name") and toks[j + 2][1] == "]":
                inner = toks[j + 1]
                name += "." + (_plain(inner[1])[0] if inner[0] == "str" else inner[1])
                j += 3
            if j < n and toks[j][1] == ":":
                k = j + 1
                while k < n and (toks[k][0] == "name" or toks[k][1] in ("[", "]", ",")) and toks[k][1] != "=":
                    k += 1
                if k > j + 1 and k < n and toks[k][1] == "=":
                    j = k
        elif kind == "str":
            name, j = _plain(value)[0], i + 1
        else:
            i += 1
            continue
        if j >= n or toks[j][0] != "op" or toks[j][1] not in _ASSIGN or not name:
            i += 1
            continue
        op, after = toks[j][1], toks[j][2] + len(toks[j][1])
        # NAME=word, as in a shell or an .env file: the word is no reference.
        tight = op == "=" and j > 0 and toks[j - 1][2] + len(toks[j - 1][1]) == toks[j][2] and not text[after : after + 1].isspace()
        terms, j = _expression(text, toks, j + 1, op, tight, kind == "str")
        if terms:
            out.append((name, terms, place))
            i = j
        else:
            i += 1
    if found := _elements(text):
        out = sorted([*out, *found], key=lambda a: a[2])
    return out


def _bracketed(text: str, toks: list, start: int, quoted: bool) -> tuple[list, int]:
    """An expression in brackets, which may run over lines."""
    j, n, deep = start, len(toks), 0
    while j < n and (toks[j][1] == "(" or toks[j][0] == "nl"):
        deep += toks[j][1] == "("
        j += 1
    terms, j = _expression(text, toks, j, "=", False, quoted, True)
    while j < n and deep and (toks[j][1] == ")" or toks[j][0] == "nl"):
        deep -= toks[j][1] == ")"
        j += 1
    if deep or (j < n and (toks[j][1] == "=>" or toks[j][0] in ("name", "str", "num"))):
        return [], start
    return terms, j


def _expression(text: str, toks: list, j: int, op: str, tight: bool, quoted: bool, inside: bool = False) -> tuple[list, int]:
    terms: list[tuple[str, str, int]] = []
    n = len(toks)
    if j < n and toks[j][1] == "(" and not inside:
        return _bracketed(text, toks, j, quoted)
    while j < n:
        kind, value, place = toks[j]
        if kind == "nl" and not terms:
            return [], j
        if size := _literal(toks, j):
            prefix = value.lower() if size == 2 else ""
            token, at = toks[j + size - 1][1:]
            body, q = _plain(token, "r" in prefix)
            if j + size < n and toks[j + size][1] in (":", "=>") and toks[j + size][0] == "op" and not terms and op in (":", "=>"):
                return [], j  # a key of what follows
            as_ = "fill" if "f" in prefix else "tmpl" if token[0] == "`" else "lit"
            terms.append((as_ if as_ != "lit" and _FIELDS[as_].search(body) else "lit", body, at + q))
            j += size - 1
        elif kind in ("name", "num", "other") or value in "+":
            m = _BARE.match(text, place)
            word = m[0] if m else value
            called = text[place + len(word) : place + len(word) + 1] == "("
            called |= j + 1 < n and toks[j + 1][1] in "([" and toks[j + 1][2] == place + len(value)
            if called:
                return [], j + 1
            if kind == "name" and re.fullmatch(r"[A-Za-z_$][\w$.]*", word) and word == value and (not op == ":" or re.search(r"[A-Z_]", word) or quoted):
                terms.append(("word" if tight or re.search(r"\d", word) else "ref", word, place))
            elif terms or (op == ":" and word.isalpha()):
                return [], j + 1
            else:
                terms.append(("lit", word, place))
                end = place + len(word)
                while j < n and toks[j][2] < end:
                    j += 1
                return terms, j
        else:
            break
        j += 1
        k = j
        while inside and k < n and toks[k][0] == "nl":
            k += 1
        if k < n and toks[k][1] == "+":
            j = k + 1
            while j < n and toks[j][0] == "nl":
                j += 1
            continue
        if terms[-1][0] not in ("ref", "word") and (size := _literal(toks, k)) and not (k + size < n and toks[k + size][1] in _ASSIGN):
            j = k
            continue
        break
    return terms, j


def resolved(found: list[tuple[str, list, int]]) -> list[tuple[str, str, int, bool]]:
    """(name, literal, place of the literal's first part, whether constants were propagated) of each assignment that resolves."""
    by_name: dict[str, list[int]] = {}
    for k, (name, _, _) in enumerate(found):
        by_name.setdefault(name, []).append(k)

    def source(name: str, k: int) -> int | None:
        """The assignment that a name means in assignment k."""
        places = by_name.get(name, [])
        p = bisect_left(places, k)
        return places[p - 1] if p else next((x for x in places[p : p + 2] if x != k), None)

    values: dict[int, str | None] = {}
    via: set[int] = set()
    grown: list[int] = []
    for start in range(len(found)):
        stack = [start]
        while stack:
            k = stack[-1]
            if k in values:
                stack.pop()
                continue
            terms = found[k][1]
            parts, wait = [], []
            for kind, v, _ in terms:
                if kind in _FIELDS:
                    known = {x: s for x in _FIELDS[kind].findall(v) if (s := source(x, k)) is not None}
                    wait += [s for s in known.values() if s not in values]
                    if wait:
                        continue
                    fits = {x: values[s] for x, s in known.items() if values[s] is not None}
                    if len(v) + sum(len(fits.get(x, "")) for x in _FIELDS[kind].findall(v)) > LONGEST:
                        fits = {}  # beyond the bound it stays as it is
                    if fits:
                        via.add(k)
                    parts.append(_FIELDS[kind].sub(lambda m: fits.get(m[1], m[0]), v))  # noqa: B023
                    continue
                s = None if kind == "lit" else source(v, k)
                if kind == "lit" or (s is None and kind == "word" and len(terms) == 1):
                    parts.append(v)
                elif s is None:
                    parts.append(None)
                elif s in values:
                    parts.append(values[s])
                    via.add(k)
                else:
                    wait.append(s)
            if wait:
                if wait[0] in stack[-1000:] or len(stack) >= 1000:
                    values[k] = None  # a cycle, or a chain that long
                else:
                    stack.append(wait[0])
                continue
            values[k] = None
            if None not in parts:
                if len(parts) > 1 and k in via and sum(map(len, parts)) > LONGEST:
                    grown.append(k)
                else:
                    values[k] = "".join(parts)
            stack.pop()
    parts_of = {k: [(found[k][0], v, place, False) for kind, v, place in found[k][1] if kind == "lit" or kind in _FIELDS] for k in grown}
    out = []
    for k in range(len(found)):
        if (v := values[k]) is not None:
            out.append((found[k][0], v, found[k][1][0][2], k in via))
        out += parts_of.get(k, ())
    return out


def _snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower().replace("-", "_").replace(".", "_")


def name_weight(name: str) -> float:
    snake = _snake(name)
    if _MILD.search(snake):
        return 0.0
    return max((w for part, w in SENSITIVE.items() if part in snake), default=0.0)


def takes_phrase(name: str) -> bool:
    return bool(_PHRASE.search(_snake(name)))


def literal_weight(value: str, phrase: bool = False) -> float:
    """0 for placeholders and prose, near 1 for long mixed strings; ``phrase``: words with spaces are no prose."""
    if len(value) < 6 or _DUMMY.match(value) or (value.count(" ") > 3 and not phrase and not _PEM.match(value)):
        return 0.0
    counts = Counter(value)
    bits = -sum(c / len(value) * math.log2(c / len(value)) for c in counts.values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^\w\s]"))
    return min(1.0, 0.25 + 0.1 * kinds + bits / 6 + min(len(value), 40) / 100) if bits > 1 else 0.1


def findings(text: str | None, cut: float = CUT) -> list[tuple[str, str, int, bool, float]]:
    """(name, literal, place, propagated, score) of each assignment that scores ``cut`` or more."""
    if not text or not _HAS.search(text):
        return []
    out = []
    for name, value, place, via in resolved(assignments(text)):
        if w := name_weight(name):
            score = round(w * literal_weight(value, takes_phrase(name)), 6)
            if score >= cut:
                out.append((name, value, place, via, score))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """``doc_id``, ``name``, ``literal``, ``place`` (in characters), ``propagated`` and ``score`` of each finding."""
    kind = docs.schema[id_col].dataType.simpleString()
    asked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("text").rlike(f"(?i){_ANY}"))

    def run(batches):
        for b in batches:
            at, rows = [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                found = findings(text, cut)
                at += [k] * len(found)
                rows += found
            name, literal, place, via, score = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int32())), pa.array(name, pa.string()), pa.array(literal, pa.string()), pa.array(place, pa.int32()), pa.array(via, pa.bool_()), pa.array(score, pa.float64())],
                ["doc_id", "name", "literal", "place", "propagated", "score"],
            )

    return asked.mapInArrow(run, f"doc_id {kind}, name string, literal string, place int, propagated boolean, score double")
