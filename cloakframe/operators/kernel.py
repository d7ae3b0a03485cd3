"""The cascade in Python over batches of values, for the modes that Catalyst can't express.

A batch goes through the families stage by stage, so that all tokens of a stage are encrypted
together. Spans that were rewritten are claimed: later families leave them alone.
"""

from __future__ import annotations

from collections.abc import Sequence

import regex as re

from ..families import Family, ipv6_spans, mask_ipv6
from .crypto import Many

_CANDIDATE = re.compile(r"[0-9@]")


def scope(s: str, families: Sequence[Family]) -> Sequence[Family]:
    """The families that a value has to go through; without a digit or @ none, or addresses alone."""
    if _CANDIDATE.search(s):
        return families
    if s.count(":") >= 2:
        return [f for f in families if f.name == "ip"][:1]
    return ()


def starred(s: str, family: Family) -> tuple[str, int]:
    """The value with the family's tokens masked, and how many there were."""
    count = 0
    if family.name == "ip":
        parts, last = [], 0
        for start, end, address in ipv6_spans(s):
            parts += [s[last:start], mask_ipv6(address)]
            last, count = end, count + 1
        s = "".join([*parts, s[last:]])
    for form in family.forms:
        whole = s

        def masked(m):
            nonlocal count
            if not form.accepts(whole, m):
                return m[0]
            count += 1
            return form.star(m[0])

        s = form.regex.sub(masked, whole)
    return s, count


def mask(s: str | None, families: Sequence[Family]) -> str | None:
    if s is None:
        return None
    for f in scope(s, families):
        s, _ = starred(s, f)
    return s


def audit(s: str | None, families: Sequence[Family]) -> tuple[str | None, dict[str, int]]:
    counts: dict[str, int] = {}
    for f in scope(s, families) if s is not None else ():
        s, n = starred(s, f)
        counts[f.name] = counts.get(f.name, 0) + n
    return s, counts


def first(s: str | None, family: Family) -> str | None:
    """The first valid token; hits of a family's first form go before those of its second."""
    if s is None or not scope(s, [family]):
        return None
    for form in family.forms:
        for m in form.regex.finditer(s):
            if form.accepts(s, m):
                from ..families import iban_length

                return m[0][: iban_length(m[0])] if family.name == "iban" else m[0]
    if family.name == "ip":
        return next((s[a:b] for a, b, _ in ipv6_spans(s)), None)
    return None


def contains(s: str | None, families: Sequence[Family]) -> bool | None:
    return None if s is None else any(first(s, f) is not None for f in families)


def refill(template: str, digits: str) -> str:
    """The template with its ASCII digits replaced from left to right."""
    it = iter(digits)
    return "".join(next(it, c) if "0" <= c <= "9" else c for c in template)


def replaced(values: Sequence[str | None], families: Sequence[Family], encrypt: Many, strict: bool = False) -> list[str | None]:
    """The cascade with the digits of reversible families encrypted.

    A token that ``encrypt`` has no answer for stays in clear and unclaimed; with ``strict`` that is an error.
    """
    out = list(values)
    live = [None if s is None else {id(f) for f in scope(s, families)} for s in values]
    claims: list[list[tuple[int, int]]] = [[] for _ in values]
    for f in families:
        rows = [i for i, fs in enumerate(live) if fs and id(f) in fs]
        if not f.reversible:
            for i in rows:
                out[i] = starred(out[i], f)[0]
            continue
        for form in f.forms:
            wanted = []
            for i in rows:
                s = out[i]
                for m in form.regex.finditer(s):
                    a, b = m.span()
                    if any(a < y and x < b for x, y in claims[i]) or not form.accepts(s, m):
                        continue
                    head, tail = f.split(m[0])
                    head = min(head, len(m[0]))
                    template = m[0][head : len(m[0]) - tail]
                    plain = "".join(c for c in template if "0" <= c <= "9")
                    if f.name != "phone" or len(plain) >= 2:
                        wanted.append((i, a + head, b - tail, (a, b), template, plain))
            cells = encrypt([w[5] for w in wanted]) if wanted else []
            for (i, a, b, span, template, _), cell in zip(wanted, cells):
                if cell is None:
                    if strict:
                        raise ValueError(f"a {f.name} token lies outside the cipher's domain")
                    continue
                claims[i].append(span)
                out[i] = out[i][:a] + refill(template, cell) + out[i][b:]
    return out


def rekey(cell: str | None, pattern: str | None) -> tuple[int, int, str] | None:
    """(start, end, digits) of the part of a cell that is rotated; None if there is nothing to rotate."""
    from ..families import calling_code

    if cell is None or not any("0" <= c <= "9" for c in cell):
        return None
    start, end = 0, len(cell)
    if pattern == "phone":
        start = min(calling_code(cell), len(cell))
    elif pattern in ("rut", "co_nit") and "-" in cell:
        end = cell.rindex("-")
    return start, end, "".join(c for c in cell[start:end] if "0" <= c <= "9")
