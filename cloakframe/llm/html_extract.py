"""HTML extraction by line-block distribution.

Markup is stripped to lines of text: tags that set text apart break the line, with white space and one another, and
leave one empty line at most, so that blocks run across lists, tables and nested sections; the tags of the parts of a
page (``_PART``) leave ``BLOCK`` empty lines, all others vanish. The block of line i is the text length of
the ``BLOCK`` lines from i on. Over the blocks the text of a page stands out as plateaus: the slope from one block to the next
leaves zero at a surge point and comes back to it at the dive point, where a block is empty. A plateau is text if one of
its blocks is above ``SURGE``, or if it is long, with ``LONG`` times that in all, and less than half of it is links. The text between
the surge and dive points of these is kept, the rest is dropped.

Where a plateau stands decides between those that are left. In a ``nav``, ``footer`` or ``aside`` it is no text as long as the page has
any other. If none in an ``article`` or ``main`` is long or steep enough, those that are there are kept, beside
long ones elsewhere. A page without any such text has its surge at its largest block outside links.

Defined cases: a null page gives null, a page without text the empty string, an empty table an empty one; pages without markup
are lines of text like others; what an unclosed comment, script or style holds is dropped, other
unclosed elements and self-closed ones hide nothing; an unclosed head ends before the first text or tag that isn't a head's, an
unclosed ``nav``, ``footer`` or ``aside`` at the next ``article`` or ``main``; of plateaus that tie as largest all are kept; repeated
rows give the same; pages of any length are read whole; lengths count characters without white space; other columns, whatever
their names, aren't looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each

BLOCK = 3
#: Characters: about one and a half lines of prose in an alphabetic script.
SURGE = 120
#: A plateau of so many times SURGE characters outside links is text however low it is.
LONG = 2

_INSIDE = r"(?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+"
_TAIL = rf"(?=[\s/>]){_INSIDE}>"
#: What is inside isn't text: comments, script and style to the page's end if they have none, others if they are closed.
_OPENS = re.compile(rf"<!--|<(script|style|noscript|template|svg|iframe|select|textarea)(?:\Z|(?=[\s/>])(?:{_INSIDE}>)?)", re.I)
_ENDS = {k: re.compile(rf"</{k}\s*>", re.I) for k in ("script", "style", "noscript", "template", "svg", "iframe", "select", "textarea")} | {"": re.compile("-->")}
_TO_THE_END = {"", "script", "style"}
_PART = re.compile(r"<(/?)(article|aside|body|dialog|footer|html|main|nav)" + _TAIL, re.I)
_FLOW = "a|address|article|aside|b|blockquote|center|dialog|div|dl|fieldset|figure|font|footer|form|h[1-6]|header|hr|i|img|main|menu|nav|ol|p|pre|section|span|table|ul"
_BREAK = re.compile(
    r"</?(?:address|blockquote|br|caption|center|dd|details|div|dl|dt|fieldset|figcaption|figure|form|h[1-6]|header|hr|legend|li|menu|ol|option|p|pre|section|summary|table|tbody|td|tfoot|th|thead|title|tr|ul)" + _TAIL, re.I
)
_TAG = re.compile(r"<[/!?a-z](?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+>", re.I)
#: Up to </head>, or else the elements that only a head has.
_HEAD = re.compile(
    rf"<head{_TAIL}(?:(?:[^<]++|<(?!/?(?:head|body|{_FLOW})[\s/>]))*+</head\s*>|(?:\s++|<title{_TAIL}(?:[^<]++|<(?!/?[a-z]))*+</title\s*>|<(?:base|link|meta){_TAIL})*+)", re.I
)
_SPACE = re.compile(r"[^\S\n]+")
#: Stand for the tags of parts and breaks; both are white space and in no page.
_PARTED, _BROKEN = "\x1d", "\x1e"
#: Stand for the start and end of links, of boilerplate parts and of articles; noncharacters, which no page has.
_LINK, _END_LINK, _BOILER, _END_BOILER, _ARTICLE, _END_ARTICLE = (chr(0xFDD0 + k) for k in range(6))
_STATES = re.compile("[\ufdd0-\ufdd5]")
_MARKS = re.compile("(?<!\\s)[^\\S\x1d\x1e]*+[\x1d\x1e][\\s\ufdd0-\ufdd5]*")
_A = re.compile(rf"<(/?)a{_TAIL}", re.I)
_STATE_OF = {"nav": (_BOILER, _END_BOILER), "footer": (_BOILER, _END_BOILER), "aside": (_BOILER, _END_BOILER), "article": (_ARTICLE, _END_ARTICLE), "main": (_ARTICLE, _END_ARTICLE)}


def shown(page: str) -> str:
    """A page without comments, scripts, its head and other elements whose content isn't text."""
    kept, at, seek, unclosed = [], 0, 0, set()
    while m := _OPENS.search(page, seek):
        name, seek = (m[1] or "").lower(), m.end()
        if name and (name in unclosed or m[0].endswith("/>")):
            continue
        end = _ENDS[name].search(page, seek)
        if not end and name not in _TO_THE_END:
            unclosed.add(name)  # nor is any later one
            continue
        kept += [page[at : m.start()], "\n"]
        at = seek = end.end() if end else len(page)
    return _HEAD.sub("\n", "".join([*kept, page[at:]]))


def _parted(m: re.Match) -> str:
    return _PARTED + _STATE_OF.get(m[2].lower(), ("", ""))[bool(m[1])]


def _gap(block: int):
    def gap(m: re.Match) -> str:
        run = m[0]
        return "\n" * (block + 1 if _PARTED in run else min(2, run.count(_BROKEN))) + "".join(_STATES.findall(run))

    return gap


def lines(page: str, block: int = BLOCK) -> list[tuple[str, int, int]]:
    """(text, characters in links, place) of each line; the place is 0 in a nav, footer or aside, 2 in an article or main, else 1."""
    page = _STATES.sub("", page.replace("\r\n", "\n").replace("\r", "\n").replace(_PARTED, " ").replace(_BROKEN, " "))
    page = _BREAK.sub(_BROKEN, _PART.sub(_parted, shown(page)))
    page = _TAG.sub("", _A.sub(lambda m: _END_LINK if m[1] else _LINK, page))
    page = _MARKS.sub(_gap(block), entities.unescape(page))
    out, link, boiler, article = [], False, 0, 0
    for line in _SPACE.sub(" ", page).split("\n"):
        if not _STATES.search(line):
            text = line.strip()
            out.append((text, len(text) - text.count(" ") if link else 0, 0 if boiler else 2 if article else 1))
            continue
        linked, place, parts, at = 0, None, [], 0
        for m in [*_STATES.finditer(line), None]:
            piece = line[at : m.start() if m else len(line)]
            if piece.strip():
                place = (0 if boiler else 2 if article else 1) if place is None else place
                linked += len("".join(piece.split())) if link else 0
            parts.append(piece)
            if not m:
                break
            at = m.end()
            if m[0] in (_LINK, _END_LINK):
                link = m[0] == _LINK
            elif m[0] == _BOILER:
                boiler += 1
            elif m[0] == _END_BOILER:
                boiler = max(0, boiler - 1)
            elif m[0] == _ARTICLE:
                article, boiler = article + 1, 0
            else:
                article = max(0, article - 1)
        out.append((_SPACE.sub(" ", "".join(parts)).strip(), linked, 1 if place is None else place))
    return out


def plateaus(sizes: list[int], block: int = BLOCK) -> list[tuple[int, int, int]]:
    """(first, past the last line, largest block) between each surge point and its dive point."""
    total = [0, *accumulate(sizes)]
    n = len(sizes)
    found, start, peak = [], None, 0
    for i in range(n + 1):
        high = total[min(i + block, n)] - total[i] if i < n else 0
        if high:
            start, peak = (i, high) if start is None else (start, max(peak, high))
        elif start is not None:
            found.append((start, i, peak))
            start = None
    return found


def regions(sizes: list[int], block: int = BLOCK, surge: int = SURGE, links: list[int] | None = None, places: list[int] | None = None) -> list[tuple[int, int]]:
    """(first, past the last) line of each plateau that is kept."""
    kept = []
    for a, b, peak in plateaus(sizes, block):
        size, linked = sum(sizes[a:b]), sum(links[a:b]) if links else 0
        # Text begins up to block - 1 lines behind the surge, which is seen ahead.
        place = max((places[i] for i in range(a, b) if sizes[i]), default=1) if places else 1
        few = 2 * linked < size
        kept.append((place, few and peak > surge, few and size - linked > LONG * surge, peak if few else 0, a, b))
    inside = [k for k in kept if k[0] == 2 and k[3]]
    text = [k for k in kept if k[0] and (k[1] or k[2])]
    if inside and not any(k[0] == 2 for k in text):
        text = sorted([k for k in text if k[2]] + inside, key=lambda k: k[4])
    if not text:
        left = [k for k in kept if k[0] and k[3]] or [k for k in kept if k[1] or k[2]] or [k for k in kept if k[3]]
        # All of it is links: the largest are, nevertheless, what the page has.
        left = left or [(*k[:3], sum(sizes[k[4] : k[5]]), *k[4:]) for k in kept]
        text = [k for k in left if k[3] == max(x[3] for x in left)]
    return [(a, b) for *_, a, b in text]


def text_of(page: str | None, block: int = BLOCK, surge: int = SURGE) -> str | None:
    if page is None:
        return None
    all_lines = lines(page, block)
    sizes = [len(s) - s.count(" ") for s, _, _ in all_lines]
    kept = regions(sizes, block, surge, [k for _, k, _ in all_lines], [p for _, _, p in all_lines])
    return "\n".join(s for a, b in kept for s, _, _ in all_lines[a:b] if s)


def extracted(block: int = BLOCK, surge: int = SURGE):
    """A column function: a page to its text."""

    @F.arrow_udf("string")
    def extract(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for c in columns:
            yield pa.array([text_of(p, block, surge) for p in each(c)], pa.string())

    return extract


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", block: int = BLOCK, surge: int = SURGE) -> DataFrame:
    """``page_id`` and ``text`` for each page."""
    return pages.select(F.col(id_col).alias("page_id"), extracted(block, surge)(html_col).alias("text"))
