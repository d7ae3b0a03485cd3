"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle set, in powers of two. For a partition whose
largest item has u shingles, a document is seen as overlapping windows of 1.5 u shingles, u / 2
apart, so that any passage of u shingles lies within one of them and the sizes of item and window
are alike, however long the document is. Within a partition the bound on the sizes turns the
containment threshold into a Jaccard threshold, and that into the number of MinHash bands (of one
row) which finds a pair at the threshold with probability ``recall``. The minima of wide windows
come from those of narrow ones, so a shingle is hashed once for all partitions. An item whose
minimum equals a window's is a candidate, verified by exact containment: the share of its distinct
shingles that the whole document has.

Only the index of the items travels, checked in size: beyond ``INDEX_ITEMS`` items it is made in
parts, and the documents are searched for each part. Documents aren't shuffled.

The recall is that for items of which one window has the threshold. Of an item whose shingles are scattered over a document so that
no window has as much, each window that has some may find it; what is found is verified over the whole document.

Defined cases: null texts and texts without words match nothing; empty tables give an empty one; documents of any length are
searched whole; an item of m < n words is found
where its m words occur in a row; the same passage in repeated rows is reported for each;
repeated items are reported for each; null ids are kept; other columns, whatever their names, aren't looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS, WordHashes, shingles

NGRAM = 5
THRESHOLD = 0.5
RECALL = 0.99
#: Items in one part of the index: about 200 MB with sets of 50 shingles.
INDEX_ITEMS = 200_000
#: Shingles that are hashed at a time.
CHUNK = 1 << 18

def bands(threshold: float, recall: float) -> int:
    """One-row bands, as many as it takes, that find containment ``threshold`` of the least item of a partition in a window."""
    if not 0 < threshold <= 1 or not 0 < recall < 1:
        raise ValueError("the threshold must lie in (0, 1], the recall in (0, 1)")
    q, w = 0.5, 1.5  # in units of the partition's upper size
    s = threshold * q / (w + q - threshold * q)
    return math.ceil(math.log(1 - recall) / math.log(1 - s))


def _orders(n: int) -> list[tuple[np.uint32, np.uint32]]:
    """Multipliers and addends of n random orders."""
    rng = np.random.default_rng(7)
    return [(np.uint32(a | 1), np.uint32(b)) for a, b in rng.integers(1, 1 << 32, (n, 2), dtype=np.uint64)]


def _permuted(x: np.ndarray, order: tuple[np.uint32, np.uint32]) -> np.ndarray:
    y = x * order[0]
    y ^= y >> np.uint32(15)
    y += order[1]
    y *= np.uint32(0x85EBCA6B)
    return y


def _folded(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)


class Index:
    """The searchable form of some items [(id, text)]."""

    def __init__(self, items: list[tuple], n: int, threshold: float, recall: float) -> None:
        self.n, self.threshold, self.orders = n, threshold, _orders(bands(threshold, recall))
        cache = WordHashes()
        self.ids, self.sets, self.short = [], [], {}
        classes: dict[int, list[int]] = {}
        for key, text in items:
            m = len(words) if len(words := _words(text)) < n else n
            if not m:
                continue
            s = np.unique(shingles(text, n, cache))
            self.ids.append(key)
            self.sets.append(s)
            if m < n:
                self.short.setdefault(m, []).append(len(self.ids) - 1)
            else:
                classes.setdefault(max(2, 1 << (len(s) - 1).bit_length()), []).append(len(self.ids) - 1)
        self.classes = []
        for u in sorted(classes):
            who = np.array(classes[u])
            bits = 1 << max(16, (len(who) * 64 - 1).bit_length())
            per = []
            for p in self.orders:
                low = np.array([_permuted(_folded(self.sets[i]), p).min() for i in who], np.uint32)
                order = np.argsort(low)
                seen = np.zeros(bits, bool)
                seen[low & np.uint32(bits - 1)] = True
                per.append((low[order], who[order], seen))
            self.classes.append((u, per))

    def search(self, column: pa.Array, cache: WordHashes) -> Iterator[tuple[int, int, float]]:
        """(place in the column, item, containment) of every match."""
        for k in range(0, len(column), ROWS):
            for d, i, c in self._found(column.slice(k, ROWS).to_pylist(), cache):
                yield k + d, i, c

    def _found(self, texts: list[str | None], cache: WordHashes) -> Iterator[tuple[int, int, float]]:
        held: list[np.ndarray] = []
        first = size = 0
        for k, text in enumerate(texts):
            held.append(shingles(text, self.n, cache))
            size += len(held[-1])
            if size >= CHUNK:
                yield from self._search(first, held)
                held, first, size = [], k + 1, 0
        if held:
            yield from self._search(first, held)
        for m, who in self.short.items():
            wanted = np.array([self.sets[i][0] for i in who])
            for k, text in enumerate(texts):
                found = np.isin(wanted, shingles(text, m, cache)) if text and len(_words(text)) >= m else ()
                yield from ((k, who[j], 1.0) for j in np.flatnonzero(found))

    def _search(self, first: int, docs: list[np.ndarray]) -> Iterator[tuple[int, int, float]]:
        used = [k for k, s in enumerate(docs) if len(s)]
        if not used or not self.classes:
            return
        lens = np.array([len(docs[k]) for k in used])
        x = _folded(np.concatenate([docs[k] for k in used]))
        base = self.classes[0][0] // 2
        # Blocks of `base` shingles that never span two documents; those of wider classes join whole ones.
        layers = []
        counts, starts = _cut(lens, base)
        at, step = starts, base
        for u, per in self.classes:
            joins = []
            while step < u // 2:
                counts, again = _cut(counts, 2)
                joins.append(again)
                step *= 2
            layers.append((joins, np.repeat(np.arange(len(used)), counts), per))
        hits: set[tuple[int, int]] = set()
        for p, order in enumerate(self.orders):
            low = np.minimum.reduceat(_permuted(x, order), at)
            for joins, doc, per in layers:
                for again in joins:
                    low = np.minimum.reduceat(low, again)
                values, who, seen = per[p]
                win = low.copy()
                for d in (1, 2):
                    if len(low) > d:
                        same = doc[d:] == doc[:-d]
                        np.minimum(win[:-d], np.where(same, low[d:], 0xFFFFFFFF), out=win[:-d])
                maybe = np.flatnonzero(seen[win & np.uint32(len(seen) - 1)])
                if len(maybe):
                    lo, hi = np.searchsorted(values, win[maybe]), np.searchsorted(values, win[maybe], "right")
                    for w, a, b in zip(maybe[hi > lo], lo[hi > lo], hi[hi > lo]):
                        hits.update((int(doc[w]), int(i)) for i in who[a:b])
        by_doc: dict[int, list[int]] = {}
        for d, i in sorted(hits):
            by_doc.setdefault(d, []).append(i)
        for d, found in by_doc.items():
            mine = np.unique(docs[used[d]])
            for i in found:
                c = len(np.intersect1d(self.sets[i], mine, assume_unique=True)) / len(self.sets[i])
                if c >= self.threshold:
                    yield first + used[d], i, c


def _words(text: str | None) -> list[str]:
    from .common import WORD

    return WORD.findall(text.lower()) if text else []


def _cut(lens: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """How many pieces of ``step`` each run has, and where in the concatenation they start."""
    counts = -(-lens // step)
    offset = np.concatenate([[0], np.cumsum(lens)[:-1]])
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return counts, np.repeat(offset, counts) + within * step


def _parts(items: DataFrame, item_col: str, text_col: str, n: int, threshold: float, recall: float, most: int):
    rows = iter(items.select(item_col, text_col).toLocalIterator())
    while part := [tuple(r) for r in islice(rows, most)]:
        yield items.sparkSession.sparkContext.broadcast(Index(part, n, threshold, recall))


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, index_items: int = INDEX_ITEMS
) -> DataFrame:
    """``item_id``, ``doc_id``, ``containment`` for every item of which a document has at least ``threshold``."""
    kinds = {c: docs.schema[id_col].dataType if c == "doc_id" else items.schema[item_col].dataType for c in ("item_id", "doc_id")}
    out = docs.sparkSession.createDataFrame([], f"item_id {kinds['item_id'].simpleString()}, doc_id {kinds['doc_id'].simpleString()}, containment double")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    for part in _parts(items, item_col, item_text_col, n, threshold, recall, index_items):

        def find(batches, part=part):
            index, cache = part.value, WordHashes()
            for b in batches:
                found = list(index.search(b.column(1), cache))
                d, i, c = zip(*found) if found else ((), (), ())
                ids = [index.ids[k] for k in i]
                yield pa.RecordBatch.from_arrays([pa.array(ids) if ids else pa.nulls(0), b.column(0).take(pa.array(d, pa.int32())), pa.array(c, pa.float64())], ["item_id", "doc_id", "containment"])

        out = out.unionByName(rows.mapInArrow(_typed(find, out.schema), out.schema))
    return out


def _typed(fn, schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in fn(batches):
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, arrow)], schema=arrow)

    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, index_items: int = INDEX_ITEMS) -> DataFrame:
    """``docs`` without the rows that contain ``threshold`` or more of an item."""
    for part in _parts(items, item_col, item_text_col, n, threshold, recall, index_items):
        docs = docs.filter(~_dirty(part)(text_col))
    return docs


def _dirty(part):
    @F.arrow_udf("boolean")
    def dirty(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache = WordHashes()
        for c in columns:
            mask = np.zeros(len(c), bool)
            mask[[d for d, _, _ in part.value.search(c, cache)]] = True
            yield pa.array(mask)

    return dirty
