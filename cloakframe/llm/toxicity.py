"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams with marked ends, and itself, hashed to ``BUCKETS``
rows of an embedding table; a document is the mean of its words. Table and softmax are
trained together by Adagrad on a bounded sample (``MAX_TRAIN``) of labelled documents; training stops where the ranking of
a held-out fifth gets no better, which also sets the cut. A misspelling that training never saw shares most n-grams with the word.

All buckets are trained, regularised by a scale: one whose rates among documents of the two classes are z standard errors apart
enters the mean by z^8 / (z^8 + ``TELLING``^8), so that what only tells by chance, mostly n-grams of words that one document or
all have, learns little. The scale depends on z alone, with few labels as with many.

As a softmax of two classes is linear in the mean, a document's margin is the mean of its words'
margins: scoring adds numbers that are looked up by word, in time linear in the text.

Defined cases: null texts and texts without words score the bias alone and aren't rejected;
without labels of both classes, or with labels that held-out scores don't tell apart by ``labelled.TELLS`` standard errors, as
with fewer than about 20 of each, nothing is rejected (the score is null); an empty table gives an empty one; texts
of any length are scored whole; repeated and tied rows score alike; null ids are kept; extra columns, whatever their names, aren't looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each
from .labelled import MAX_TRAIN, TELLS, held_out, ranked, sample, threshold

BUCKETS = 1 << 17
DIM = 4
EPOCHS = 20
BATCH = 64
RATE = 8.0
GRAMS = range(3, 7)
#: Standard errors between the classes' document rates of a bucket that enters by half.
TELLING = 3.5
SEED = 11
#: Words whose margin a worker remembers.
REMEMBERED = 200_000

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def buckets(word: str) -> list[int]:
    """Buckets of the distinct n-grams of a word. A word in Latin letters is cut as bytes, once for all its n-grams."""
    w = f"<{word}>"
    n = len(w)
    try:
        b = w.encode("latin-1")
    except UnicodeEncodeError:
        grams = [w[i : i + k].encode() for k in GRAMS for i in range(n - k + 1)] + [w.encode()]
    else:
        grams = [b[i : i + k] for k in GRAMS for i in range(n - k + 1)]
        grams.append(b)
    return [crc32(g) & (BUCKETS - 1) for g in dict.fromkeys(grams)]


def _counts(text: str | None) -> dict[str, int]:
    seen: dict[str, int] = {}
    for w in words(text):
        seen[w] = seen.get(w, 0) + 1
    return seen


def _scale(cols: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """By how much each bucket enters the mean."""
    n = np.array([(y == k).sum() for k in (0, 1)], float)
    df = np.zeros((2, BUCKETS))
    for c, k in zip(cols, y):
        df[k, c] += 1
    rate = df.sum(axis=0) / n.sum()
    error = np.sqrt(rate * (1 - rate) * (1 / np.maximum(n, 1)).sum())
    z = np.abs(df[1] / max(n[1], 1) - df[0] / max(n[0], 1)) / np.maximum(error, 1e-9)
    return (1 / (1 + (TELLING / np.maximum(z, 1e-3)) ** 8)).astype(np.float32)


class _Rows:
    """Documents as sparse rows: the weight of each bucket in the mean over words."""

    def __init__(self, texts: list[str | None]) -> None:
        cache: dict[str, np.ndarray] = {}
        self.cols, self.vals = [], []
        for t in texts:
            seen = _counts(t)
            total = sum(seen.values())
            c, v = [np.empty(0, np.int32)], [np.empty(0)]
            for w, k in seen.items():
                b = cache.get(w)
                if b is None:
                    b = cache[w] = np.array(buckets(w), np.int32)
                c.append(b)
                v.append(np.full(len(b), k / (total * len(b))))
            ids, at = np.unique(np.concatenate(c), return_inverse=True)
            self.cols.append(ids)
            self.vals.append(np.bincount(at, np.concatenate(v), len(ids)).astype(np.float32))
            if len(cache) > 100_000:
                cache.clear()

    def batch(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cols = [self.cols[i] for i in which]
        doc = np.repeat(np.arange(len(which)), [len(c) for c in cols])
        return doc, np.concatenate(cols), np.concatenate([self.vals[i] for i in which])


def _pooled(table: np.ndarray, doc: np.ndarray, col: np.ndarray, val: np.ndarray, n: int) -> np.ndarray:
    x = table[col] * val[:, None]
    return np.stack([np.bincount(doc, x[:, d], n) for d in range(table.shape[1])], axis=1)


def fit(rows: _Rows, y: np.ndarray, held: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """The margin of each bucket and the bias, of embeddings and softmax that are trained together on equally weighted classes."""
    rng = np.random.default_rng(SEED)
    fitted, out = np.flatnonzero(~held), np.flatnonzero(held)
    scale = _scale([rows.cols[i] for i in fitted], y[fitted])
    table = np.zeros((BUCKETS, DIM), np.float32)
    soft, bias = rng.normal(0, 0.3, (DIM, 2)), np.zeros(2)
    g_table, g_soft, g_bias = np.full(BUCKETS, 1e-8), np.full((DIM, 2), 1e-8), np.full(2, 1e-8)
    weight = np.where(y == 1, 0.5 / max(1, (y[fitted] == 1).sum()), 0.5 / max(1, (y[fitted] == 0).sum())) * len(fitted)
    best, kept, tried = -1.0, (np.zeros(BUCKETS, np.float32), 0.0), 0
    for _ in range(epochs):
        order = rng.permutation(fitted)
        for k in range(0, len(order), BATCH):
            which = order[k : k + BATCH]
            doc, col, val = rows.batch(which)
            val = val * scale[col]
            h = _pooled(table, doc, col, val, len(which))
            z = h @ soft + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(which)), y[which]] -= 1
            p *= weight[which, None] / len(which)
            x = (p @ soft.T)[doc] * val[:, None]
            grad = np.stack([np.bincount(col, x[:, d], BUCKETS) for d in range(DIM)], axis=1)
            g_table += (grad**2).mean(axis=1)
            table -= (RATE * grad / np.sqrt(g_table)[:, None]).astype(np.float32)
            gs, gb = h.T @ p, p.sum(axis=0)
            g_soft += gs**2
            g_bias += gb**2
            soft -= 0.1 * gs / np.sqrt(g_soft)
            bias -= 0.1 * gb / np.sqrt(g_bias)
        margin = ((table @ (soft[:, 1] - soft[:, 0])) * scale).astype(np.float32)
        now, _ = ranked(np.array([rows.vals[i] @ margin[rows.cols[i]] for i in out]), y[out])
        tried += 1
        if now > best:
            best, kept, tried = now, (margin, float(bias[1] - bias[0])), 0
        if tried == 4:
            break
    return kept


class Model:
    """What scoring needs: a margin for each bucket, the bias and the cut."""

    def __init__(self, margin: np.ndarray, bias: float, cut: float) -> None:
        self.margin, self.bias, self.cut = margin, bias, cut
        self._met: _Margins | None = None

    @classmethod
    def train(cls, texts: list[str | None], y: np.ndarray, share: float) -> Model | None:
        """None if held-out scores don't tell the classes apart."""
        held = held_out(y)
        if not (held & (y == 1)).any() or not (held & (y == 0)).any():
            return None
        rows = _Rows(texts)
        margin, bias = fit(rows, y, held)
        scores = np.array([rows.vals[i] @ margin[rows.cols[i]] for i in np.flatnonzero(held)]) + bias
        if ranked(scores, y[held])[1] < TELLS:
            return None
        return cls(margin, bias, threshold(scores, y[held], share))

    def remembered(self) -> _Margins:
        """The words' margins that this process has met, kept from one task to the next."""
        if self._met is None:
            self._met = _Margins(self.margin)
        return self._met

    def __reduce__(self):
        return Model, (self.margin, self.bias, self.cut)

    def margins(self, texts: Iterable[str | None], cache: dict[str, float] | None = None) -> list[float]:
        cache = _Margins(self.margin) if cache is None else cache
        out = []
        for t in texts:
            w = words(t)
            out.append(self.bias + (sum(map(cache.__getitem__, w)) / len(w) if w else 0.0))
            if len(cache) > REMEMBERED:
                cache.clear()
        return out


class _Margins(dict):
    """word -> margin."""

    def __init__(self, margin: np.ndarray) -> None:
        super().__init__()
        self.margin = margin.astype(float).tolist()

    def __missing__(self, word: str) -> float:
        b = buckets(word)
        m = self[word] = sum(map(self.margin.__getitem__, b)) / len(b)
        return m


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAIN) -> Model | None:
    rows, share = sample(docs, labels, "toxic", id_col=id_col, text_col=text_col, most=most)
    y = np.array([r[0] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return None
    order = np.random.default_rng(SEED).permutation(len(y))
    return Model.train([rows[i][1] for i in order], y[order], share)


def _scorer(spark, model: Model):
    part = spark.sparkContext.broadcast(model)  # BUCKETS numbers, whatever the corpus

    @F.arrow_udf("double")
    def margin(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache = part.value.remembered()
        for c in columns:
            yield pa.array(part.value.margins(each(c), cache), pa.float64())

    return margin


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAIN, model: Model | None = None) -> DataFrame:
    """``doc_id``, ``toxicity`` (probability, 0.5 at the cut) and ``is_toxic`` for each document."""
    model = model or train(docs, labels, id_col, text_col, most)
    if model is None:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(None).cast("double").alias("toxicity"), F.lit(False).alias("is_toxic"))
    margin = _scorer(docs.sparkSession, model)(text_col)
    p = 1 / (1 + F.exp(F.lit(model.cut) - F.col("m")))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"), margin.alias("m")).select("doc_id", p.alias("toxicity"), F.coalesce((F.col("m") > model.cut) & F.col("t").rlike("(?U)\\p{IsAlphabetic}"), F.lit(False)).alias("is_toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAIN, model: Model | None = None) -> DataFrame:
    """``docs`` without the rows that are rejected; all columns stay."""
    model = model or train(docs, labels, id_col, text_col, most)
    if model is None:
        return docs
    return docs.filter(~F.coalesce((_scorer(docs.sparkSession, model)(text_col) > model.cut) & F.col(text_col).rlike("(?U)\\p{IsAlphabetic}"), F.lit(False)))
