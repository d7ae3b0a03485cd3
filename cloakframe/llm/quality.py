"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The features of a document are its words, hashed to ``BUCKETS`` columns and weighted by the root of
their share, ``STATISTICS`` of its structure, and its source and language as hashed columns. The score is
bias + sum of w_i x_i + half of sum over f of ((sum v_if x_i)^2 - sum v_if^2 x_i^2), the pairwise interactions of all
features in time linear in the features by the sum-of-squares identity. Weights and the ``RANK`` factors
are trained in numpy by Adagrad on a bounded sample (``MAX_TRAIN``) of labelled documents, the cut on a
held-out fifth.

Defined cases: null and empty texts score with no words and zero statistics; metadata of any type count as strings, their
columns are found whatever the case of their names, as Spark does; a null source or
language is a value of its own, and so is a column that the table hasn't; without labels of both classes, or with labels that held-out
scores don't tell apart by ``labelled.TELLS`` standard errors, as with fewer than about 20 of each, the score is
null and nothing counts as low; an empty table gives an empty one; texts of any length are scored whole; repeated and tied rows
score alike; null ids are kept; extra columns, whatever their names, aren't looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import each
from .labelled import MAX_TRAIN, TELLS, held_out, ranked, sample, threshold

BUCKETS = 1 << 16
RANK = 8
EPOCHS = 8
BATCH = 64
RATE = 0.1
DECAY = 1e-5
SEED = 5
METADATA = ("source", "lang")
STATISTICS = 12

_WORD = re.compile(r"\w+")
_SYMBOL = re.compile(r"[^\w\s]")
_UPPER = re.compile(r"[A-Z]")
_DIGIT = re.compile(r"\d")


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        b = self[word] = crc32(word.encode("utf-8", "replace")) % BUCKETS
        return b


def statistics(text: str, words: list[str]) -> np.ndarray:
    """Numbers between about 0 and 1."""
    n, m = max(1, len(text)), max(1, len(words))
    all_lines = text.split("\n")
    long = [x for x in all_lines if x]
    symbols = len(_SYMBOL.findall(text))
    return np.array(
        [
            min(1.0, np.log1p(len(words)) / 10),
            min(1.0, symbols / m / 2),
            len(_UPPER.findall(text)) / n,
            len(_DIGIT.findall(text)) / n,
            min(1.0, sum(map(len, words)) / m / 12),
            len(set(words)) / m,
            1 - len(set(long)) / max(1, len(long)),
            min(1.0, m / max(1, len(long)) / 100),
            min(1.0, 20 * text.count("|") / n),
            min(1.0, 20 * (text.count("!") + text.count("#") + text.count("*")) / n),
            min(1.0, 10 * text.count(".") / n * 3),
            min(1.0, text.count("http") / m * 10),
        ]
    )


def features(text: str | None, meta: tuple, cache: _Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of a document; columns from BUCKETS on are statistics, then metadata among the buckets."""
    text = text or ""
    words = _WORD.findall(text.lower())
    if len(cache) > 150_000:
        cache.clear()
    if words:
        cols, counts = np.unique(np.fromiter(map(cache.__getitem__, words), np.int32, len(words)), return_counts=True)
        vals = np.sqrt(counts / len(words))
    else:
        cols, vals = np.empty(0, np.int32), np.empty(0)
    extra = [cache[f"\0{k}={v!r}"] for k, v in zip(METADATA, meta)]
    stats = statistics(text, words) if text else np.zeros(STATISTICS)
    return (np.concatenate([cols, np.arange(BUCKETS, BUCKETS + STATISTICS, dtype=np.int32), np.array(extra, np.int32)]), np.concatenate([vals, stats, np.full(len(extra), 0.5)]))


class Machine:
    """Bias, weights, factors and cut."""

    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray, cut: float = 0.0) -> None:
        self.bias, self.w, self.v, self.cut = bias, w, v, cut
        self.v2 = (v.astype(np.float64) ** 2).sum(axis=1)

    def score(self, col: np.ndarray, val: np.ndarray) -> float:
        pooled = val @ self.v[col]
        return float(self.bias + self.w[col] @ val + 0.5 * (pooled @ pooled - self.v2[col] @ (val * val)))

    def scores(self, texts: Iterable[str | None], metas: Iterable[tuple], cache: _Buckets | None = None) -> list[float]:
        cache = _Buckets() if cache is None else cache
        return [self.score(*features(t, m, cache)) for t, m in zip(texts, metas)]


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = EPOCHS) -> Machine:
    rng = np.random.default_rng(SEED)
    n = BUCKETS + STATISTICS
    w, v, bias = np.zeros(n), rng.normal(0, 0.05, (n, RANK)), 0.0
    gw, gv, gb = np.full(n, 1e-6), np.full(n, 1e-6), 1e-6
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), BATCH):
            which = order[k : k + BATCH]
            doc = np.repeat(np.arange(len(which)), [len(rows[i][0]) for i in which])
            col = np.concatenate([rows[i][0] for i in which])
            val = np.concatenate([rows[i][1] for i in which])
            vx = v[col] * val[:, None]
            pooled = np.stack([np.bincount(doc, vx[:, f], len(which)) for f in range(RANK)], axis=1)
            squares = np.bincount(doc, (vx**2).sum(axis=1), len(which))
            z = bias + np.bincount(doc, w[col] * val, len(which)) + 0.5 * ((pooled**2).sum(axis=1) - squares)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[which]) * weight[which] / len(which)
            ids, at = np.unique(col, return_inverse=True)
            d_w = np.bincount(at, err[doc] * val, len(ids)) + DECAY * w[ids]
            back = err[doc, None] * val[:, None] * (pooled[doc] - vx)
            d_v = np.stack([np.bincount(at, back[:, f], len(ids)) for f in range(RANK)], axis=1) + DECAY * v[ids]
            gw[ids] += d_w**2
            gv[ids] += (d_v**2).mean(axis=1)
            gb += err.sum() ** 2
            w[ids] -= RATE * d_w / np.sqrt(gw[ids])
            v[ids] -= 0.3 * RATE * d_v / np.sqrt(gv[ids])[:, None]
            bias -= RATE * err.sum() / np.sqrt(gb)
    return Machine(float(bias), w, v.astype(np.float32))


def _metadata(docs: DataFrame) -> list[Column]:
    """Source and language as strings, null where the table hasn't got them."""
    have = {c.lower(): c for c in docs.columns}
    return [(F.col(f"`{have[c]}`") if c in have else F.lit(None)).cast("string") for c in METADATA]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAIN) -> Machine | None:
    rows, share = sample(docs, labels, "quality", extra=_metadata(docs), id_col=id_col, text_col=text_col, most=most)
    y = np.array([r[0] for r in rows], np.int64)
    order = np.random.default_rng(SEED).permutation(len(y))
    y = y[order]
    held = held_out(y)
    if not (held & (y == 1)).any() or not (held & (y == 0)).any():
        return None
    cache = _Buckets()
    x = [features(rows[i][1], tuple(rows[i][2:]), cache) for i in order]
    machine = fit([r for r, h in zip(x, held) if not h], y[~held])
    scores = np.array([machine.score(*r) for r, h in zip(x, held) if h])
    if ranked(scores, y[held])[1] < TELLS:
        return None
    machine.cut = threshold(scores, y[held], share)
    return machine


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAIN, model: Machine | None = None) -> DataFrame:
    """``doc_id``, ``quality`` (probability that the document is good, 0.5 at the cut) and ``is_low`` for each document."""
    model = model or train(docs, labels, id_col, text_col, most)
    if model is None:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(None).cast("double").alias("quality"), F.lit(False).alias("is_low"))
    part = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x RANK numbers, whatever the corpus

    @F.arrow_udf("double")
    def margin(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        cache = _Buckets()
        for text, *meta in columns:
            yield pa.array(part.value.scores(each(text), zip(*map(each, meta)), cache), pa.float64())

    rows = docs.select(F.col(id_col).alias("doc_id"), margin(F.col(text_col), *_metadata(docs)).alias("m"))
    return rows.select("doc_id", (1 / (1 + F.exp(F.lit(model.cut) - F.col("m")))).alias("quality"), (F.col("m") < model.cut).alias("is_low"))
