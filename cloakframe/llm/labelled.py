"""A bounded sample of labelled documents for the classifiers, and what they share in training."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a model is fitted on, at most, half of each class; documented bound.
MAX_TRAIN = 6000
#: Standard errors by which held-out scores must tell the classes apart; else there is no model, and nothing is rejected.
TELLS = 2.0


def sample(docs: DataFrame, labels: DataFrame, label: str, extra: list[Column] = (), id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAIN) -> tuple[list[tuple], float]:
    """[(label, text, *extra)] of at most ``most`` / 2 documents of each class, those first in a
    hash order of their ids, and the share of class 1 among all labels. Labels that are null
    or contradict each other aren't used; of repeated rows with one id, the least text is."""
    agreed = (
        labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label).alias("y"), F.max(label).alias("z")).filter("y = z").select(F.col(id_col).alias("id"), "y")
    )
    counts = {r["y"]: r["n"] for r in agreed.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    parts = [agreed.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most // 2) for y in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most `most` rows of two numbers
    more = [f"x{k}" for k in range(len(extra))]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[c.alias(x) for c, x in zip(extra, more)]).filter("text IS NOT NULL")
    rows = texts.join(chosen, "id").groupBy("id", "y").agg(F.min(F.struct("text", *more)).alias("d")).select("id", "y", "d.*").collect()
    rows.sort(key=lambda r: (r["y"], r["id"]))
    return [(r["y"], r["text"], *(r[x] for x in more)) for r in rows], share


def held_out(y: np.ndarray) -> np.ndarray:
    """Every fifth of each class."""
    held = np.zeros(len(y), bool)
    for k in (0, 1):
        held[np.flatnonzero(y == k)[4::5]] = True
    return held


def ranked(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The share of pairs of the two classes that scores put in order, ties by half; and how many standard errors that is off chance."""
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    if not n1 or not n0:
        return 0.5, 0.0
    values, at, counts = np.unique(scores, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[at]
    share = (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
    return float(share), float((share - 0.5) / np.sqrt((n1 + n0 + 1) / (12 * n1 * n0)))


def threshold(scores: np.ndarray, y: np.ndarray, share: float) -> float:
    """The cut with the best F1 of class 1 on held-out scores, classes weighted to ``share``; amid the gap it falls in."""
    if not (y == 1).any() or not (y == 0).any():
        return 0.0
    order = np.argsort(-scores, kind="stable")
    s, w1 = scores[order], (y[order] == 1) * share / (y == 1).mean()
    w0 = (y[order] == 0) * (1 - share) / (y == 0).mean()
    tp, fp = np.cumsum(w1), np.cumsum(w0)
    f1 = 2 * tp / (tp + fp + w1.sum())
    ends = np.append(s[1:] != s[:-1], True)
    k = int(np.argmax(np.where(ends, f1, -1)))
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k]) - 1e-6
