"""License scans: a trained paragraph classifier, confirmed against templates.

A text is split into paragraphs (lines), long ones into windows of ``WINDOW`` words that overlap by half; windows also
run over the lines between two empty ones, for what is wrapped. All families of a window are found, each without the
words of the others; words that stand for several alike, such as a GPL without its version, are unknown.
Sparse features, the word 1-, 2- and 3-grams that occur in the templates, go into a multinomial logistic
regression over the licence families and an unknown class. It is trained in numpy on variations of the
templates, on texts that speak of licences without granting one, on grants under other names, and on ordinary paragraphs
from a bounded sample of documents (``MAX_TRAIN``, ``MAX_PARAGRAPHS``). A temperature fitted on held-out variations calibrates
the probabilities; a family under ``CONFIDENT`` is unknown. The family then is compared with its own templates:
it is confirmed if ``COVERED`` of the word pairs of one of them occur in the window.

All paragraphs are looked at. Those are licence-like, and classified, that have an anchor (words of rights and of licence
names), or enough word pairs of a template to be confirmed. A letter v before a number is a word of its own: ``GPLv3``
is "gpl v 3".

Defined cases: null and empty texts and texts that aren't licence-like have no rows; the overlapping
windows of a paragraph give one row a family, that of the highest probability, the first on ties; what is licence-like but of
no family is a row of family ``unknown``; repeated rows give rows each, a null id is kept; an empty table gives an empty one (and
trains on the templates alone); texts of any length are scanned whole; other columns, whatever their names, aren't looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each

WINDOW = 60
CONFIDENT = 0.6
COVERED = 0.6
#: Documents of which ordinary paragraphs are taken for training, at most; documented bound.
MAX_TRAIN = 400
#: Pieces of WINDOW words of their lines that are trained on, at most, the first in a hash order; documented bound.
MAX_PARAGRAPHS = 2000
#: Variations of each template.
VARIATIONS = 40
SEED = 3
UNKNOWN = "unknown"

TEMPLATES = {
    "MIT": [
        "released under the MIT License",
        "licensed under the MIT license",
        "permission is hereby granted, free of charge, to any person obtaining a copy",
        "SPDX-License-Identifier: MIT",
        "SPDX: MIT",
        "MIT License",
    ],
    "Apache-2.0": [
        "licensed under the Apache License, Version 2.0",
        "you may obtain a copy of the License at apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "SPDX: Apache-2.0",
        "Apache License, Version 2.0",
    ],
    "GPL-3.0": [
        "this work is licensed under the GNU General Public License, version 3",
        "under the terms of the GNU General Public License version 3",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "GPLv3",
        "GPL version 3",
        "GPL-3.0",
    ],
    "GPL-2.0": [
        "under the terms of the GNU General Public License, version 2",
        "licensed under GPL version 2",
        "SPDX-License-Identifier: GPL-2.0-only",
        "terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License",
        "GPLv2",
        "GPL version 2",
        "GPL-2.0",
    ],
    "LGPL": [
        "under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "LGPLv2.1",
        "LGPLv3",
        "LGPL-2.1",
        "LGPL-3.0",
    ],
    "AGPL-3.0": [
        "licensed under the GNU Affero General Public License, version 3",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "AGPLv3",
        "AGPL-3.0",
    ],
    "BSD": [
        "redistribution and use in source and binary forms, with or without modification, are permitted",
        "released under the BSD license",
        "use of this source code is governed by a BSD-style license",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX: BSD-3-Clause",
        "BSD license",
        "SPDX: BSD-2-Clause",
    ],
    "ISC": [
        "licensed under the ISC license",
        "permission to use, copy, modify, and/or distribute this software for any purpose",
        "SPDX-License-Identifier: ISC",
        "SPDX: ISC",
        "ISC license",
    ],
    "MPL-2.0": [
        "subject to the terms of the Mozilla Public License, v. 2.0",
        "SPDX-License-Identifier: MPL-2.0",
        "SPDX: MPL-2.0",
    ],
    "EPL": [
        "made available under the terms of the Eclipse Public License",
        "SPDX-License-Identifier: EPL-2.0",
        "SPDX: EPL-2.0",
    ],
    "CC-BY": [
        "licensed under CC BY 4.0",
        "this work is licensed under a Creative Commons Attribution 4.0 International License",
    ],
    "CC-BY-SA": [
        "licensed under CC BY-SA 4.0",
        "licensed under a Creative Commons Attribution-ShareAlike license",
    ],
    "CC-BY-NC": [
        "licensed under CC BY-NC 4.0",
        "licensed under a Creative Commons Attribution-NonCommercial license",
    ],
    "CC0": [
        "dedicated to the public domain under the CC0 license",
        "CC0 1.0 Universal public domain dedication, no rights reserved by copyright law",
        "SPDX: CC0-1.0",
    ],
    "Unlicense": [
        "free and unencumbered software released into the public domain, see unlicense.org license",
        "SPDX: Unlicense",
    ],
    "Proprietary": [
        "all rights reserved",
        "all rights reserved, no part may be copied without written permission",
        "proprietary and confidential, unauthorized copying is prohibited, copyright owner",
    ],
}

#: Licence-like, but of no family.
NOT_GRANTS = [
    "a driving license is required for this job",
    "the fishing licence costs ten dollars a year",
    "he lost his license to practice medicine",
    "copyright law protects original works of authorship",
    "please ask for permission before you enter",
    "the warranty lasts two years from the date of sale",
    "license plates must be visible",
    "read the license agreement of the vendor before installing",
    "licensed under terms that the customer has agreed on",
    "the city licensed the restaurant to sell beer",
    "permission denied",
    "this license key is valid for one computer",
    "under the license of a poet",
    "the general public was informed of the new version",
    "some rights reserved",
    "the unauthorized copying of keys was reported",
    "permission is granted to anyone to use this for any purpose, and to alter it and redistribute it freely",
]

#: Grants of no family: the blank takes a name that stands for any other.
OTHER_GRANTS = [
    "licensed under the {} License",
    "licensed under the {} License, Version 2.0",
    "released under the {} license",
    "this work is licensed under the {} License 1.1",
    "under the terms of the {} Public License, version 3",
    "you may use it under the {} license",
    "use of this software is governed by the {} license",
    "SPDX-License-Identifier: {}",
    "SPDX: {}",
]
OTHER_NAMES = ["Sleepycat", "Ruby", "Vim", "Academic Free", "Common Development", "Reciprocal", "Educational Community", "Q Public", "W3C Software", "Company X"]

ANCHOR = re.compile(
    r"(?i)licen[cs]|copyright|permission|permitted|redistribut|rights[\W_]+reserved|public[\W_]+domain|gpl|spdx|creative[\W_]+commons|"
    r"(?<![a-z0-9])cc(?:0|[\W_]+(?:by|0|zero)(?![a-z0-9]))"
)

_WORD = re.compile(r"[^\W_]+")
_VERSION = re.compile(r"(gpl|\b)v(?=[0-9])")


def words(text: str) -> list[str]:
    return _WORD.findall(_VERSION.sub(r"\1 v ", text.lower()))


def _grams(w: list[str], most: int = 3) -> Iterable[str]:
    for n in range(1, most + 1):
        for i in range(len(w) - n + 1):
            yield " ".join(w[i : i + n])


def _pairs(w: list[str]) -> set[tuple[str, str]]:
    return set(zip(w, w[1:]))


class Model:
    def __init__(self, classes: list[str], vocabulary: dict[str, int], weights: np.ndarray, bias: np.ndarray, temperature: float) -> None:
        self.classes, self.vocabulary, self.weights, self.bias, self.temperature = classes, vocabulary, weights, bias, temperature
        self.templates = {k: [_pairs(words(t)) for t in v] for k, v in TEMPLATES.items()}
        self.pairs = frozenset(p for ts in self.templates.values() for t in ts for p in t)

    def probabilities(self, w: list[str]) -> np.ndarray:
        ids = [i for i in {self.vocabulary.get(g, -1) for g in _grams(w)} if i >= 0]
        z = (self.bias + (self.weights[ids].sum(axis=0) if ids else 0)) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    def similarity(self, family: str, w: list[str]) -> float:
        """The largest share of a template's word pairs that occur."""
        mine = _pairs(w)
        return max(len(t & mine) / len(t) for t in self.templates[family])

    def licence_like(self, text: str, w: list[str]) -> bool:
        """Whether ``text``, of the words ``w``, has an anchor or can be confirmed."""
        if ANCHOR.search(text):
            return True
        mine = self.pairs.intersection(zip(w, w[1:]))
        return bool(mine) and any(len(t & mine) >= COVERED * len(t) for ts in self.templates.values() for t in ts)

    def claims(self, w: list[str]) -> list[tuple[str, float, frozenset[int]]]:
        """(family, similarity, places of its words) of templates that occur, the best first, each without the words of those
        before; unknown where the same words stand for several families."""
        free, out = [True] * len(w), []
        while True:
            at: dict[tuple[str, str], list[int]] = {}
            for i, pair in enumerate(zip(w, w[1:])):
                if free[i] and free[i + 1] and pair in self.pairs:
                    at.setdefault(pair, []).append(i)
            found = []
            for family, ts in self.templates.items():
                for t in ts:
                    mine = sorted(t & at.keys())
                    if mine and len(mine) >= COVERED * len(t):
                        mid = at[min(mine, key=lambda p: len(at[p]))][0]
                        near = [min(at[p], key=lambda i: abs(i - mid)) for p in mine]
                        found.append((len(mine) / len(t), len(mine), family, frozenset(j for i in near for j in (i, i + 1))))
            if not found:
                return out
            share, _, family, where = max(found, key=lambda f: f[:2])
            if any(f[2] != family and f[3] == where for f in found):
                family = UNKNOWN
            out.append((family, share, where))
            for j in where:
                free[j] = False

    def families(self, w: list[str]) -> list[tuple[str, float, float, bool, frozenset[int]]]:
        """(family, probability, similarity, confirmed, places) of all families of a window."""
        out, claims = [], self.claims(w)
        for claimed, near, where in claims or [(None, 0.0, frozenset())]:
            others = set().union(*(c[2] for c in claims)) - where
            rest = [x for i, x in enumerate(w) if i not in others]
            p = self.probabilities(rest)
            k = int(p.argmax())
            family = self.classes[k] if p[k] >= CONFIDENT and claimed != UNKNOWN else UNKNOWN
            if family == UNKNOWN:
                out.append((UNKNOWN, float(p[self.classes.index(UNKNOWN)]), 0.0, False, where))
            else:
                out.append((family, float(p[k]), near if family == claimed else self.similarity(family, rest), family == claimed, where))
        return out

    def text(self, text: str) -> list[tuple[int, str, float, float, bool]]:
        """(line, family, probability, similarity, confirmed) of a text; what runs over lines is of its first one."""
        lines = text.split("\n")
        rows = {(k, f[0]): f[1:] for k, line in enumerate(lines) for f in self.paragraph(line)}
        block: list[tuple[str, int]] = []
        for k, line in enumerate([*lines, ""]):
            if line.strip():
                block += [(x, k) for x in words(line)]
                continue
            w = [x for x, _ in block]
            for s in range(0, max(1, len(w) - WINDOW // 2), WINDOW // 2):
                part = w[s : s + WINDOW]
                if not self.licence_like(" ".join(part), part):
                    continue
                for family, *found, sure, where in self.families(part):
                    over = sorted({block[s + i][1] for i in where})
                    if sure and len(over) > 1 and not any(rows.get((x, family), (0, 0, False))[2] for x in over):
                        # Guesses at parts of what is confirmed as a whole.
                        rows = {at: r for at, r in rows.items() if at[0] not in over or r[2]}
                        rows[over[0], family] = (*found, sure)
            block = []
        return [(k, f, *rows[k, f]) for k, f in sorted(rows)]

    def paragraph(self, text: str) -> list[tuple[str, float, float, bool]]:
        """(family, probability, similarity, confirmed) of the families of a paragraph."""
        w = words(text)
        best: dict[str, tuple[float, float, bool]] = {}
        starts = range(0, max(1, len(w) - WINDOW // 2), WINDOW // 2)
        for s in starts:
            part = w[s : s + WINDOW]
            if not self.licence_like(" ".join(part), part):
                continue
            for family, *found, _ in self.families(part):
                if family not in best or found[0] > best[family][0]:
                    best[family] = tuple(found)
        if len(best) > 1 and UNKNOWN in best:
            del best[UNKNOWN]
        return [(f, *best[f]) for f in sorted(best)]


def _variation(w: list[str], filler: list[str], rng: np.random.Generator) -> list[str]:
    """A template with some words lost, and words of ordinary text around it."""
    kept = [x for x in w if rng.random() > 0.06] if len(w) > 6 else list(w)
    around = lambda: [filler[i] for i in rng.integers(0, len(filler), rng.integers(0, 25))] if filler and rng.random() < 0.6 else []
    return [*around(), *kept, *around()]


def fit(ordinary: list[str]) -> Model:
    """``ordinary``: paragraphs that grant nothing."""
    rng = np.random.default_rng(SEED)
    classes = [*TEMPLATES, UNKNOWN]
    plain = [w for p in ordinary if not ANCHOR.search(p) and (w := words(p))]
    filler = [x for w in plain for x in w]
    rows, y = [], []
    for k, family in enumerate(TEMPLATES):
        for t in TEMPLATES[family]:
            w = words(t)
            rows += [w, *(_variation(w, filler, rng) for _ in range(VARIATIONS))]
            y += [k] * (VARIATIONS + 1)
    for t in NOT_GRANTS:
        w = words(t)
        rows += [w, *(_variation(w, filler, rng) for _ in range(VARIATIONS))]
        y += [len(TEMPLATES)] * (VARIATIONS + 1)
    for t in OTHER_GRANTS:
        rows += [_variation(words(t.format(OTHER_NAMES[i])), filler, rng) for i in rng.integers(0, len(OTHER_NAMES), VARIATIONS)]
        y += [len(TEMPLATES)] * VARIATIONS
    rows += plain
    y += [len(TEMPLATES)] * len(plain)
    vocabulary: dict[str, int] = {}
    for texts in [*TEMPLATES.values(), NOT_GRANTS]:
        for t in texts:
            for g in _grams(words(t)):
                vocabulary.setdefault(g, len(vocabulary))
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, w in enumerate(rows):
        x[i, [j for j in {vocabulary.get(g, -1) for g in _grams(w)} if j >= 0]] = 1
    y = np.array(y)
    held = rng.random(len(y)) < 0.2
    weights, bias = _descend(x[~held], y[~held], len(classes))
    z = x[held] @ weights + bias
    losses = []
    grid = np.geomspace(0.2, 5, 40)
    for t in grid:
        q = z / t
        q = q - q.max(axis=1, keepdims=True)
        losses.append(-(q[np.arange(len(q)), y[held]] - np.log(np.exp(q).sum(axis=1))).mean())
    return Model(classes, vocabulary, weights, bias, float(grid[int(np.argmin(losses))]))


def _descend(x: np.ndarray, y: np.ndarray, n: int, steps: int = 150) -> tuple[np.ndarray, np.ndarray]:
    weights, bias = np.zeros((x.shape[1], n), np.float32), np.zeros(n, np.float32)
    hit = np.zeros((len(y), n), np.float32)
    hit[np.arange(len(y)), y] = 1
    share = (1 / np.maximum(1, hit.sum(axis=0)))[y][:, None] / n
    g2, b2 = np.full_like(weights, 1e-8), np.full_like(bias, 1e-8)
    for _ in range(steps):
        z = x @ weights + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = (p - hit) * share
        gw, gb = x.T @ d + 1e-5 * weights, d.sum(axis=0)
        g2 += gw**2
        b2 += gb**2
        weights -= 0.3 * gw / np.sqrt(g2)
        bias -= 0.3 * gb / np.sqrt(b2)
    return weights, bias


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAIN) -> Model:
    """Fitted on the templates and ``MAX_PARAGRAPHS`` pieces of all lines of ``most`` documents, the first in a hash order of their
    ids, then texts; of the pieces, those first in a hash order of their words."""
    rows = docs.select(F.xxhash64(id_col).alias("h"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    last = rows.select("h", "t").orderBy("h", "t").limit(most).agg(F.max(F.struct("h", "t")).alias("last")).first()["last"]
    if last is None:
        return fit([])
    some = rows.filter((F.col("h") < last["h"]) | ((F.col("h") == last["h"]) & (F.col("t") <= last["t"])))
    lines = some.select(F.explode(F.split("text", "\n")).alias("line")).select(F.split(F.trim("line"), r"\s+").alias("w"))
    pieces = lines.select(F.explode(F.expr(f"transform(sequence(0, size(w) - 1, {WINDOW}), i -> array_join(slice(w, i + 1, {WINDOW}), ' '))")).alias("p"))
    first = pieces.filter("p <> ''").distinct().orderBy(F.xxhash64("p"), "p").limit(MAX_PARAGRAPHS)
    return fit([r["p"] for r in first.collect()])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """``doc_id``, ``paragraph`` (from 0), ``family``, ``probability``, ``similarity`` and ``confirmed`` for what licence-like
    paragraphs say."""
    model = model or train(docs, id_col, text_col)
    part = docs.sparkSession.sparkContext.broadcast(model)  # the templates' n-grams, whatever the corpus
    kind = docs.schema[id_col].dataType.simpleString()
    asked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            at, rows = [], []
            for k, text in enumerate(each(b.column(1))):
                if not text or not part.value.licence_like(text, words(text)):
                    continue
                found = part.value.text(text)
                at += [k] * len(found)
                rows += found
            number, family, prob, near, sure = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int32())), pa.array(number, pa.int32()), pa.array(family, pa.string()), pa.array(prob, pa.float64()), pa.array(near, pa.float64()), pa.array(sure, pa.bool_())],
                ["doc_id", "paragraph", "family", "probability", "similarity", "confirmed"],
            )

    return asked.mapInArrow(run, f"doc_id {kind}, paragraph int, family string, probability double, similarity double, confirmed boolean")
