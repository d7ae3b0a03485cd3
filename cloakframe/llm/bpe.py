"""BPE encoding and decoding by forced-boundary splitting.

A merge can only ever join two bytes that stand side by side in some token. A byte pair that no token
of the vocabulary has inside it therefore marks a certain cut: no token spans it, whatever the
text around. Texts are cut at all such pairs in one vectorised pass, each distinct fragment is
encoded once by itself (split by the vocabulary's pattern, then merged by rank, in a compiled library) and the ids of the
fragments are concatenated. The result equals encoding the whole text.

The pattern looks ahead in one place, at the end of a run of white space, and an apostrophe may
open a contraction; so no cut is made behind white space, nor before an apostrophe that follows
anything but a letter or digit of ASCII, nor within a character.

Defined cases: a null text has null ids and a null round trip; an empty text has no ids; repeated
rows are encoded alike; texts of any length are encoded whole; decoding an id outside the vocabulary gives null; an empty table gives an empty one; extra columns pass through.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROWS, each

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Distinct fragments that a worker remembers, and the longest it remembers, in bytes.
REMEMBERED = 150_000
LONGEST = 64

_SPACES = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32]


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec(dict):
    """fragment -> ids, filled on demand; also the tables that cutting and decoding need."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        super().__init__()
        self.ranks, self.pattern = ranks, pattern
        self._ready()

    def __reduce__(self):
        return Codec, (self.ranks, self.pattern)

    def _ready(self) -> None:
        self.merges = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.tokens = {i: t for t, i in self.ranks.items()}
        inside = np.zeros((256, 256), bool)
        for t in self.ranks:
            a = np.frombuffer(t, np.uint8)
            inside[a[:-1], a[1:]] = True
        cut = ~inside
        cut[:, 0x80:0xC0] = False  # within a character
        cut[_SPACES] = False
        alnum = np.array([chr(i).isalnum() and i < 128 for i in range(256)])
        cut[~alnum, ord("'")] = False
        self.cut = cut.ravel()

    def cuts(self, b: bytes) -> np.ndarray:
        """Where fragments end, the last at the end of ``b``."""
        a = np.frombuffer(b, np.uint8)
        pair = a[:-1].astype(np.uint16)
        pair <<= np.uint16(8)
        pair |= a[1:]
        at = np.flatnonzero(self.cut[pair]) + 1
        wide = at[(at >= 2) & (a[at - 1] >= 0x80)]
        if len(wide):  # white space of several bytes, told by its last ones
            two, three = a[wide - 2], a[np.maximum(wide - 3, 0)]
            last = a[wide - 1]
            white = ((two == 0xC2) & ((last == 0x85) | (last == 0xA0))) | ((three >= 0xE1) & (three <= 0xE3) & ((two == 0x80) | (two == 0x81) | (two == 0x9A)))
            if white.any():
                at = np.setdiff1d(at, wide[white], assume_unique=True)
        return np.append(at, len(b))

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        b = text.encode("utf-8", "replace")
        ends = self.cuts(b).tolist()
        out = list(chain.from_iterable(map(self.__getitem__, map(b.__getitem__, map(slice, [0, *ends[:-1]], ends)))))
        if len(self) > REMEMBERED:
            self.clear()
        return out

    def __missing__(self, fragment: bytes) -> list[int]:
        ids = self.merges.encode_ordinary(fragment.decode("utf-8", "replace"))
        if len(fragment) <= LONGEST:
            self[fragment] = ids
        return ids

    def decode(self, ids: list[int]) -> str | None:
        try:
            return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")
        except KeyError:
            return None


def _shared(spark: SparkSession, vocabulary: str):
    """The codec for all executors: as large as the vocabulary, 1 MB, whatever the corpus."""
    return spark.sparkContext.broadcast(Codec(load_ranks(os.fspath(vocabulary))))


def _lists(ids: list[np.ndarray | None]) -> pa.Array:
    offsets = np.cumsum([0, *(0 if x is None else len(x) for x in ids)]).astype(np.int32)
    values = np.concatenate([np.empty(0, np.int32), *(x for x in ids if x is not None)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array([x is None for x in ids]))


def encoder(spark: SparkSession, vocabulary: str = VOCABULARY):
    """A column function: text to an array of ids."""
    part = _shared(spark, vocabulary)

    @F.arrow_udf("array<int>")
    def encode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for c in columns:
            yield _lists([None if t is None else np.array(part.value.encode(t), np.int32) for t in each(c)])

    return encode


def decoder(spark: SparkSession, vocabulary: str = VOCABULARY):
    """A column function: an array of ids to text."""
    part = _shared(spark, vocabulary)

    @F.arrow_udf("string")
    def decode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for c in columns:
            yield pa.array([None if i is None else part.value.decode(i) for i in each(c)], pa.string())

    return decode


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, ``token_ids``, ``n_tokens`` and ``round_trip`` (decoding the ids gave the text again)."""
    part = _shared(docs.sparkSession, vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()

    def coded(batches):
        codec = part.value
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                ids, same = [], []
                for t in b.column(1).slice(k, ROWS).to_pylist():
                    x = None if t is None else codec.encode(t)
                    same.append(None if t is None else codec.decode(x) == t)
                    ids.append(None if t is None else np.array(x, np.int32))
                n = pa.array([None if x is None else len(x) for x in ids], pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, ROWS), _lists(ids), n, pa.array(same, pa.bool_())], ["doc_id", "token_ids", "n_tokens", "round_trip"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(coded, f"doc_id {kind}, token_ids array<int>, n_tokens int, round_trip boolean")


def with_tokens(docs: DataFrame, text_col: str = "text", ids_col: str = "token_ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with a column of ids, which takes the place of one so named."""
    ids: Column = encoder(docs.sparkSession, vocabulary)(text_col)
    return docs.withColumn(ids_col, ids)
