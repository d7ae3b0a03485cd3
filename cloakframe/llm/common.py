"""Plumbing that the operators of this folder share: scratch tables, row ids, word hashes."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes, that is ever sent to all executors; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20

WORD = re.compile(r"\w+")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where none is named and Spark is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="cloakframe-")
    atexit.register(shutil.rmtree, folder, True)
    made = f"file://{folder}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Tables written since each ``finished`` that is under way.
_BEHIND: list[list[DataFrame]] = []


def write_table(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/cloakframe/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    if _BEHIND:
        _BEHIND[-1].append(out)
    return out


def finished(make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns as a written table; the scratch tables behind it are deleted."""
    _BEHIND.append([])
    try:
        out = write_table(make())
    finally:
        behind = _BEHIND.pop()
    drop_tables(*(t for t in behind if t is not out))
    return out


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables of ``write_table`` that nothing reads any more."""
    for t in tables:
        jvm, path = t.sparkSession._jvm, t._scratch
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_MOVES_ROWS = re.compile(r"Exchange|Sort|Limit|Join|Aggregate|MapIn|Sample")


def with_row_id(df: DataFrame) -> tuple[DataFrame, str]:
    """Add a row number that is the same in every later evaluation, also after a lost executor.

    It is a partition's number and the place of the row in it; over plain file scans both are
    fixed by the file splits. Any plan that moves rows is written to the shared folder first.
    """
    rid = fresh(df, "_rid")
    if _MOVES_ROWS.search(df._jdf.queryExecution().executedPlan().toString()):
        df = write_table(df)
    return df.withColumn(rid, F.monotonically_increasing_id()), rid


def small_enough(df: DataFrame, row_bytes: int) -> bool:
    """Counts the rows (of a written table: from its footers) against BROADCAST_BYTES."""
    return df.count() * row_bytes <= BROADCAST_BYTES


def without_rows(df: DataFrame, rid: str, removed: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``rid`` isn't in the one-column written table ``removed``; drops ``rid``."""
    side = F.broadcast(removed) if small_enough(removed, 16) else removed
    return df.join(side, rid, "left_anti").drop(rid)


#: Values of an Arrow batch that are turned into Python objects at a time.
ROWS = 256


def each(c: pa.Array) -> Iterator:
    """The values of an array, a few as Python objects at a time."""
    for k in range(0, len(c), ROWS):
        yield from c.slice(k, ROWS).to_pylist()


class WordHashes(dict):
    """word -> 64-bit hash, filled on demand; ``trim`` between documents bounds its memory."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def trim(self, most: int = 150_000) -> None:
        if len(self) > most:
            self.clear()


_MUL = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, n: int, cache: WordHashes) -> np.ndarray:
    """Hashes of the word n-grams of a text in order. A text of fewer than n words, but one at
    least, is a single shingle; null and texts without words have none."""
    words = WORD.findall(text.lower()) if text else ()
    if not words:
        return np.empty(0, np.uint64)
    cache.trim()
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    m = min(n, len(h))
    out = h[: len(h) - m + 1].copy()
    for k in range(1, m):
        out *= _MUL
        out ^= out >> np.uint64(29)
        out += h[k : len(h) - m + 1 + k]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """From batches sorted by ``key``: tables that hold whole runs of equal keys."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key)
        last = k[-1]
        if held and held[-1].column(key)[-1] == last:
            held.append(b)
            if k[0] != last:
                t = pa.Table.from_batches(held).combine_chunks()
                cut = _last_run(t.column(key).chunk(0))
                yield t.slice(0, cut)
                held = t.slice(cut).to_batches()
            continue
        cut = _last_run(k)
        ready = [*held, b.slice(0, cut)]
        if sum(x.num_rows for x in ready):
            yield pa.Table.from_batches(ready).combine_chunks()
        held = [b.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _last_run(k: pa.Array) -> int:
    v = k.to_numpy(zero_copy_only=False)
    other = np.flatnonzero(v != v[-1])
    return int(other[-1]) + 1 if len(other) else 0
