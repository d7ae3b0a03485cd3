"""Reading and writing what policies are applied to."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..plans.policy import load_policy


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``; a temporary one only where none is named and Spark is local."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.mkdtemp(prefix='cloakframe-')}"


def as_folder(spark: SparkSession, path: str) -> str:
    """A path that a stream can read: a single file is named by a pattern that only it matches."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        return f"{path[:-1]}[{path[-1]}]"
    return path


def read_table(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Parquet, ORC, JSON or CSV (with a header, all columns strings), told by the suffix if not named."""
    kind = kind or (Path(path).suffix.lstrip(".").lower() or "parquet")
    if kind == "csv":
        return spark.read.csv(path, header=True)
    if kind not in ("parquet", "orc", "json"):
        raise ValueError(f"unsupported format {kind!r}, use parquet, orc, json or csv")
    return spark.read.format(kind).load(path)


def mask_file(spark: SparkSession, config: str, source: str, target: str, single_file: bool = False) -> int:
    """Apply a policy file to a table and write Parquet; gives the number of rows written."""
    masked = load_policy(config).apply(read_table(spark, source, None if Path(source).suffix else "parquet"))
    (masked.coalesce(1) if single_file else masked).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target).count()
