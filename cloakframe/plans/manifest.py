"""Manifests: what a masking run finds, by column and family, with the law that covers it."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..families import BY_NAME, FIELDS, REVERSIBLE
from ..functions import mask_pii_audit

MODES = ("asterisk", "consistent", "fpe")
SCHEMA = "column string, pii_family string, match_count long, regulation string, mask_mode string"


def masking_manifest(df: DataFrame, columns: Sequence[str] | None = None, mode: str = "asterisk") -> DataFrame:
    """A row for each column and family with matches, in the order of both. One job counts all columns.

    ``columns`` defaults to those of strings. In the keyed modes families that can't be reversed count as asterisked.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}, valid modes: {', '.join(MODES)}")
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns that the data doesn't have: {', '.join(missing)}")
    if not columns:
        return df.sparkSession.createDataFrame([], SCHEMA)
    counts = df.select([mask_pii_audit(F.col(f"`{c}`")).getField("counts").alias(f"c{i}") for i, c in enumerate(columns)])
    sums = counts.agg(*[F.sum(F.col(f"c{i}.{n}")).alias(f"c{i}_{n}") for i in range(len(columns)) for n in FIELDS])
    rows = [
        F.struct(
            F.lit(i * len(FIELDS) + k).alias("place"), F.lit(c).alias("column"), F.lit(n).alias("pii_family"), F.col(f"c{i}_{n}").alias("match_count"),
            F.lit(BY_NAME[n].law).alias("regulation"), F.lit(mode if n in REVERSIBLE else "asterisk").alias("mask_mode"),
        )
        for i, c in enumerate(columns)
        for k, n in enumerate(FIELDS)
    ]
    found = sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*").filter("match_count > 0")
    return found.orderBy("place").drop("place")


def write_manifest(manifest: DataFrame, path: str | Path, source: str | None = None) -> None:
    """The manifest, of a few rows for each column, as a JSON document."""
    records = [r.asDict() for r in manifest.toLocalIterator()]
    now = datetime.now(tz=timezone.utc)
    document = dict(version="1.0", generated_at=now.isoformat(), source=source, record_count=len(records), records=records)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(document, f, ensure_ascii=False, indent=2)
