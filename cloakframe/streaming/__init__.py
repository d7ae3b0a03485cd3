"""Masking of streams. The column functions keep no state, so they work in streaming plans as they are."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contains_pii, mask_pii


def read_stream(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A folder or file of Parquet as a stream; the schema is that of what is there."""
    schema = schema or spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path)


def hit_rates(events: DataFrame, time_col: str, text_col: str, width: str = "5 minutes", late: str = "10 minutes", patterns: Sequence[str] | None = None) -> DataFrame:
    """Rows, and rows with personal data, by window of event time; rows later than ``late`` are dropped."""
    hits = events.select(time_col, contains_pii(F.col(text_col), patterns).alias("hit")).withWatermark(time_col, late)
    return hits.groupBy(F.window(time_col, width).alias("window")).agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


def masked_once(spark: SparkSession, path: str, columns: Sequence[str], keep: Sequence[str], patterns: Sequence[str] | None = None) -> DataFrame:
    """All that is in ``path``, masked in one streaming run and read back from Parquet in the shared folder, where the stream's
    checkpoint is as well: a run that lost its driver goes on where it was if it is given the same folder."""
    from ..sources import as_folder, shared_folder

    stream = read_stream(spark, as_folder(spark, path))
    out = stream.select(*keep, *[mask_pii(c, patterns) for c in columns])
    target = f"{shared_folder(spark)}/cloakframe/stream-{uuid.uuid4().hex}"
    query = out.writeStream.format("parquet").option("path", f"{target}/rows").option("checkpointLocation", f"{target}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{target}/rows")
