"""The queries of this folder: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import archive, bpe, decontaminate, exact_dedup, html_extract, jaccard_join, license_scan, quality, secrets, toxicity
from .common import read


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokens(read(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(read(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op10_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.convert(archive.arcs_of_pages(read(spark, sf_dir, "pages")))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


_OP4 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents
), b AS (
  SELECT item_id, row_number() OVER () AS r, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark
), bs AS (
  SELECT DISTINCT item_id, r, least(5, len(w)) AS m, unnest(CASE WHEN len(w) <= 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM b WHERE len(w) > 0
), sizes AS (
  SELECT r, count(*) AS n FROM bs GROUP BY r
), lens AS (
  SELECT DISTINCT m FROM bs
), ds AS (
  SELECT DISTINCT doc_id, r, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS g
  FROM d, lens WHERE len(w) >= m
)
SELECT bs.item_id, ds.doc_id, count(*) / any_value(sizes.n) AS containment
FROM bs JOIN ds USING (m, g) JOIN sizes ON sizes.r = bs.r
GROUP BY bs.item_id, bs.r, ds.doc_id, ds.r
HAVING count(*) / any_value(sizes.n) >= 0.5
"""

_OP6 = """
SELECT doc_id, first_value(doc_id) OVER same AS first_doc_id, count(*) OVER (PARTITION BY text) AS n_copies, row_number() OVER same > 1 AS is_copy
FROM documents WHERE text IS NOT NULL WINDOW same AS (PARTITION BY text ORDER BY doc_id NULLS LAST)
UNION ALL SELECT doc_id, doc_id, 1, false FROM documents WHERE text IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_decontaminate": _OP4, "op6_exact_dedup": _OP6}
