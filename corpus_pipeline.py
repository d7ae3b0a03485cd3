"""A corpus from raw documents to token ids, in five stages, each written and read again.

1. toxicity: rows that the subword classifier rejects go.
2. exact_dedup: of rows with equal texts the first stays.
3. jaccard_join: of each connected group of similar rows one stays.
4. decontamination: rows that hold half of a benchmark item or more go.
5. bpe: ``doc_id``, ``token_ids``, ``n_tokens`` and ``round_trip`` of what is left.

A stage works on all that its predecessor kept; its input and scratch tables are deleted once its output is written. Defined cases
are those of the operators; an empty table gives an empty one.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from cloakframe.llm import bpe, decontaminate, exact_dedup, jaccard_join, toxicity
from cloakframe.llm.common import drop_tables, finished, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.tokens(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Trained, approximate and merging stages have no SQL; tests/llm holds the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        make = partial(stage, spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return make()
        before, docs = docs, finished(make)
        if k:
            drop_tables(before)
